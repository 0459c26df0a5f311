"""Exits by signal and by time against a plain walk, bar by bar."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from wickwork.jobs import queries
from wickwork.operators import fills

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def walk(bars, leave, max_hold, cooldown):
    """(signal_no, exit_no, reason, price) of each trade that one position at a time takes."""
    out, trade, ready, close, pending = [], None, 0, False, None
    for b in bars:
        if trade and close:
            out.append((trade[0], b["n"], "signal", b["open"]))
            trade = None
        close = False
        if trade:
            _, seen, sl, tp = trade
            if b["low"] <= sl:
                out.append((trade[0], b["n"], "stop_loss", min(sl, b["open"])))
                trade, ready = None, b["n"] + cooldown
            elif b["high"] >= tp:
                out.append((trade[0], b["n"], "take_profit", max(tp, b["open"])))
                trade = None
        if pending:
            trade, pending = (pending["n"], b["n"], pending["stop_loss"], pending["take_profit"]), None
        if trade:
            close = bool(leave and b["leave"]) or (max_hold is not None and b["n"] - trade[1] >= max_hold)
        elif b["enter"] and b["n"] >= ready:
            pending = b
    if trade:
        out.append((trade[0], None, None, None))
    return out


@pytest.mark.parametrize("name, hold", [("sma", None), ("drops", 20), ("drops", 1)])
def test_walk(spark, name, hold):
    s = queries.written(queries._cross(spark, SF) if name == "sma" else queries._drops(spark, SF), "test-exits")
    leave, cool = (True, 0) if name == "sma" else (False, 5)
    got = {}
    for r in queries._walked(s, F.col("leave") if leave else None, hold, cool).collect():
        got.setdefault(r["ticker"], []).append((r["signal_no"], None if r["exit_no"] is None else int(r["exit_no"]), r["exit_reason"], r["exit_price"]))
    by = {}
    for b in s.orderBy("n").collect():
        by.setdefault(b["ticker"], []).append(b)
    want = {k: w for k, b in by.items() if (w := walk(b, leave, hold, cool))}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert want and (hold == 20 or any(t[2] == "signal" for w in want.values() for t in w))


def test_first_of_signal_and_time(spark):
    t = [dt.datetime(2020, 1, 1) + dt.timedelta(hours=k) for k in range(8)]
    bars = spark.createDataFrame([("s", "a", t[k], k + 1, k == 5, t[k + 1] if k < 7 else None, float(k + 1) if k < 7 else None) for k in range(8)], "source string, ticker string, ts timestamp_ntz, n long, leave boolean, next_ts timestamp_ntz, next_open double")
    trades = spark.createDataFrame([("s", "a", 1, t[1]), ("s", "a", 6, t[6]), ("s", "a", 4, t[4])], "source string, ticker string, signal_no long, entry_time timestamp_ntz")
    got = {r["signal_no"]: (r["close_ts"], r["close_open"]) for r in fills.signal_closes(trades, bars, F.col("leave"), 2).collect()}
    assert got == {1: (t[4], 4.0), 4: (t[6], 6.0), 6: (None, None)}
