"""Gap orders without a horizon, renewed by confirmed swings, against a plain walk."""

import datetime as dt
import os

from wickwork.jobs import queries
from wickwork.operators import signals

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RR = 0.5


def entry(bull, sl, tp, top, bottom):
    e = (tp + RR * sl) / (RR + 1)
    if bull:
        return top if e > top else e if e > bottom else None
    return top if e < bottom else e if e < top else None


def walk(s, bars, left):
    """``bars``: all of the series; a swing is the middle one of three."""
    bull, tp, price, waiting, renewals = s["bullish"] == 1, s["take_profit"], s["entry"], False, 0
    own = next(b for b in bars if b["n"] == s["n"])
    if own["high"] > tp if bull else own["low"] < tp:  # passed on the setup's own bar
        if not left:
            return "expired", own["ts"], 0
        waiting = True
    for k, b in enumerate(bars):
        if b["n"] <= s["n"]:
            continue
        if not waiting and (b["low"] <= price if bull else b["high"] >= price):
            return "filled", b["ts"], renewals
        if b["low"] <= s["gap_top"] if bull else b["high"] >= s["gap_bottom"]:
            return "tested", b["ts"], renewals
        if waiting:
            known = [bars[i - 1] for i in range(2, k + 1) if (bars[i - 2]["high"] < bars[i - 1]["high"] >= bars[i]["high"] if bull else bars[i - 2]["low"] > bars[i - 1]["low"] <= bars[i]["low"])]
            new = [c["high"] if bull else c["low"] for c in known if c["n"] > s["n"]]
            new = [v for v in new if (v > tp if bull else v < tp)]
            if new:
                tp = max(new) if bull else min(new)
                price = entry(bull, s["stop_loss"], tp, s["gap_top"], s["gap_bottom"])
                if price is None:
                    return "expired", b["ts"], renewals
                renewals, waiting = renewals + 1, False
        elif b["high"] > tp if bull else b["low"] < tp:
            if renewals == left:
                return "expired", b["ts"], renewals
            waiting = True
    return "resting", None, renewals


def series(start, bars):
    return [("s", "a", n + 1, start + dt.timedelta(hours=n), float(o), float(h), float(lo), float(o)) for n, (o, h, lo) in enumerate(bars)]


def test_long_lives(spark):
    start = dt.datetime(2020, 1, 1)
    # a gap between 10 and 12, target 20; the bars stay between, swings pass it, and only bar 80 comes back
    bars = [(9, 10, 9), (11, 13, 10), (13, 14, 12)] + [(15, 16, 14 + k % 2 / 4) for k in range(50)] + [(18, 21, 17), (22, 23, 21), (26, 30, 22), (25, 26, 24), (24, 25, 23)] + [(18, 19, 17)] * 20 + [(15, 15, 13), (12, 13, 10)]
    b = spark.createDataFrame(series(start, bars), "source string, ticker string, n long, ts timestamp_ntz, open double, high double, low double, close double")
    third, last = start + dt.timedelta(hours=2), start + dt.timedelta(hours=len(bars) - 1)
    rows = [(i, "s", "a", n, ts, ts + dt.timedelta(hours=1), 1.0, 12.0, 10.0, 5.0, 20.0, 12.0, False) for i, n, ts in (("x", 3, third), ("y", len(bars), last))]
    s = spark.createDataFrame(rows, "setup_id string, source string, ticker string, n long, ts timestamp_ntz, c3_end timestamp_ntz, bullish double, gap_top double, gap_bottom double, stop_loss double, take_profit double, entry double, broken boolean")
    f = b.withColumn("tf_seconds", queries.F.lit(3600).cast("long"))
    swings = queries._swings(f)
    for left in (0, 2):
        got = {r["setup_id"]: (r["state"], r["state_ts"], r["renewals"]) for r in signals.gap_orders(s, b, swings, RR, left).collect()}
        assert got == {r["setup_id"]: walk(r, b.orderBy("n").collect(), left) for r in s.collect()}
        assert got["y"] == ("resting", None, 0) and got["x"] == (("expired", start + dt.timedelta(hours=53), 0) if left == 0 else ("filled", last, 1))


def test_queries(spark):
    bars, setups, _ = queries._setups(spark, SF)
    by = {}
    for b in bars.orderBy("n").collect():
        by.setdefault((b["source"], b["ticker"]), []).append(b)
    rows = setups.collect()
    for left, name in ((0, "g5_gap_orders"), (2, "g5_gap_orders_renewed")):
        got = {r["setup_id"]: (r["state"], r["state_ts"]) for r in queries.QUERIES[name](spark, SF).collect()}
        want = {f"{s['source']}:{s['ticker']}:{s['n']}": walk(s, by[s["source"], s["ticker"]], left)[:2] for s in rows}
        assert got == want
