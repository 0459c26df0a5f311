"""Moved stops without a horizon against a plain walk."""

import os

from wickwork.jobs import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_walk(spark):
    b = queries._numbered(spark, SF)
    by, want = {}, {}
    for r in b.orderBy("n").collect():
        by.setdefault((r["source"], r["ticker"]), []).append(r)
    for t in queries._trades(b).collect():
        for r in by[t["source"], t["ticker"]]:
            if r["ts"] > t["entry_time"]:
                sl = t["entry_price"] if r["n"] - t["n"] > 4 else t["stop_loss"]
                buy = t["side"] == "buy"
                stop, target = (r["low"] <= sl, r["high"] >= t["take_profit"]) if buy else (r["high"] >= sl, r["low"] <= t["take_profit"])
                if stop or target:
                    want[t["trade_id"]] = (r["ts"], "stop_loss" if stop else "take_profit")
                    break
    got = {r["trade_id"]: (r["exit_time"], r["exit_reason"]) for r in queries.QUERIES["f8_moving_levels"](spark, SF).collect()}
    assert got == want and want
