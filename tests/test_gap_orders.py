"""Setups against a plain walk over the bars, and queries without oracle SQL."""

import os

from wickwork.jobs import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_setups_know_no_later_bar(spark):
    """Setups of the bars so far are those of all bars, up to there: nothing is taken from what comes later."""
    bars, setups, swings = queries._setups(spark, SF)
    by = {}
    for b in bars.orderBy("n").collect():
        by.setdefault(b["ticker"], []).append(b)
    rows = setups.collect()
    assert rows
    for s in rows:
        known = by[s["ticker"]][: s["n"]]  # up to the third bar
        c1, c3, bull = known[-3], known[-1], s["bullish"] == 1
        turns = [known[i - 1] for i in range(2, len(known)) if (known[i - 2]["high"] < known[i - 1]["high"] >= known[i]["high"])]
        dips = [known[i - 1] for i in range(2, len(known)) if (known[i - 2]["low"] > known[i - 1]["low"] <= known[i]["low"])]
        ends = c1["ts"] + (c3["c3_end"] - c3["ts"] if "c3_end" in c3 else s["c3_end"] - s["ts"])
        stop = [b["low" if bull else "high"] for b in (dips if bull else turns) if b["ts"] <= ends]
        inside = [b["high" if bull else "low"] for b in (turns if bull else dips) if b["ts"] >= c1["ts"]]
        assert s["stop_loss"] == stop[-1] and s["take_profit"] == (max if bull else min)(inside)
        assert (c1["high"] < c3["low"]) == bull and s["broken"] == (c3["high"] > s["take_profit"] if bull else c3["low"] < s["take_profit"])


def test_every_query_runs(spark):
    """Queries without oracle SQL at least keep their schema and give rows."""
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLES)):
        assert queries.QUERIES[name](spark, SF).count() > 0, name
