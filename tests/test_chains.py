"""Paths by pointer doubling, and the gate built on them, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from wickwork.operators import chains, signals


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1024])
def test_path(spark, block):
    r = random.Random(block)
    rows, want = [], set()
    for key, n in (("a", 1), ("b", 300), ("c", 64), ("d", 2), ("e", 129)):
        to = [i + r.choice([1, 1, 2, 3, 40]) for i in range(n)]
        if key == "c":
            to[40:] = [None] * (n - 40)
        rows += [(key, i, t) for i, t in enumerate(to)]
        at = 0
        while at is not None and at < n:
            want.add((key, at))
            at = to[at]
    df = spark.createDataFrame(rows, "k string, r long, t long").repartition(3)
    got = chains.on_path(df, ["k"], "r", "t", block)
    assert got.columns == df.columns or set(got.columns) == set(df.columns)
    assert sorted((x["k"], x["r"]) for x in got.collect()) == sorted(want)


def fold(rows, cooldown):
    taken, free = [], -1
    for key, no, trade, end, reason in sorted(rows, key=lambda x: (x[1], x[2])):
        if no >= free:
            taken.append((key, trade))
            if end is None:
                break
            free = end + (cooldown if reason == "stop_loss" else 0)
    return taken


@pytest.mark.parametrize("block, cell", [(4, 16), (1024, 1 << 16)])
def test_gate(spark, monkeypatch, block, cell):
    monkeypatch.setattr(chains, "BLOCK", block)
    monkeypatch.setattr(signals, "NO_CELL", cell)
    r = random.Random(3)
    rows = []
    for key, n in (("a", 150), ("b", 40), ("c", 1)):
        for i in range(n):
            no = r.randint(1, n)  # several candidates on one bar
            end = no + r.randint(1, 25)
            rows.append((key, no, f"{key}{i}", float(end) if r.random() < 0.98 else None, r.choice(["stop_loss", "take_profit", "signal"])))
    rows = [(k, n, t, e, x if e else None) for k, n, t, e, x in rows]
    df = spark.createDataFrame(rows, "ticker string, signal_no long, trade_id string, exit_no double, exit_reason string").repartition(4)
    for cooldown in (0, 5):
        got = signals.gate(df, cooldown, by=["ticker"])
        assert got.columns == df.columns
        want = sorted(x for k in "abc" for x in fold([y for y in rows if y[0] == k], cooldown))
        assert sorted((x["ticker"], x["trade_id"]) for x in got.collect()) == want


def test_gate_spreads_one_symbol(spark, monkeypatch):
    """One symbol's path is found in many blocks, and without Python."""
    monkeypatch.setattr(chains, "BLOCK", 64)
    n = 5000
    df = spark.range(n).select(F.lit("a").alias("ticker"), F.col("id").alias("signal_no"), F.format_string("%06d", "id").alias("trade_id"), (F.col("id") + 3).cast("double").alias("exit_no"), F.lit("signal").alias("exit_reason"))
    got = signals.gate(df, by=["ticker"])
    assert [x["signal_no"] for x in got.orderBy("signal_no").collect()] == list(range(0, n, 3))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
