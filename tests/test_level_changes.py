"""Level changes, sweeps and stored bars on small tables."""

import datetime as dt
import glob
import os
import random

from pyspark.sql import functions as F

from wickwork.operators import fills, metrics
from wickwork.sources import ingest

T0 = dt.datetime(2023, 1, 2)
BARS = "source string, ticker string, ts timestamp_ntz, open double, high double, low double, close double"


def at(k):
    return T0 + dt.timedelta(hours=k)


def test_stretches(spark):
    """0, 1 and many changes; nulls leave a level, the last of several at one time counts, early ones do not."""
    trades = spark.createDataFrame([("a", at(2), 90.0, 120.0), ("b", at(2), None, 120.0), ("c", at(2), 90.0, None)], "trade_id string, entry_time timestamp_ntz, stop_loss double, take_profit double")
    changes = spark.createDataFrame(
        [("b", at(4), 95.0, None, 0), ("c", at(1), 1.0, 1.0, 0), ("c", at(3), None, 110.0, 0), ("c", at(3), 92.0, None, 1), ("c", at(6), 93.0, None, 0), ("c", at(6), 94.0, 111.0, 1), ("c", at(9), None, None, 0)],
        "trade_id string, at timestamp_ntz, stop_loss double, take_profit double, seq int",
    )
    got = sorted(tuple(r) for r in fills.level_stretches(trades, changes).select("trade_id", "w_after", "w_until", "stop_loss", "take_profit").collect())
    assert got == [
        ("a", at(2), None, 90.0, 120.0), ("b", at(2), at(4), None, 120.0), ("b", at(4), None, 95.0, 120.0),
        ("c", at(2), at(3), 90.0, None), ("c", at(3), at(6), 92.0, 110.0), ("c", at(6), at(9), 94.0, 111.0), ("c", at(9), None, 94.0, 111.0),
    ]


def test_moving_exits_against_a_walk(spark):
    r = random.Random(4)
    bars, price = [], 100.0
    for k in range(200):
        o, c = price, price * (1 + r.uniform(-0.03, 0.03))
        bars.append(("s", "x", at(k), o, max(o, c) * (1 + r.random() * 0.01), min(o, c) * (1 - r.random() * 0.01), c))
        price = c
    trades, changes, want = [], [], {}
    for i in range(40):
        k, side = r.randrange(0, 180), r.choice(["buy", "sell"])
        way = 1 if side == "buy" else -1
        p = bars[k][3]
        sl, tp = p * (1 - way * 0.05), p * (1 + way * 0.08)
        trades.append((f"t{i}", "s", "x", side, at(k), sl, tp))
        mine = {}
        for j in r.sample(range(k, 200), min(r.choice([0, 1, 5]), 200 - k)):
            mine[j] = (r.choice([None, bars[j][6] * (1 - way * 0.03)]), r.choice([None, bars[j][6] * (1 + way * 0.06)]))
            changes.append((f"t{i}", at(j), *mine[j]))
        for j in range(k, 200):
            _, _, ts, o, h, low, _ = bars[j]
            if j > k:
                stop, target = (low <= sl, h >= tp) if side == "buy" else (h >= sl, low <= tp)
                if stop or target:
                    worst, best = (min, max) if side == "buy" else (max, min)
                    want[f"t{i}"] = (ts, "stop_loss" if stop else "take_profit", worst(sl, o) if stop else best(tp, o))
                    break
            a, b = mine.get(j, (None, None))
            sl, tp = a if a is not None else sl, b if b is not None else tp
    t = spark.createDataFrame(trades, "trade_id string, source string, ticker string, side string, entry_time timestamp_ntz, stop_loss double, take_profit double")
    c = spark.createDataFrame(changes, "trade_id string, at timestamp_ntz, stop_loss double, take_profit double")
    rows = fills.moving_exits(t, c, spark.createDataFrame(bars, BARS)).collect()
    assert len(rows) == 40
    got = {x["trade_id"]: (x["exit_time"], x["exit_reason"], x["exit_price"]) for x in rows if x["exit_time"]}
    assert got == want and want


def test_rows_of_a_sweep_do_not_grow_with_the_sets(spark):
    bars = spark.range(3000).select(F.lit("a").alias("ticker"), F.expr("timestampadd(HOUR, id, TIMESTAMP_NTZ'2020-01-01 00:00:00')").alias("ts"), (100 + F.sin(F.col("id") / 50)).alias("close"))
    few, many = ([f"p{k}" for k in range(n)] for n in (2, 40))
    pick = lambda names: F.array(*[F.lit(float(k % 2)) for k in range(len(names))])
    a, b = (metrics.sweep_metrics(bars, pick(n), n, ["ticker"]) for n in (few, many))
    got = {r["param_id"]: r for r in b.collect()}
    assert len(got) == 40 and got["p1"]["total_return"] == got["p39"]["total_return"] and got["p0"]["total_return"] == 0 and got["p0"]["sharpe"] is None
    assert {r["param_id"]: r["max_drawdown"] for r in a.collect()} == {p: got[p]["max_drawdown"] for p in few}
    shuffles = lambda names: metrics.sweep_metrics(bars, pick(names), names, ["ticker"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(few) == shuffles(many)


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def bars_of(spark, first, n, close):
    rows = [("s", t, 86400, T0 + dt.timedelta(days=first + k), 1.0, 2.0, 0.5, close, 1.0) for k in range(n) for t in ("a", "b")]
    return spark.createDataFrame(rows, "source string, ticker string, tf_seconds long, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_append_touches_its_months_only(spark, tmp_path):
    path = str(tmp_path / "bars")
    ingest.append_bars(path, bars_of(spark, 0, 120, 1.0), 1)
    before = _files(path)
    for _ in range(2):  # the same rows again change nothing
        ingest.append_bars(path, bars_of(spark, 100, 40, 2.0).where("ticker = 'a'"), 2)
    ingest.append_bars(path, bars_of(spark, 100, 3, 9.0), 0)  # an older generation loses
    after = _files(path)
    kept = {f for f in before if f in after and before[f] == after[f]}
    assert {f.split("ticker=")[1].split("/part")[0] for f in kept} == {"a/month=2023-01", "a/month=2023-02", "a/month=2023-03", "b/month=2023-01", "b/month=2023-02", "b/month=2023-03", "b/month=2023-05"}
    assert len(after) == len({os.path.dirname(f) for f in after})  # one file a month
    got = {(r["ticker"], r["ts"]): r["close"] for r in spark.read.parquet(path).collect()}
    want = {("a", T0 + dt.timedelta(days=k)): 2.0 if k >= 100 else 1.0 for k in range(140)} | {("b", T0 + dt.timedelta(days=k)): 1.0 for k in range(120)}
    assert got == want
    ingest.append_bars(path, bars_of(spark, 0, 0, 1.0), 5)  # nothing to append
    assert _files(path) == after


def test_read_from_prunes_months(spark, tmp_path):
    path = str(tmp_path / "bars")
    ingest.append_bars(path, bars_of(spark, 0, 200, 1.0), 1)
    starts = spark.createDataFrame([("s", "a", T0 + dt.timedelta(days=150)), ("s", "b", T0 + dt.timedelta(days=95))], "source string, ticker string, start timestamp_ntz")
    got = ingest.read_from(path, starts, "2023-06-15 00:00:00", spark.read.parquet(path).schema)
    by = {}
    for r in got.collect():
        by.setdefault(r["ticker"], []).append(r["ts"])
    end = dt.datetime(2023, 6, 15)
    assert {k: (min(v), max(v), len(v)) for k, v in by.items()} == {"a": (T0 + dt.timedelta(days=150), end, 15), "b": (T0 + dt.timedelta(days=95), end, 70)}
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
