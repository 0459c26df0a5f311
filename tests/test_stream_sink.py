"""The keyed sink of a stream, and cells of long series."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wickwork.operators import series
from wickwork.streaming import bars

SCHEMA = "source string, ticker string, ts timestamp, open double, high double, low double, close double, volume double"
T0 = dt.datetime(2024, 1, 1)


def row(k, v):
    return ("s", "a", T0 + dt.timedelta(hours=k), 1.0, 2.0, 0.5, float(v), float(v))


def test_replayed_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "bars")
    sink = bars.upsert_sink(path)
    batches = [[row(0, 1), row(30, 1)], [row(0, 2), row(31, 1)], [row(31, 3)]]
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    for i in (0, 1, 1, 2, 0, 1):  # replays, also after later batches
        sink(frames[i], i)
    got = sorted((r["ts"], r["close"]) for r in spark.read.parquet(path).collect())
    assert got == [(row(0, 2)[2], 2.0), (row(30, 1)[2], 1.0), (row(31, 3)[2], 3.0)]


def test_cells_of_a_long_series(spark, monkeypatch):
    """Next rows and products of later rows by cells, as one window over the series gives them."""
    monkeypatch.setattr(series, "CELL", 5 * 3600)
    r = random.Random(5)
    rows = [("a", T0 + dt.timedelta(hours=k), k, r.choice([1.0, 1.0, 2.0, 0.5])) for k in range(60) if r.random() < 0.7]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v int, f double")
    got = series.with_later_product(series.with_following(df, ("k",), "ts", {"nxt": "v"}), ("k",), "ts", F.col("f"), "after").orderBy("ts").collect()
    want_next = [b[2] for b in rows[1:]] + [None]
    products = [1.0]
    for x in reversed(rows[1:]):
        products.append(products[-1] * x[3])
    assert [x["nxt"] for x in got] == want_next and [x["after"] for x in got] == products[::-1]
