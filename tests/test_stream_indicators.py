"""Running indicators of a shuffled stream against the batch indicators."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wickwork.operators import indicators
from wickwork.streaming import indicators as live

T0 = dt.datetime(2024, 1, 1)


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(9)
    bars = [("s", t, T0 + dt.timedelta(hours=k), 50 + r.random() * 20) for t in ("a", "b") for k in range(90) if t == "a" or k % 3]
    # each bar arrives up to three hours late
    arrival = sorted(bars, key=lambda b: (b[2] + dt.timedelta(hours=r.random() * 3), b[1]))
    where = str(tmp_path / "in")
    for i in range(0, len(arrival), 40):
        part = arrival[i : i + 40]
        spark.createDataFrame(part + part[:2], "source string, ticker string, ts timestamp, close double").coalesce(1).write.mode("append").parquet(where)  # two bars twice
    with live.with_rocksdb(spark):
        stream = spark.readStream.schema("source string, ticker string, ts timestamp, close double").option("maxFilesPerTrigger", 1).parquet(where).withWatermark("ts", "3 hours")
        q = live.running(stream, 5, 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(x["ticker"], x["ts"]): x for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.createDataFrame(bars, "source string, ticker string, ts timestamp_ntz, close double").withColumn("tf_seconds", F.lit(3600).cast("long"))
    b = indicators.numbered(batch)
    b = indicators.rsi(indicators.ema(indicators.sma(b, 5, out="sma"), 5, out="ema"), 4, out="rsi")
    want = {(x["ticker"], x["ts"]): x for x in b.collect()}
    last = max(x[2] for x in bars) - dt.timedelta(hours=3)
    assert set(got) == {k for k in want if k[1] <= last}
    for k, x in got.items():
        assert x["n"] == want[k]["n"]
        for c in ("close", "sma", "ema", "rsi"):
            a, w = x[c], want[k][c]
            assert (a is None) == (w is None) and (a is None or abs(a - w) < 1e-9), (k, c)
