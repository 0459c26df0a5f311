"""Ticks and base bars from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.functions.sessions import at, epoch
from wickwork.schema import KEY


def event_ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """(source, ticker, ts, price, volume, seq): one tick per event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.lit("events").alias("source"), F.col(symbol).cast("string").alias("ticker"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"))


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.lit("orders").alias("source"), F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"), F.col("o_orderkey").alias("seq"))


def base_bars(ticks: DataFrame, secs: int) -> DataFrame:
    """Bars of fixed UTC length: one partial aggregation and one shuffle by key and bar."""
    t = ticks.withColumn("w_e", epoch("ts")).withColumn("w_bar", F.floor(F.col("w_e") / secs) * secs)
    order = F.struct("ts", "seq")
    bars = t.groupBy(*KEY, "w_bar").agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return bars.withColumn("ts", at("w_bar")).select(*KEY, F.lit(secs).cast("long").alias("tf_seconds"), "ts", "open", "high", "low", "close", "volume")


def event_bars(spark: SparkSession, sf_dir: str, secs: int = 3600, symbol: str = "event_type") -> DataFrame:
    return base_bars(event_ticks(spark, sf_dir, symbol), secs)
