"""Exchange sessions: market hours, session bounds, trading-day anchor and bucket bounds.

Times are TIMESTAMP_NTZ in UTC. Bucketing is wall-clock arithmetic in the exchange's zone, on seconds since
1970 of the local clock, so that a bucket across a change of summer time keeps its wall-clock length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY, WEEK = 86400, 604800
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch(ts: str) -> Column:
    """Whole seconds since 1970 of an NTZ column."""
    return F.expr(f"timestampdiff(SECOND, {_EPOCH}, date_trunc('SECOND', {ts}))")


def at(secs: str) -> Column:
    """The NTZ time of seconds since 1970."""
    return F.expr(f"timestampadd(SECOND, cast({secs} as bigint), {_EPOCH})")


def to_local(ts: str, tz: str) -> Column:
    return F.expr(f"convert_timezone('UTC', {tz}, {ts})")


def with_local(df: DataFrame, ts: str = "ts", tz: str = "tz") -> DataFrame:
    """Adds ``local_sec``, the local clock in seconds."""
    local = to_local(ts, tz)
    return df.withColumn("w_local", local).withColumn("local_sec", epoch("w_local")).drop("w_local")


def midnight(local: Column) -> Column:
    return F.floor(local / DAY) * DAY


def weekday(local: Column) -> Column:
    """0: Monday."""
    return F.pmod(F.floor(local / DAY) + 3, F.lit(7)).cast("int")


def is_open(df: DataFrame) -> Column:
    """Market hours of rows with ``local_sec``: always without a session, else the weekday mask and ``open <= time < close``."""
    of_day = df["local_sec"] - midnight(df["local_sec"])
    return F.when(df["close_sec"].isNull(), F.lit(True)).otherwise(F.array_contains("weekdays", weekday(df["local_sec"])) & (of_day >= df["open_sec"]) & (of_day < df["close_sec"]))


def with_utc(df: DataFrame, name: str, local: Column) -> DataFrame:
    """Adds ``name``, the UTC time of a local clock value; null stays null."""
    return df.withColumn("w_sec", local).withColumn("w_ntz", at("w_sec")).withColumn(name, F.expr("convert_timezone(tz, 'UTC', w_ntz)")).drop("w_sec", "w_ntz")


def session_bounds(df: DataFrame) -> DataFrame:
    """Adds ``session_open`` and ``session_close`` in UTC of the local date; null for round-the-clock markets."""
    day = midnight(F.col("local_sec"))
    df = with_utc(df, "session_open", F.when(F.col("close_sec").isNotNull(), day + F.col("open_sec")))
    return with_utc(df, "session_close", F.when(F.col("close_sec").isNotNull(), day + F.col("close_sec")))


def day_anchor(local: Column, anchor_sec: Column) -> Column:
    """Start of the trading day: local midnight, or the latest anchor at or before the time."""
    start = midnight(local) + F.coalesce(anchor_sec, F.lit(0))
    return F.when(local < start, start - DAY).otherwise(start)


def bucket_bounds(df: DataFrame, tf: str = "tf_seconds") -> DataFrame:
    """Adds ``open_utc`` and ``close_utc`` of each row's bucket.

    Whole weeks open on local Monday. Other buckets count from the trading day's anchor, so that those longer than a
    day begin anew each day; those of up to a day end with the session at the latest.
    """
    df = with_local(df)
    local, secs = F.col("local_sec"), F.col(tf)
    monday = midnight(local) - weekday(local) * DAY
    ref = day_anchor(local, F.col("day_anchor_sec"))
    start = F.when(secs % WEEK == 0, monday).otherwise(ref + F.floor((local - ref) / secs) * secs)
    end = start + secs
    session_end = midnight(local) + F.col("close_sec")
    end = F.when((secs % WEEK != 0) & (secs <= DAY) & (session_end < end), session_end).otherwise(end)
    df = df.withColumn("w_start", start).withColumn("w_end", end)
    return with_utc(with_utc(df, "open_utc", F.col("w_start")), "close_utc", F.col("w_end")).drop("w_start", "w_end", "local_sec")
