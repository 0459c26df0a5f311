"""Resampling bars to several timeframes at once, with still-forming bars.

Rows expand by timeframe with narrow columns. The row before and the running bar number are found within (series, time cell), so that
one long series spreads over tasks (see ``series``); the bars' own values are windows per bar. Bars are runs: a new bar begins when the bucket changes or when the row before closed its
bucket, so that rows after the session's close each make a bar of their own under the same label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.sessions import bucket_bounds
from wickwork.operators.series import with_previous, with_running
from wickwork.schema import KEY

SERIES = (*KEY, "tf_seconds")
SESSION = ("tz", "open_sec", "close_sec", "day_anchor_sec")


def forming(bars: DataFrame, instruments: DataFrame, timeframes: list[int], base: int) -> DataFrame:
    """One row per base bar and timeframe: the bar of that timeframe as it stands after the base bar.

    ``bar_no`` counts the bars of the series; ``is_closed`` tells whether this base bar ends it; ``n`` counts its base bars.
    The base timeframe passes through.
    """
    if bad := [t for t in timeframes if t % base]:
        raise ValueError(f"not multiples of {base} s: {bad}")
    tfs = F.array(*[F.lit(t).cast("long") for t in sorted(set(timeframes))])
    rows = bars.drop("tf_seconds").join(instruments.select(*KEY, *SESSION), list(KEY)).withColumn("tf_seconds", F.explode(tfs))
    rows = bucket_bounds(rows)
    same = F.col("tf_seconds") == base
    end = F.expr(f"timestampadd(SECOND, {base}, ts)")
    rows = rows.withColumn("open_utc", F.when(same, F.col("ts")).otherwise(F.col("open_utc"))).withColumn("w_closes", same | (end >= F.col("close_utc")))
    rows = with_previous(rows, SERIES, "ts", {"w_last_open": "open_utc", "w_last_closes": "w_closes"})
    begins = F.coalesce((F.col("open_utc") != F.col("w_last_open")) | F.col("w_last_closes"), F.lit(True))
    rows = with_running(rows, SERIES, ["ts"], {"bar_no": begins.cast("int")})
    run = Window.partitionBy(*SERIES, "bar_no").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        *SERIES, F.col("ts").alias("step"), "bar_no", F.col("open_utc").alias("ts"), F.first("open").over(run).alias("open"), F.max("high").over(run).alias("high"),
        F.min("low").over(run).alias("low"), "close", F.sum("volume").over(run).alias("volume"), F.col("w_closes").alias("is_closed"), F.count(F.lit(1)).over(run).alias("n"),
    )


def bars_of(steps: DataFrame) -> DataFrame:
    """One row per bar of ``forming``; closed if its last base bar ends it or a later bar exists."""
    last = F.struct("step")
    bars = steps.groupBy(*SERIES, "bar_no", "ts").agg(
        F.max_by("open", last).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", last).alias("close"), F.max("volume").alias("volume"), F.max("is_closed").alias("is_closed"), F.max("step").alias("last_step")
    )
    # a later bar exists where the one with the next number does
    later = bars.select(*SERIES, (F.col("bar_no") - 1).alias("bar_no"), F.lit(True).alias("w_later"))
    bars = bars.join(later, [*SERIES, "bar_no"], "left")
    return bars.withColumn("is_closed", F.col("is_closed") | F.coalesce("w_later", F.lit(False))).drop("w_later")


def closed(bars: DataFrame, instruments: DataFrame, timeframes: list[int], base: int) -> DataFrame:
    """Closed bars of each timeframe; an unfinished last bucket is left out."""
    return bars_of(forming(bars, instruments, timeframes, base)).where("is_closed").drop("last_step")
