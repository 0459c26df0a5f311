"""Linear recurrences ``y = a * y + x`` over ordered rows of a series, without a row-by-row fold.

A series is cut into chunks of ``CHUNK`` rows. Within a chunk the recurrence is a running sum of ``x / a**i``, scaled back;
the value that enters a chunk is the fold of the results of the chunks before it, of which only as many matter as
``a ** CHUNK`` has not yet driven below 1e-18. Chunks are dealt by (series, chunk), so a long series spreads over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 256


def smoothed(df: DataFrame, lines: dict[str, Column], no: str, period: int, keep: float, weight: float, by: tuple[str, ...]) -> DataFrame:
    """Adds each of ``lines`` (name: values): null for the first ``period - 1`` valid rows, their mean at ``period``, then ``keep * previous + weight * value``.

    ``no`` numbers the valid rows of a series from 1 (null: row takes no part). All lines share the chunks, windows and joins.
    """
    df = df.withColumns({f"w_x_{n}": x for n, x in lines.items()}).withColumn("w_no", F.col(no))
    seeds = df.where(F.col("w_no") <= period).groupBy(*by).agg(*[(F.sum(f"w_x_{n}") / period).alias(f"w_seed_{n}") for n in lines])
    df = df.withColumn("w_t", F.when(F.col("w_no") >= period, F.col("w_no") - period))
    keep = max(keep, 0.0)
    chunk = CHUNK if keep in (0.0, 1.0) else min(CHUNK, max(1, int(280 / -math.log10(keep))))  # keep ** -chunk stays finite
    df = df.withColumn("w_chunk", F.floor(F.col("w_t") / chunk)).withColumn("w_i", F.col("w_t") % chunk)
    inside = Window.partitionBy(*by, "w_chunk").orderBy("w_i").rowsBetween(Window.unboundedPreceding, 0)
    up, down = F.pow(F.lit(1 / keep), F.col("w_i")) if keep else None, F.pow(F.lit(keep), F.col("w_i"))

    def local(n: str) -> Column:
        term = F.when(F.col("w_t") == 0, F.lit(0.0)).otherwise(F.col(f"w_x_{n}") * weight)  # the seed comes in with its chunk
        return F.sum(term * up).over(inside) * down if keep else term

    df = df.withColumns({f"w_local_{n}": local(n) for n in lines})
    ends = df.where("w_t is not null").groupBy(*by, "w_chunk").agg(*[F.max_by(f"w_local_{n}", "w_i").alias(f"w_end_{n}") for n in lines], F.max("w_i").alias("w_last")).join(seeds, list(by))
    first = F.col("w_chunk") == 0
    ends = ends.withColumns({f"w_end_{n}": F.when(first, F.col(f"w_end_{n}") + F.col(f"w_seed_{n}") * F.pow(F.lit(keep), F.col("w_last"))).otherwise(F.col(f"w_end_{n}")) for n in lines})
    back = 1 if not keep else max(1, math.ceil(18 / (-math.log10(keep) * chunk))) if keep < 1 else 1_000_000
    before = Window.partitionBy(*by).orderBy("w_chunk").rowsBetween(-back, -1)
    step = keep**chunk  # all chunks before one are full
    folded = lambda n: F.aggregate(F.collect_list(f"w_end_{n}").over(before), F.lit(0.0), lambda s, v: s * step + v)
    ends = ends.select(*by, "w_chunk", *[f"w_seed_{n}" for n in lines], *[folded(n).alias(f"w_in_{n}") for n in lines])
    df = df.join(ends, [*by, "w_chunk"], "left")
    carried = lambda n: F.when(first, F.col(f"w_seed_{n}") * F.pow(F.lit(keep), F.col("w_i"))).otherwise(F.col(f"w_in_{n}") * F.pow(F.lit(keep), F.col("w_i") + 1))
    df = df.withColumns({n: F.when(F.col("w_t") >= 0, F.col(f"w_local_{n}") + carried(n)) for n in lines})
    return df.drop("w_no", "w_t", "w_chunk", "w_i", *[f"w_{c}_{n}" for n in lines for c in ("x", "seed", "local", "in")])


def ema(df: DataFrame, lines: dict[str, Column], no: str, period: int, by: tuple[str, ...]) -> DataFrame:
    k = 2.0 / (period + 1)
    return smoothed(df, lines, no, period, 1 - k, k, by)


def wilder(df: DataFrame, lines: dict[str, Column], no: str, period: int, by: tuple[str, ...]) -> DataFrame:
    return smoothed(df, lines, no, period, (period - 1) / period, 1 / period, by)
