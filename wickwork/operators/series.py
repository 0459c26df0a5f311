"""Running values over long series without a task per series.

Rows are dealt by (series, time cell) or (series, chunk of rows). What a cell inherits from the cells before comes from a table with
one row per cell, whose window is small. A symbol with a large share of all rows so spreads over as many tasks as it has cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from wickwork.functions.sessions import epoch

#: Seconds of a time cell, rows of a chunk.
CELL, CHUNK_ROWS = 64 * 86400, 1 << 20


def _with_cell(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("w_cell", F.floor(epoch(ts) / CELL))


def with_previous(df: DataFrame, by: tuple[str, ...], ts: str, columns: dict[str, str]) -> DataFrame:
    """Adds for each ``new: old`` the value of ``old`` in the series' row before."""
    rows = _with_cell(df, ts)
    held = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    ends = rows.groupBy(*by, "w_cell").agg(F.max_by(held, ts).alias("w_end"))
    ends = ends.select(*by, "w_cell", F.lag("w_end").over(Window.partitionBy(*by).orderBy("w_cell")).alias("w_in"))
    inside = Window.partitionBy(*by, "w_cell").orderBy(ts)
    out = rows.withColumn("w_prev", F.lag(held).over(inside)).join(ends, [*by, "w_cell"])
    return out.withColumn("w_prev", F.coalesce("w_prev", "w_in")).withColumns({new: F.col(f"w_prev.{new}") for new in columns}).drop("w_cell", "w_prev", "w_in")


def with_following(df: DataFrame, by: tuple[str, ...], ts: str, columns: dict[str, str]) -> DataFrame:
    """Adds for each ``new: old`` the value of ``old`` in the series' next row."""
    rows = _with_cell(df, ts)
    held = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    begins = rows.groupBy(*by, "w_cell").agg(F.min_by(held, ts).alias("w_begin"))
    begins = begins.select(*by, "w_cell", F.lead("w_begin").over(Window.partitionBy(*by).orderBy("w_cell")).alias("w_out"))
    inside = Window.partitionBy(*by, "w_cell").orderBy(ts)
    out = rows.withColumn("w_then", F.lead(held).over(inside)).join(begins, [*by, "w_cell"])
    return out.withColumn("w_then", F.coalesce("w_then", "w_out")).withColumns({new: F.col(f"w_then.{new}") for new in columns}).drop("w_cell", "w_then", "w_out")


def with_later_product(df: DataFrame, by: tuple[str, ...], ts: str, factor: Column, out: str) -> DataFrame:
    """Adds the product of ``factor`` over all rows after this one: inside its cell, times the product of the cells behind."""
    rows = _with_cell(df, ts).withColumn("w_f", factor)
    after = Window.partitionBy(*by).orderBy("w_cell").rowsBetween(1, Window.unboundedFollowing)
    ends = rows.groupBy(*by, "w_cell").agg(F.product("w_f").alias("w_p"))
    ends = ends.select(*by, "w_cell", F.coalesce(F.product("w_p").over(after), F.lit(1.0)).alias("w_p"))
    inside = Window.partitionBy(*by, "w_cell").orderBy(ts).rowsBetween(1, Window.unboundedFollowing)
    got = rows.withColumn("w_in", F.coalesce(F.product("w_f").over(inside), F.lit(1.0))).join(ends, [*by, "w_cell"])
    return got.withColumn(out, F.col("w_in") * F.col("w_p")).drop("w_cell", "w_f", "w_in", "w_p")


def with_running(df: DataFrame, by: tuple[str, ...], order: list[str], sums: dict[str, Column], cell: Column | None = None) -> DataFrame:
    """Adds running sums, this row included, in the order of ``order`` (the first of which is a time, or ``cell`` says in which cell of it a row lies)."""
    rows = (_with_cell(df, order[0]) if cell is None else df.withColumn("w_cell", cell)).withColumns({f"w_v_{n}": c for n, c in sums.items()})
    ends = rows.groupBy(*by, "w_cell").agg(*[F.sum(f"w_v_{n}").alias(f"w_t_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy("w_cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "w_cell", *[F.sum(f"w_t_{n}").over(before).alias(f"w_b_{n}") for n in sums])
    inside = Window.partitionBy(*by, "w_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"w_s_{n}": F.sum(f"w_v_{n}").over(inside) for n in sums}).join(ends, [*by, "w_cell"])
    out = out.withColumns({n: F.when(F.col(f"w_b_{n}").isNull(), F.col(f"w_s_{n}")).otherwise(F.col(f"w_s_{n}") + F.col(f"w_b_{n}")) for n in sums})
    return out.drop("w_cell", *[f"w_{k}_{n}" for k in "vsb" for n in sums])


def with_running_max(df: DataFrame, by: tuple[str, ...], ts: str, values: dict[str, Column]) -> DataFrame:
    """Adds running maxima, this row included, by time."""
    rows = _with_cell(df, ts).withColumns({f"w_v_{n}": c for n, c in values.items()})
    ends = rows.groupBy(*by, "w_cell").agg(*[F.max(f"w_v_{n}").alias(f"w_t_{n}") for n in values])
    before = Window.partitionBy(*by).orderBy("w_cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "w_cell", *[F.max(f"w_t_{n}").over(before).alias(f"w_b_{n}") for n in values])
    inside = Window.partitionBy(*by, "w_cell").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"w_s_{n}": F.max(f"w_v_{n}").over(inside) for n in values}).join(ends, [*by, "w_cell"])
    return out.withColumns({n: F.greatest(f"w_b_{n}", f"w_s_{n}") for n in values}).drop("w_cell", *[f"w_{k}_{n}" for k in "vsb" for n in values])


def in_chunks(bars: DataFrame, lookback: int, fn: Callable[[DataFrame, tuple[str, ...]], DataFrame], by: tuple[str, ...], rows: int | None = None) -> DataFrame:
    """``fn(bars, by)`` for a function that looks back at most ``lookback`` rows of a series numbered by ``n``.

    Each chunk of rows gets the last ``lookback`` rows of the chunk before as well; these copies are dropped afterwards. Calls inside ``fn``
    share its chunks, and so one shuffle, if all of them together look back no further.
    """
    if "w_chunk" in by:  # inside a chunk already
        return fn(bars, by)
    size = rows or max(CHUNK_ROWS, 4 * lookback)
    if lookback >= size:
        raise ValueError("a chunk must be longer than the lookback")
    chunk = F.floor((F.col("n") - 1) / size)
    copies = F.when((F.col("n") - 1) % size >= size - lookback, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    out = fn(bars.withColumn("w_chunk", F.explode(copies)), (*by, "w_chunk"))
    return out.where(F.col("w_chunk") == chunk).drop("w_chunk")


def looking_back(bars: DataFrame, rows: int, columns: Callable[[WindowSpec], dict[str, Column]], by: tuple[str, ...]) -> DataFrame:
    """Adds window columns over the series in the order of ``n`` that look back at most ``rows`` rows, chunk by chunk."""
    return in_chunks(bars, rows, lambda b, keys: b.withColumns(columns(Window.partitionBy(*keys).orderBy("n"))), tuple(by))
