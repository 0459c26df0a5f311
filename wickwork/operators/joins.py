"""As-of, interval, first-touch and sub-bar joins.

As-of joins union both sides and carry the last right row along one window per key. Interval and first-touch joins
meet on (key, time cell), never on a bare range: a time span is cut into cells of fixed length, and the bars of whole
cells take part through one summary row per cell (a zone map), so that a long-lived order touches a cell's summary
instead of its bars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.sessions import epoch


def asof(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], strict: bool = False, prefix: str = "", cell: int = 30 * 86400, axis: Callable = epoch) -> DataFrame:
    """``left`` with ``values`` of the latest right row at or before (``strict``: before) its time, null if none.

    Rows are dealt by (key, time cell), so that one long series spreads over tasks; what a cell inherits comes from a small
    table of each cell's last right row. ``axis`` makes a number of a time; for times that are numbers it is ``F.col``.
    """
    keys = [f"w_{c}" for c in by]
    r = right.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(right_ts).alias("w_ts"), F.struct(right_ts, *values).alias("w_right"), F.lit(1 if strict else 0).alias("w_o"))
    lr = left.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(left_ts).alias("w_ts"), F.struct(*left.columns).alias("w_left"), F.lit(None).cast(r.schema["w_right"].dataType).alias("w_right"), F.lit(0 if strict else 1).alias("w_o"))
    rows = lr.unionByName(r.withColumn("w_left", F.lit(None).cast(lr.schema["w_left"].dataType))).withColumn("w_cell", F.floor(axis("w_ts") / cell))
    ends = rows.groupBy(*keys, "w_cell").agg(F.max_by("w_right", F.when(F.col("w_right").isNotNull(), F.col("w_ts"))).alias("w_end"))
    before = Window.partitionBy(*keys).orderBy("w_cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "w_cell", F.last("w_end", ignorenulls=True).over(before).alias("w_in"))
    w = Window.partitionBy(*keys, "w_cell").orderBy("w_ts", "w_o").rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("w_last", F.last("w_right", ignorenulls=True).over(w)).where("w_left is not null")
    same = [F.col(f"w_l.{k}").eqNullSafe(F.col(f"w_e.{k}")) for k in keys] + [F.col("w_l.w_cell").eqNullSafe(F.col("w_e.w_cell"))]
    got = got.alias("w_l").join(ends.alias("w_e"), same, "left").withColumn("w_found", F.coalesce("w_l.w_last", "w_e.w_in"))
    return got.select("w_left.*", *[F.col(f"w_found.{v}").alias(f"{prefix}{v}") for v in values])


def interval_extreme(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, ts: str, value: Column, out: str, largest: bool, cell: int = 86400) -> DataFrame:
    """``left`` and the largest or smallest ``value`` of right rows with ``start <= ts < end``; found once per distinct interval."""
    agg = F.max if largest else F.min
    cells = F.sequence(F.floor(epoch(start) / cell), F.floor(epoch(end) / cell))
    spans = left.where(F.col(start) < F.col(end)).select(*by, F.col(start).alias("w_s"), F.col(end).alias("w_e"), cells.alias("w_cells")).distinct()
    rows = right.select(*by, F.col(ts).alias("w_t"), value.alias("w_v")).withColumn("w_cell", F.floor(epoch("w_t") / cell))
    hit = spans.withColumn("w_cell", F.explode("w_cells")).join(rows, [*by, "w_cell"]).where("w_t >= w_s and w_t < w_e").groupBy(*by, "w_s", "w_e").agg(agg("w_v").alias(out))
    hit = hit.withColumnRenamed("w_s", start).withColumnRenamed("w_e", end)
    return left.join(hit, [*by, start, end], "left")


def first_touch(orders: DataFrame, bars: DataFrame, by: list[str], order_id: str, after: str, until: str | None, touches: Column, bounds: Column, keep: list[str], cells: tuple[int, ...] = (64 * 86400, 8 * 86400, 86400)) -> DataFrame:
    """For each order the first bar with ``ts > after`` (and ``ts <= until``) that ``touches``; ``keep``: bar columns to return.

    ``touches`` is over order and bar columns; ``bounds`` is the same test over a cell's largest ``high`` and smallest ``low``
    (columns ``high`` and ``low``): it must hold wherever a bar of the cell touches, and hold nowhere else.
    Orders meet the summaries of the longest cells of their key first and, level by level, only the cells that may hold the first touch
    are opened: at most two per order and level. ``cells``: lengths in seconds, each a multiple of the next.
    """
    order_cols = [c for c in orders.columns if c not in by]
    b = bars.select(*by, "ts", "open", "high", "low", "close", *[c for c in keep if c not in ("ts", "open", "high", "low", "close")]).withColumn("w_e", epoch("ts"))
    may = orders.select(*by, *order_cols)
    for level, secs in enumerate(cells):
        up = [] if level == 0 else [F.floor(F.col("w_e") / cells[level - 1]).alias("w_cell")]
        summary = b.groupBy(*by, *up, F.floor(F.col("w_e") / secs).alias("w_next")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max("ts").alias("w_last"), F.min("ts").alias("w_first"))
        in_time = F.col("w_last") > F.col(after)
        if until:
            in_time &= F.col(until).isNull() | (F.col("w_first") <= F.col(until))
        may = may.join(summary, [*by, "w_cell"] if level else by).where(in_time & bounds)
        # a whole cell that may touch does touch: later ones are not opened
        sure = F.min(F.when(F.col("w_first") > F.col(after), F.col("w_next"))).over(Window.partitionBy(order_id))
        may = may.withColumn("w_sure", sure).where("w_sure is null or w_next <= w_sure").select(*by, *order_cols, F.col("w_next").alias("w_cell"))
    in_time = F.col("ts") > F.col(after)
    if until:
        in_time &= F.col(until).isNull() | (F.col("ts") <= F.col(until))
    hit = may.join(b.withColumn("w_cell", F.floor(F.col("w_e") / cells[-1])).drop("w_e"), [*by, "w_cell"]).where(in_time & touches)
    return hit.groupBy(order_id).agg(F.min_by(F.struct(*keep), "ts").alias("w_hit")).select(order_id, *[F.col(f"w_hit.{c}").alias(f"hit_{c}") for c in keep])


def sub_bars(clashes: DataFrame, fine: DataFrame, by: list[str], ts: str, secs: int, columns: list[str]) -> DataFrame:
    """Finer bars with ``ts <= sub <= ts + secs`` (the end is included) of some bars, by equal cell of ``secs``."""
    cell = F.floor(epoch(ts) / secs)
    spans = clashes.withColumn("w_cell", F.explode(F.array(cell, cell + 1)))
    rows = fine.select(*by, F.col("ts").alias("sub_ts"), *[F.col(c).alias(f"sub_{c}") for c in columns]).withColumn("w_cell", F.floor(epoch("sub_ts") / secs))
    end = F.expr(f"timestampadd(SECOND, {secs}, {ts})")
    return spans.join(rows, [*by, "w_cell"]).where((F.col("sub_ts") >= F.col(ts)) & (F.col("sub_ts") <= end)).drop("w_cell")
