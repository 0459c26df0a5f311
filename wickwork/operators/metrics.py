"""Equity metrics and roll-ups over a universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.sessions import epoch
from wickwork.operators import series

#: Seconds of a time cell of one symbol's curve, and of a curve that takes the trades of all symbols.
CELL, POOLED_CELL = 64 * 86400, 6 * 3600


def returns(equity: DataFrame, by: list[str], order: tuple[str, ...] = ("ts",), cell: int = CELL) -> DataFrame:
    """Adds ``ret``, null on the first step and where the equity before is not positive, ``peak`` and ``drawdown`` (a ratio, at most 0).

    ``order`` begins with ``ts`` and tells points of one time apart. Rows are dealt by (curve, time cell); the point and the peak
    before a cell come from a table with one row per cell, so that no task holds a whole curve.
    """
    held = F.struct("equity", epoch("ts").alias("sec"))
    rows = equity.withColumn("w_cell", F.floor(epoch("ts") / cell))
    ends = rows.groupBy(*by, "w_cell").agg(F.max_by(held, F.struct(*order)).alias("w_end"), F.max("equity").alias("w_top"))
    cells = Window.partitionBy(*by).orderBy("w_cell")
    ends = ends.select(*by, "w_cell", F.lag("w_end").over(cells).alias("w_in"), F.max("w_top").over(cells.rowsBetween(Window.unboundedPreceding, -1)).alias("w_peak"))
    inside = Window.partitionBy(*by, "w_cell").orderBy(*order)
    out = rows.withColumn("w_prev", F.lag(held).over(inside)).withColumn("peak", F.max("equity").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(ends, [*by, "w_cell"])
    out = out.withColumn("w_prev", F.coalesce("w_prev", "w_in")).withColumn("peak", F.greatest("peak", "w_peak"))
    out = out.withColumn("ret", F.when(F.col("w_prev.equity") > 0, F.col("equity") / F.col("w_prev.equity") - 1)).withColumn("step_sec", epoch("ts") - F.col("w_prev.sec"))
    out = out.withColumn("drawdown", F.when(F.col("peak") > 0, F.col("equity") / F.col("peak") - 1).otherwise(F.lit(0.0)))
    return out.drop("w_cell", "w_prev", "w_in", "w_peak")


def middle_step(steps: DataFrame, by: list[str]) -> DataFrame:
    """Per curve ``mid_sec``, the upper median of its positive ``step_sec``, read off a histogram of the lengths."""
    lengths = steps.where("step_sec > 0").groupBy(*by, "step_sec").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy(*by).orderBy("step_sec").rowsBetween(Window.unboundedPreceding, 0)
    lengths = lengths.withColumn("w_upto", F.sum("k").over(upto)).withColumn("w_all", F.sum("k").over(Window.partitionBy(*by)))
    return lengths.where("w_upto >= floor(w_all / 2) + 1").groupBy(*by).agg(F.min("step_sec").alias("mid_sec"))


def _from_moments(a: DataFrame, by: list[str]) -> DataFrame:
    """Metrics from points, days, mid_sec, first and last value, mean, deviation and downside of the returns, and the largest drawdown."""
    many = F.col("points") >= 2
    year = F.sqrt(F.when((F.col("points") >= 3) & F.col("mid_sec").isNotNull(), 31557600.0 / F.col("mid_sec")).otherwise(F.lit(252.0)))
    cagr = F.pow(F.col("last") / F.col("first"), 365.25 / F.col("days")) - 1
    return a.select(
        *by,
        F.when(many & (F.col("first") > 0), F.col("last") / F.col("first") - 1).alias("total_return"),
        F.when(many & (F.col("days") >= 1) & (F.col("first") > 0) & (F.col("last") > 0) & (F.abs(cagr) < float("inf")), cagr).alias("cagr"),
        F.when(many & (F.col("sd") > 0), F.col("mean") / F.col("sd") * year).alias("sharpe"),
        F.when(many & (F.col("down") > 0), F.col("mean") / F.col("down") * year).alias("sortino"),
        F.when(many, F.least("max_drawdown", F.lit(0.0))).alias("max_drawdown"),
    )


def sweep_metrics(bars: DataFrame, held: Column, names: list[str], by: list[str]) -> DataFrame:
    """Curve metrics per key and parameter set (``param_id``, one of ``names``), with one row per bar whatever the number of sets.

    ``bars``: key, ts, close; ``held``: an array with each set's position (1: all of the equity long, -1: short, 0: none) from a bar's close to the next one's. The
    sets' positions, returns and equities travel side by side on their bar's row; only the last step, a row per key, is dealt over the sets.
    A bar after a close of 0 has no return; a position that loses everything stays at 0.
    """
    rows = series.with_previous(bars.select(*by, "ts", "close", held.alias("held")), tuple(by), "ts", {"w_close": "close", "w_held": "held", "w_ts": "ts"})
    move = F.when(F.col("w_close") > 0, F.col("close") / F.col("w_close") - 1)
    ids = range(len(names))
    rows = rows.withColumn("step_sec", epoch("ts") - epoch("w_ts"))
    rows = rows.select(*by, "ts", "step_sec", *[(F.get("w_held", F.lit(k)) * move).alias(f"r{k}") for k in ids])
    growth = {f"e{k}": F.ln(F.greatest(1 + F.coalesce(f"r{k}", F.lit(0.0)), F.lit(1e-300))) for k in ids}
    rows = series.with_running(rows, tuple(by), ["ts"], growth)
    rows = series.with_running_max(rows, tuple(by), "ts", {f"p{k}": F.col(f"e{k}") for k in ids})
    each = lambda k: F.struct(
        F.lit(names[k]).alias("param_id"), F.exp(F.max_by(f"e{k}", "ts")).alias("last"), F.avg(f"r{k}").alias("mean"), F.stddev_pop(f"r{k}").alias("sd"),
        F.sqrt(F.avg(F.when(F.col(f"r{k}") < 0, F.col(f"r{k}") * F.col(f"r{k}")))).alias("down"), (F.exp(F.min(F.col(f"e{k}") - F.col(f"p{k}"))) - 1).alias("max_drawdown"),
    )
    a = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), ((F.max(epoch("ts")) - F.min(epoch("ts"))) / 86400.0).alias("days"), *[each(k).alias(f"s{k}") for k in ids])
    a = a.join(middle_step(rows, by), by, "left").select(*by, "points", "days", "mid_sec", F.lit(1.0).alias("first"), F.inline(F.array(*[f"s{k}" for k in ids])))
    return _from_moments(a, [*by, "param_id"])


def curve_metrics(equity: DataFrame, by: list[str], order: tuple[str, ...] = ("ts",), cell: int = CELL) -> DataFrame:
    """total_return, cagr, sharpe, sortino, max_drawdown per curve.

    Steps a year come from the upper median of the positive step lengths, 252 where there are fewer than three points. The median
    is read off a histogram of the lengths.
    """
    r = returns(equity, by, order, cell)
    place = F.struct(*order)
    a = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"), F.min_by("equity", place).alias("first"), F.max_by("equity", place).alias("last"), ((F.max(epoch("ts")) - F.min(epoch("ts"))) / 86400.0).alias("days"),
        F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"), F.sqrt(F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")))).alias("down"), F.min("drawdown").alias("max_drawdown"),
    ).join(middle_step(r, by), by, "left")
    return _from_moments(a, by)


def trade_stats(trades: DataFrame, by: list[str]) -> DataFrame:
    """num_trades, win_rate, profit_factor (infinite without losses)."""
    won, lost = F.sum(F.when(F.col("net_pnl") > 0, F.col("net_pnl")).otherwise(0.0)), F.sum(F.when(F.col("net_pnl") < 0, -F.col("net_pnl")).otherwise(0.0))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_trades"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"),
        F.when(lost > 0, won / lost).otherwise(F.lit(float("inf"))).alias("profit_factor"), F.sum("net_pnl").alias("net_pnl"),
    )


def summary(curves: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """One numeric row per symbol, percentages rounded to two places."""
    pct = lambda c: F.round(F.col(c) * 100, 2)
    return curves.join(stats, by, "left").select(
        *by, pct("total_return").alias("return_pct"), pct("cagr").alias("cagr_pct"), F.round("sharpe", 2).alias("sharpe"), pct("max_drawdown").alias("max_dd_pct"),
        pct("win_rate").alias("win_pct"), F.round("profit_factor", 2).alias("profit_factor"), F.coalesce("num_trades", F.lit(0)).alias("trades"),
    )


def universe_totals(rows: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """symbols, mean return, median Sharpe, share of symbols with a gain, trades; nulls are skipped. With ``failed``, a row for each symbol whose run failed, also errors."""
    totals = rows.agg(
        F.count(F.lit(1)).alias("symbols"), F.avg("total_return").alias("mean_return"), F.median("sharpe").alias("median_sharpe"),
        F.avg((F.col("total_return") > 0).cast("double")).alias("profitable"), F.sum("num_trades").alias("trades"),
    )
    return totals if failed is None else totals.join(failed.agg(F.count(F.lit(1)).alias("errors")))  # one row each


def combined_curve(trades: DataFrame, equity: DataFrame, by: list[str], cell: int = POOLED_CELL) -> DataFrame:
    """The universe's compounding curve: from the sum of first equities, each closed trade multiplies by 1 + net / equity at its entry.

    ``trades``: key, entry_time, exit_time, net_pnl, seq. Products run per time cell and the cells' products in front of them, so
    that no window holds all trades.
    """
    from wickwork.operators.joins import asof

    first = equity.groupBy(*by).agg(F.min_by("equity", "ts").alias("first_equity"), F.min("ts").alias("start"))
    t = asof(trades, equity.select(*by, "ts", "equity"), by, "entry_time", "ts", ["equity"], prefix="entry_").join(first, by)
    base = F.coalesce("entry_equity", "first_equity")
    t = t.withColumn("factor", F.when(base > 0, 1 + F.col("net_pnl") / base)).where("factor is not null")
    t = t.withColumn("w_cell", F.floor(epoch("exit_time") / cell))
    inside = Window.partitionBy("w_cell").orderBy("exit_time", *by, "seq").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("w_in", F.product("factor").over(inside))
    cells = t.groupBy("w_cell").agg(F.product("factor").alias("w_all"))
    before = Window.partitionBy(F.lit(0)).orderBy("w_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("w_cell", F.coalesce(F.product("w_all").over(before), F.lit(1.0)).alias("w_before"))
    total = first.agg(F.sum("first_equity").alias("w_total"), F.min("start").alias("w_start"))
    points = t.join(cells, "w_cell").crossJoin(F.broadcast(total))  # one row
    return points.select(F.col("exit_time").alias("ts"), *by, "seq", (F.col("w_total") * F.col("w_before") * F.col("w_in")).alias("equity"))


def combined_result(trades: DataFrame, equity: DataFrame, by: list[str]) -> DataFrame:
    """One row for the whole universe: the metrics of the combined curve, its first point included, and the statistics of all closed trades pooled.

    ``trades`` and ``equity`` as for ``combined_curve``. Of points at one time the start comes first, then the symbols in order.
    """
    start = equity.groupBy(*by).agg(F.min_by("equity", "ts").alias("first_equity"), F.min("ts").alias("ts")).agg(F.min("ts").alias("ts"), F.sum("first_equity").alias("equity")).where("ts is not null")
    points = combined_curve(trades, equity, by).withColumn("w_rank", F.lit(1)).unionByName(start.withColumn("w_rank", F.lit(0)), allowMissingColumns=True)
    # to a hundredth of a cent, as the curves of single symbols
    points = points.withColumn("equity", F.round("equity", 4)).withColumn("w_run", F.lit(0))
    m = curve_metrics(points, ["w_run"], ("ts", "w_rank", *by, "seq"), POOLED_CELL)
    return m.join(trade_stats(trades.withColumn("w_run", F.lit(0)), ["w_run"]), "w_run", "left").drop("w_run").withColumn("num_trades", F.coalesce("num_trades", F.lit(0)))
