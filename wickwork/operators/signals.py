"""Signals and patterns as queries, and the few folds that depend on their own past."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.operators import chains, joins, series
from wickwork.schema import KEY
from wickwork.sources.scratch import written

#: Bars of a cell in which candidates are numbered.
NO_CELL = 1 << 16


def sma_cross(base: DataFrame, risk: float = 0.01) -> DataFrame:
    """Entry and exit flags, stop and target from ``fast``, ``slow`` and ``trend`` columns; null averages give none."""
    enter = (F.col("fast") > F.col("slow")) & (F.col("close") > F.col("trend"))
    return base.withColumns({"enter": F.coalesce(enter, F.lit(False)), "leave": F.coalesce(F.col("fast") < F.col("slow"), F.lit(False)), "stop_loss": F.col("close") * 0.98, "take_profit": F.col("close") * 1.04, "risk": F.lit(risk)})


def drop_from_peak(bars: DataFrame, lookback: int, drop: float, by=KEY) -> DataFrame:
    """``peak`` of the last closes, this one included, and ``dropped``."""
    b = series.looking_back(bars, lookback, lambda w: {"peak": F.when(F.col("n") >= lookback, F.max("close").over(w.rowsBetween(1 - lookback, 0)))}, by)
    return b.withColumn("dropped", F.coalesce((F.col("peak") > 0) & ((F.col("peak") - F.col("close")) / F.col("peak") >= drop), F.lit(False)))


def regime(rows: DataFrame, reference: DataFrame, ts: str = "ts", available_at: str = "open", secs: int = 86400) -> DataFrame:
    """``market_ok``: the reference's close is at or above its average as of the row; a missing average is not.

    ``reference``: ts, close, ema of one series. ``available_at='open'`` takes a reference bar from its opening time on (its close is
    then ahead of time where it is the coarser one); ``'close'`` from its end on.
    """
    ref = reference.select(F.lit(1).alias("w_one"), (F.col("ts") if available_at == "open" else F.expr(f"timestampadd(SECOND, {secs}, ts)")).alias("ref_ts"), F.col("close").alias("ref_close"), F.col("ema").alias("ref_ema"))
    # one series as of distinct times, then an equi-join: rows are not gathered in one task
    times = joins.asof(rows.select(F.lit(1).alias("w_one"), F.col(ts).alias("w_at")).distinct(), ref, ["w_one"], "w_at", "ref_ts", ["ref_close", "ref_ema"])
    out = rows.join(times.drop("w_one").withColumnRenamed("w_at", ts), ts, "left")
    return out.withColumn("market_ok", F.coalesce(F.col("ref_close") >= F.col("ref_ema"), F.lit(False)))


def gap_entry(bullish: Column, sl: Column, tp: Column, top: Column, bottom: Column, rr: float) -> Column:
    """Limit price of a gap setup: the level of the wished reward to risk, moved into the gap, or null if it lies beyond."""
    e = (tp + rr * sl) / (rr + 1)
    long = F.when(e > top, top).when(e > bottom, e)
    short = F.when(e < bottom, top).when(e < top, e)
    return F.when(bullish, long).otherwise(short)


def gap_setups(gaps: DataFrame, swings: DataFrame, secs: int, rr: float, by=KEY) -> DataFrame:
    """Setups of gap bars: stop (the last opposite swing at or before the first bar's end), target (the extreme swing inside the pattern) and entry.

    ``gaps``: key, ts (third bar), first_ts, high, low and close of the third bar, trend (a forming average as of it), bullish/bearish, gap_top,
    gap_bottom. ``swings``: key, ts, confirmed_ts, fractal_up, fractal_down, high, low; only those count that the third bar has seen confirmed:
    the swings before it. No setup without stop, target or entry, or against the trend (null: not warm). ``broken``: the third bar itself passes the target.
    """
    g = gaps.where("bullish = 1 or bearish = 1").withColumn("c1_end", F.expr(f"timestampadd(SECOND, {secs}, first_ts)")).withColumn("c3_end", F.expr(f"timestampadd(SECOND, {secs}, ts)"))
    lows, highs = swings.where("fractal_down = 1").select(*by, F.col("ts").alias("swing_ts"), F.col("low").alias("swing_low")), swings.where("fractal_up = 1").select(*by, F.col("ts").alias("swing_ts"), F.col("high").alias("swing_high"))
    # a swing is confirmed by the bar behind it, so that one before the third bar is known there
    g = g.withColumn("w_until", F.least("c1_end", F.expr("timestampadd(MICROSECOND, -1, ts)")))
    g = joins.asof(g, lows, list(by), "w_until", "swing_ts", ["swing_low"])
    g = joins.asof(g, highs, list(by), "w_until", "swing_ts", ["swing_high"])
    g = joins.interval_extreme(g, highs, list(by), "first_ts", "ts", "swing_ts", F.col("swing_high"), "top_in", True)
    g = joins.interval_extreme(g, lows, list(by), "first_ts", "ts", "swing_ts", F.col("swing_low"), "low_in", False)
    bull = F.col("bullish") == 1
    g = g.withColumn("stop_loss", F.when(bull, F.col("swing_low")).otherwise(F.col("swing_high"))).withColumn("take_profit", F.when(bull, F.col("top_in")).otherwise(F.col("low_in")))
    g = g.withColumn("entry", gap_entry(bull, F.col("stop_loss"), F.col("take_profit"), F.col("gap_top"), F.col("gap_bottom"), rr))
    with_trend = F.when(bull, F.col("close") > F.col("trend")).otherwise(F.col("close") < F.col("trend"))
    broken = F.when(bull, F.col("high") > F.col("take_profit")).otherwise(F.col("low") < F.col("take_profit"))
    return g.where(F.col("entry").isNotNull() & with_trend).withColumn("broken", broken).drop("w_until", "high", "low", "close", "trend")


def trading_window(rows: DataFrame, start, needs: dict[str, int]) -> DataFrame:
    """The rows from ``start`` on at which every count of bars seen (a column per timeframe or reference) has reached what its indicators need.

    Rows before feed the indicators and counts only. A null count is a count of none.
    """
    warm = [F.coalesce(F.col(c), F.lit(0)) >= n for c, n in needs.items()]
    return rows.where(reduce(lambda a, b: a & b, warm, F.col("ts") >= start))


def gate(candidates: DataFrame, cooldown: int = 0, by=KEY) -> DataFrame:
    """The candidate trades that a strategy with one position at a time takes, in order of their signal bars.

    ``candidates``: key, trade_id, signal_no and exit_no (bar numbers; the exit null while open), exit_reason. A candidate is taken when
    flat at its signal bar and, after a stop, once ``cooldown`` bars have passed. Exits by signal or time (``fills.signal_closes``,
    ``fills.with_signal_close``) come before: they move ``exit_no``. Each candidate points at the first one that may follow it, and the path
    through these pointers is doubled (``chains.on_path``), so that a key spreads over tasks.
    """
    by = list(by)
    free = F.col("exit_no") + F.when(F.col("exit_reason") == "stop_loss", F.lit(cooldown)).otherwise(F.lit(0))
    rows = series.with_running(candidates.withColumn("w_free", free.cast("long")), tuple(by), ["signal_no", "trade_id"], {"w_rank": F.lit(1).cast("long")}, F.floor(F.col("signal_no") / NO_CELL))
    rows = written(rows.withColumn("w_rank", F.col("w_rank") - 1), "candidates")
    last = rows.groupBy(*by, F.col("signal_no").cast("long").alias("w_no")).agg(F.max("w_rank").alias("w_before"))
    leads = joins.asof(rows.where("w_free is not null").select(*by, "w_rank", "w_free"), last, by, "w_free", "w_no", ["w_before"], strict=True, cell=NO_CELL, axis=F.col)
    leads = leads.select(*by, "w_rank", F.greatest(F.coalesce("w_before", F.lit(-1)) + 1, F.col("w_rank") + 1).alias("w_to"))
    rows = rows.drop("w_free").join(leads, [*by, "w_rank"], "left")
    return chains.on_path(rows, by, "w_rank", "w_to").select(*candidates.columns)


def gap_orders(setups: DataFrame, bars: DataFrame, swings: DataFrame, rr: float, max_renewals: int = 0, by=KEY) -> DataFrame:
    """What becomes of each setup's order: ``filled``, ``tested``, ``expired`` (target passed) or ``resting``, with the bar's time; and its renewals.

    On a bar after the setup's a fill comes first, then a test of the gap, then the target's passing (on the setup's own bar: ``broken``). A
    passed target ends the order or, up to ``max_renewals`` times, leaves it waiting for swings beyond the old target, at or after
    ``c3_end`` and confirmed, whose extreme is the new target; a test ends the waiting. A fill implies a test, so an order's next event is the first
    touch of gap or target, however late; each renewal takes first touches of its own. ``swings`` as for ``gap_setups``.
    """
    by, bull, never = list(by), F.col("bullish") == 1, F.lit(None).cast("timestamp_ntz")
    tested = F.when(bull, F.col("low") <= F.col("gap_top")).otherwise(F.col("high") >= F.col("gap_bottom"))
    passed = F.when(bull, F.col("high") > F.col("take_profit")).otherwise(F.col("low") < F.col("take_profit"))
    fixed = ["setup_id", *by, "bullish", "gap_top", "gap_bottom", "stop_loss", "ts", "c3_end"]
    up, down = F.when(F.col("fractal_up") == 1, F.col("high")), F.when(F.col("fractal_down") == 1, F.col("low"))
    turns = swings.select(*by, "ts", "confirmed_ts", up.alias("high"), down.alias("low"), F.lit(None).cast("double").alias("open"), F.lit(None).cast("double").alias("close"))
    bars = bars.select(*by, "ts", "open", "high", "low", "close")
    active = setups.select(*fixed, "take_profit", "entry", F.col("ts").alias("w_after"), "broken")
    ended: list[DataFrame] = []

    def end(rows: DataFrame, state: Column, at: Column, renewals: int) -> None:
        ended.append(rows.select("setup_id", state.alias("state"), at.alias("state_ts"), F.lit(renewals).alias("renewals")))

    for renewals in range(max_renewals + 1):
        hit = joins.first_touch(active.where("not broken").drop("ts"), bars, by, "setup_id", "w_after", None, tested | passed, tested | passed, ["ts", "high", "low"])
        got = active.join(hit, "setup_id", "left")
        filled = F.when(bull, F.col("hit_low") <= F.col("entry")).otherwise(F.col("hit_high") >= F.col("entry"))
        test = F.when(bull, F.col("hit_low") <= F.col("gap_top")).otherwise(F.col("hit_high") >= F.col("gap_bottom"))
        state = F.when(F.col("broken"), "expired").when(F.col("hit_ts").isNull(), "resting").when(filled, "filled").when(test, "tested").otherwise("expired")
        got = written(got.withColumn("w_state", state).withColumn("w_at", F.when(F.col("broken"), F.col("w_after")).otherwise(F.col("hit_ts"))), "gap-orders")
        last = renewals == max_renewals
        end(got if last else got.where("w_state <> 'expired'"), F.col("w_state"), F.col("w_at"), renewals)
        if last:
            break
        wait = got.where("w_state = 'expired'").select(*fixed, "take_profit", "w_at")
        asked = wait.withColumnRenamed("ts", "w_third")
        of = lambda table, after, touch, keep, name: joins.first_touch(asked, table, by, "setup_id", after, None, touch, touch, [keep]).withColumnRenamed(f"hit_{keep}", name)
        wait = wait.join(of(bars, "w_at", tested, "ts", "tested_ts"), "setup_id", "left").join(of(bars, "w_at", F.lit(True), "ts", "next_ts"), "setup_id", "left")
        wait = wait.join(of(turns, "w_third", passed, "confirmed_ts", "known_ts"), "setup_id", "left")
        again = F.when(F.col("next_ts").isNotNull() & F.col("known_ts").isNotNull(), F.greatest("next_ts", "known_ts"))
        wait = written(wait.withColumn("w_again", again), "gap-waits")
        stays = F.col("tested_ts").isNotNull() & (F.col("w_again").isNull() | (F.col("tested_ts") <= F.col("w_again")))
        end(wait.where(stays), F.lit("tested"), F.col("tested_ts"), renewals)
        end(wait.where(~stays & F.col("w_again").isNull()), F.lit("resting"), never, renewals)
        new = wait.where(~stays & F.col("w_again").isNotNull())
        new = joins.interval_extreme(new, turns.where("high is not null"), by, "c3_end", "w_again", "ts", F.col("high"), "w_top", True, cell=8 * 86400)
        new = joins.interval_extreme(new, turns.where("low is not null"), by, "c3_end", "w_again", "ts", F.col("low"), "w_low", False, cell=8 * 86400)
        new = new.withColumn("take_profit", F.when(bull, F.col("w_top")).otherwise(F.col("w_low")))
        new = written(new.withColumn("entry", gap_entry(bull, F.col("stop_loss"), F.col("take_profit"), F.col("gap_top"), F.col("gap_bottom"), rr)), "gap-renewals")
        end(new.where("entry is null"), F.lit("expired"), F.col("w_again"), renewals)
        active = new.where("entry is not null").select(*fixed, "take_profit", "entry", F.col("w_again").alias("w_after"), F.lit(False).alias("broken"))
    return reduce(DataFrame.unionByName, ended)


def scan(rows: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """A user's strategy over each group (symbol and parameter set): its rows, and an error row for each group that fails.

    ``step`` gets a group's bars in time order with all signal and indicator columns and returns rows of ``schema``.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(key: tuple, group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        head = {c: [v] for c, v in zip(by, key, strict=True)}
        try:
            got = step(group.sort_values("ts").reset_index(drop=True))
            return pd.DataFrame({**{c: [v[0]] * len(got) for c, v in head.items()}, **{n: got[n].to_numpy() for n in names}, "error": [None] * len(got)})
        except Exception as x:  # noqa: BLE001  a failing symbol must not stop the others
            return pd.DataFrame({**head, **{n: [None] for n in names}, "error": [f"{type(x).__name__}: {x}"]})

    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    out = rows.groupBy(*by).applyInPandas(run, f"{keys}, {schema}, error string")
    return out.where("error is null").drop("error"), out.where("error is not null").select(*by, "error")
