"""Indicators over closed bars: one row per bar, null until enough bars have been seen.

``bars`` have a number ``n`` per series (``numbered``). ``by`` are the columns of a series. All spread a long series over tasks: averages with
memory by chained chunks (``recurrence``), those with a fixed lookback by chunks that hold it (``series.looking_back``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from wickwork.operators import series
from wickwork.operators.recurrence import ema as _ema
from wickwork.operators.recurrence import wilder as _wilder
from wickwork.operators.resample import SERIES
from wickwork.operators.series import looking_back, with_running

OHLCV = ("open", "high", "low", "close", "volume")


def numbered(bars: DataFrame, by=SERIES, order: str = "ts") -> DataFrame:
    return with_running(bars, tuple(by), [order], {"n": F.lit(1)})


def averages(bars: DataFrame, lines: dict[str, tuple[int, str]], by=SERIES) -> DataFrame:
    """Simple averages (name: period, source) that share one shuffle."""
    value = lambda w, p, source: F.when(F.col("n") >= p, F.avg(source).over(w.rowsBetween(1 - p, 0)))
    return looking_back(bars, max(p for p, _ in lines.values()), lambda w: {out: value(w, p, source) for out, (p, source) in lines.items()}, by)


def sma(bars: DataFrame, period: int, source: str = "close", by=SERIES, out: str = "sma") -> DataFrame:
    return averages(bars, {out: (period, source)}, by)


def ema(bars: DataFrame, period: int, source: str = "close", by=SERIES, out: str = "ema") -> DataFrame:
    return _ema(bars, {out: F.col(source)}, "n", period, by)


def _gains(bars: DataFrame, period: int, by) -> DataFrame:
    """``w_up`` and ``w_dn``, the gain and loss of each bar, and their averages ``w_gain`` and ``w_loss``."""
    b = looking_back(bars, 1, lambda w: {"w_ch": F.col("close") - F.lag("close").over(w)}, by).withColumn("w_n1", F.when(F.col("n") > 1, F.col("n") - 1))
    b = b.withColumns({"w_up": F.greatest("w_ch", F.lit(0.0)), "w_dn": F.greatest(-F.col("w_ch"), F.lit(0.0))})
    return _wilder(b, {"w_gain": F.col("w_up"), "w_loss": F.col("w_dn")}, "w_n1", period, by)


def _strength(gain: Column, loss: Column) -> Column:
    return F.when(loss == 0, F.lit(100.0)).when(loss.isNotNull(), 100 - 100 / (1 + gain / loss))


def rsi(bars: DataFrame, period: int = 14, by=SERIES, out: str = "rsi") -> DataFrame:
    b = _gains(bars, period, by)
    return b.withColumn(out, _strength(F.col("w_gain"), F.col("w_loss"))).drop("w_ch", "w_n1", "w_up", "w_dn", "w_gain", "w_loss")


def true_range(bars: DataFrame, by=SERIES, out: str = "true_range") -> DataFrame:
    """From the second bar on."""

    def of(w) -> dict[str, Column]:
        pc = F.lag("close").over(w)
        return {out: F.when(F.col("n") > 1, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))}

    return looking_back(bars, 1, of, by)


def atr(bars: DataFrame, period: int = 14, by=SERIES, out: str = "atr") -> DataFrame:
    b = true_range(bars, by, "w_tr").withColumn("w_n1", F.when(F.col("n") > 1, F.col("n") - 1))
    return _wilder(b, {out: F.col("w_tr")}, "w_n1", period, by).drop("w_tr", "w_n1")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, by=SERIES, keep: bool = False) -> DataFrame:
    """``macd``, ``signal`` (seeded over the first macd values) and ``hist``; with ``keep`` the averages ``w_fast`` and ``w_slow`` stay."""
    b = _ema(_ema(bars, {"w_fast": F.col("close")}, "n", fast, by), {"w_slow": F.col("close")}, "n", slow, by)
    b = b.withColumn("macd", F.col("w_fast") - F.col("w_slow")).withColumn("w_m", F.when(F.col("n") >= slow, F.col("n") - slow + 1))
    b = _ema(b, {"signal": F.col("macd")}, "w_m", signal, by)
    return b.withColumn("hist", F.col("macd") - F.col("signal")).drop(*([] if keep else ["w_fast", "w_slow"]), "w_m")


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0, by=SERIES) -> DataFrame:
    """``lower``, ``middle`` and ``upper``: mean and population deviation of closes."""
    full = F.col("n") >= period
    lines = {"middle": F.avg("close"), "w_sd": F.stddev_pop("close")}
    b = looking_back(bars, period, lambda w: {n: F.when(full, c.over(w.rowsBetween(1 - period, 0))) for n, c in lines.items()}, by)
    return b.withColumn("upper", F.col("middle") + width * F.col("w_sd")).withColumn("lower", F.col("middle") - width * F.col("w_sd")).drop("w_sd")


def fractals(bars: DataFrame, by=SERIES) -> DataFrame:
    """``fractal_up`` and ``fractal_down`` (1.0 or 0.0) of the bar before, known one bar later; null before the third bar."""
    flag = lambda c: F.when(F.col("n") >= 3, c.cast("double"))

    def of(w) -> dict[str, Column]:
        h1, h2, l1, l2 = F.lag("high", 1).over(w), F.lag("high", 2).over(w), F.lag("low", 1).over(w), F.lag("low", 2).over(w)
        return {"fractal_up": flag((h2 < h1) & (F.col("high") <= h1)), "fractal_down": flag((l2 > l1) & (F.col("low") >= l1))}

    return looking_back(bars, 2, of, by)


def fair_value_gap(bars: DataFrame, by=SERIES) -> DataFrame:
    """``bullish`` and ``bearish`` (1.0 or 0.0), ``gap_top`` and ``gap_bottom`` of three bars; null before the third."""
    b = looking_back(bars, 2, lambda w: {"w_h2": F.lag("high", 2).over(w), "w_l2": F.lag("low", 2).over(w)}, by)
    h, lo = F.col("w_h2"), F.col("w_l2")
    full = F.col("n") >= 3
    bull = full & (h < F.col("low"))
    bear = full & ~bull & (lo > F.col("high"))
    return (
        b.withColumn("bullish", F.when(full, bull.cast("double")))
        .withColumn("bearish", F.when(full, bear.cast("double")))
        .withColumn("gap_top", F.when(bull, F.col("low")).when(bear, lo))
        .withColumn("gap_bottom", F.when(bull, h).when(bear, F.col("high")))
        .drop("w_h2", "w_l2")
    )


def _moves(up: Column, down: Column) -> dict[str, Column]:
    """Directional movements from the rise of the high and the fall of the low."""
    return {"w_pdm": F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)), "w_mdm": F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0))}


def _directions(tr: Column, plus: Column, minus: Column) -> tuple[Column, Column, Column]:
    """Directional lines and their difference in percent of their sum."""
    di = lambda c: F.when(tr == 0, F.lit(0.0)).otherwise(100 * c / tr)
    total = di(plus) + di(minus)
    return di(plus), di(minus), F.when(total == 0, F.lit(0.0)).otherwise(100 * F.abs(di(plus) - di(minus)) / total)


def _directed(bars: DataFrame, period: int, by) -> DataFrame:
    """``w_tr``, ``w_pdm``, ``w_mdm`` and their averages ``w_str``, ``w_spdm``, ``w_smdm``; ``w_dx`` and its average ``adx``."""

    def of(b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        moved = {"w_u": lambda w: F.col("high") - F.lag("high").over(w), "w_d": lambda w: F.lag("low").over(w) - F.col("low")}
        return looking_back(true_range(b, keys, "w_tr"), 1, lambda w: {n: c(w) for n, c in moved.items()}, keys)

    b = series.in_chunks(bars, 1, of, tuple(by)).withColumn("w_n1", F.when(F.col("n") > 1, F.col("n") - 1))
    b = b.withColumns(_moves(F.col("w_u"), F.col("w_d")))
    b = _wilder(b, {f"w_s{line}": F.col(f"w_{line}") for line in ("tr", "pdm", "mdm")}, "w_n1", period, by)
    plus, minus, dx = _directions(F.col("w_str"), F.col("w_spdm"), F.col("w_smdm"))
    b = b.withColumns({"plus_di": plus, "minus_di": minus, "w_dx": dx, "w_n2": F.when(F.col("n") > period, F.col("n") - period)})
    return _wilder(b, {"adx": F.col("w_dx")}, "w_n2", period, by).drop("w_n1", "w_n2", "w_u", "w_d")


def adx(bars: DataFrame, period: int = 14, by=SERIES) -> DataFrame:
    """``adx``, ``plus_di`` and ``minus_di``; the directional lines from ``2 * period`` bars on, like ``adx``."""
    b, warm = _directed(bars, period, by), F.col("n") >= 2 * period
    b = b.withColumns({"plus_di": F.when(warm, F.col("plus_di")), "minus_di": F.when(warm, F.col("minus_di")), "adx": F.when(warm, F.least("adx", F.lit(100.0)))})
    return b.drop("w_tr", "w_pdm", "w_mdm", "w_str", "w_spdm", "w_smdm", "w_dx")


def from_function(bars: DataFrame, fn: Callable[[pd.DataFrame], pd.Series | pd.DataFrame], outputs: list[str], lookback: int, by=SERIES, history: int | None = None, rows: int | None = None) -> DataFrame:
    """A user's causal function of a series' OHLCV frame: its columns by position become ``outputs``; NaN and rows before ``lookback`` are null.

    With ``history``, the rows before a row that the function looks at, a series is dealt in chunks of ``rows``, each with the ``history`` rows before it; without it the function gets
    a whole series at once.
    """
    if history is not None:
        return series.in_chunks(bars, history, lambda b, keys: from_function(b, fn, outputs, lookback, keys), tuple(by), rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n").reset_index(drop=True)
        got = fn(pdf[list(OHLCV)])
        got = got.to_frame() if isinstance(got, pd.Series) else got
        for k, name in enumerate(outputs):
            pdf[name] = got.iloc[:, k].astype(float).where(pdf["n"] >= lookback).to_numpy()
        return pdf

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields), *(f"`{o}` double" for o in outputs)])
    return bars.groupBy(*by).applyInPandas(run, schema).withColumns({o: F.when(~F.isnan(o), F.col(o)) for o in outputs})


def forming_function(steps: DataFrame, closed: DataFrame, fn: Callable[[pd.DataFrame], pd.Series | pd.DataFrame], outputs: list[str], lookback: int, by=SERIES) -> DataFrame:
    """A user's function as seen at each base step: called with the last ``lookback - 1`` closed bars and the forming one, the last row is its value.

    Each step meets the window of closed bars that ends one bar before by an equi-join; the windows go through the function batch by batch. Null while fewer bars are
    visible, and for NaN.
    """
    bar = F.struct(*[F.col(c).cast("double").alias(c) for c in OHLCV])
    none = F.array().cast("array<struct<open:double,high:double,low:double,close:double,volume:double>>")
    state = lambda w: {"w_bars": F.collect_list(bar).over(w.rowsBetween(2 - lookback, 0)) if lookback > 1 else none}
    seen = _seen(steps, _numbered_closed(closed), state, by, lookback).withColumn("w_bars", F.when(F.col("bar_no") >= lookback, F.concat(F.coalesce("w_bars", none), F.array(bar))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            values = []
            for bars in pdf["w_bars"]:
                if bars is None:
                    values.append([None] * len(outputs))
                    continue
                got = fn(pd.DataFrame.from_records([tuple(b[c] for c in OHLCV) for b in bars], columns=list(OHLCV)))
                got = got.to_frame() if isinstance(got, pd.Series) else got
                values.append([float(got.iloc[-1, k]) for k in range(len(outputs))])
            pdf = pdf.drop(columns="w_bars")
            for k, name in enumerate(outputs):
                pdf[name] = pd.Series([v[k] for v in values], index=pdf.index, dtype="float64")
            yield pdf

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.select(*by, "bar_no", *[c for c in steps.columns if c not in (*by, "bar_no")]).schema.fields), *(f"`{o}` double" for o in outputs)])
    return seen.mapInPandas(run, schema).withColumns({o: F.when(~F.isnan(o), F.col(o)) for o in outputs})


def forming_sma(steps: DataFrame, closed: DataFrame, period: int, source: str = "close", by=SERIES, out: str = "sma") -> DataFrame:
    """SMA as seen at each base step: the last ``period - 1`` closed bars and the forming one, by a join on the bar before."""
    got = _seen(steps, _numbered_closed(closed), lambda w: {"w_sum": _sum_of(source, period - 1, w)}, by, period)
    return got.withColumn(out, F.when(F.col("bar_no") >= period, (F.coalesce("w_sum", F.lit(0.0)) + F.col(source)) / period)).drop("w_sum")


def forming_ema(steps: DataFrame, closed: DataFrame, period: int, source: str = "close", by=SERIES, out: str = "ema") -> DataFrame:
    """EMA as seen at each base step: one more step from the closed bar before."""
    c = ema(_numbered_closed(closed), period, source, by, "w_ema")
    k = 2.0 / (period + 1)
    got = _seen(steps, c, lambda w: {"w_ema": F.col("w_ema"), "w_sum": _sum_of(source, period - 1, w)}, by, period)
    seed = (F.coalesce("w_sum", F.lit(0.0)) + F.col(source)) / period
    return got.withColumn(out, F.when(F.col("bar_no") == period, seed).when(F.col("bar_no") > period, F.col(source) * k + F.col("w_ema") * (1 - k))).drop("w_sum", "w_ema")


# forming forms: the bar of each base step after the closed bars before it ---------------------------------------


def _seen(steps: DataFrame, closed: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], by, back: int) -> DataFrame:
    """``steps`` with columns (over ``closed``, numbered by ``n``, looking back at most ``back`` bars) of the closed bar before theirs."""

    def of(b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return b.select(*keys, "n", *[c.alias(n) for n, c in columns(Window.partitionBy(*keys).orderBy("n")).items()])

    return steps.join(series.in_chunks(closed, back, of, tuple(by)).withColumn("bar_no", F.col("n") + 1).drop("n"), [*by, "bar_no"], "left")


def _numbered_closed(closed: DataFrame) -> DataFrame:
    return closed.withColumn("n", F.col("bar_no"))


def _stepped(no: Column, period: int, x: Column, before: Column, total: Column, keep: float, weight: float) -> Column:
    """One step of a smoothing: its seed (from the sum of the ``period - 1`` values before) at number ``period``, later from the value before."""
    return F.when(no == period, (F.coalesce(total, F.lit(0.0)) + x) / period).when(no > period, before * keep + x * weight)


def _sum_of(line: str, rows: int, w: WindowSpec) -> Column:
    return F.sum(line).over(w.rowsBetween(1 - rows, 0)) if rows else F.lit(0.0)


def forming_rsi(steps: DataFrame, closed: DataFrame, period: int = 14, by=SERIES, out: str = "rsi") -> DataFrame:
    """RSI as seen at each base step."""
    c = _gains(_numbered_closed(closed), period, by)
    held = lambda w: {"w_pc": F.col("close"), "w_g": F.col("w_gain"), "w_l": F.col("w_loss"), "w_gs": _sum_of("w_up", period - 1, w), "w_ls": _sum_of("w_dn", period - 1, w)}
    got = _seen(steps, c, held, by, period)
    no, change = F.col("bar_no") - 1, F.col("close") - F.col("w_pc")
    step = lambda x, before, total: _stepped(no, period, x, F.col(before), F.col(total), (period - 1) / period, 1 / period)
    gain, loss = step(F.greatest(change, F.lit(0.0)), "w_g", "w_gs"), step(F.greatest(-change, F.lit(0.0)), "w_l", "w_ls")
    return got.withColumn(out, _strength(gain, loss)).drop("w_pc", "w_g", "w_l", "w_gs", "w_ls")


def _range(pc: str) -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col(pc)), F.abs(F.col("low") - F.col(pc)))


def forming_atr(steps: DataFrame, closed: DataFrame, period: int = 14, by=SERIES, out: str = "atr") -> DataFrame:
    """ATR as seen at each base step."""
    c = atr(true_range(_numbered_closed(closed), by, "w_r"), period, by, "w_a")
    got = _seen(steps, c, lambda w: {"w_pc": F.col("close"), "w_b": F.col("w_a"), "w_s": _sum_of("w_r", period - 1, w)}, by, period)
    value = _stepped(F.col("bar_no") - 1, period, _range("w_pc"), F.col("w_b"), F.col("w_s"), (period - 1) / period, 1 / period)
    return got.withColumn(out, value).drop("w_pc", "w_b", "w_s")


def forming_macd(steps: DataFrame, closed: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, by=SERIES) -> DataFrame:
    """``macd``, ``signal`` and ``hist`` as seen at each base step."""
    c = macd(_numbered_closed(closed), fast, slow, signal, by, keep=True)
    sums = {"w_fs": ("close", fast), "w_ss": ("close", slow), "w_ms": ("macd", signal)}
    held = lambda w: {"w_f": F.col("w_fast"), "w_s": F.col("w_slow"), "w_g": F.col("signal"), **{n: _sum_of(line, p - 1, w) for n, (line, p) in sums.items()}}
    got = _seen(steps, c, held, by, max(fast, slow, signal))
    step = lambda no, p, x, before, total: _stepped(no, p, x, F.col(before), F.col(total), 1 - 2.0 / (p + 1), 2.0 / (p + 1))
    no, close = F.col("bar_no"), F.col("close")
    got = got.withColumn("macd", F.when(no >= slow, step(no, fast, close, "w_f", "w_fs") - step(no, slow, close, "w_s", "w_ss")))
    got = got.withColumn("signal", step(no - slow + 1, signal, F.col("macd"), "w_g", "w_ms"))
    return got.withColumn("hist", F.col("macd") - F.col("signal")).drop("w_f", "w_s", "w_g", *sums)


def forming_bollinger(steps: DataFrame, closed: DataFrame, period: int = 20, width: float = 2.0, by=SERIES) -> DataFrame:
    """``lower``, ``middle`` and ``upper`` as seen at each base step."""
    before = lambda w: F.collect_list("close").over(w.rowsBetween(2 - period, 0)) if period > 1 else F.array().cast("array<double>")
    got = _seen(steps, _numbered_closed(closed), lambda w: {"w_v": before(w)}, by, period)
    got = got.withColumn("w_v", F.when(F.col("bar_no") >= period, F.concat(F.coalesce("w_v", F.array().cast("array<double>")), F.array("close"))))
    got = got.withColumn("middle", F.aggregate("w_v", F.lit(0.0), lambda s, v: s + v) / period)
    got = got.withColumn("w_sd", F.sqrt(F.aggregate(F.transform("w_v", lambda v: (v - F.col("middle")) * (v - F.col("middle"))), F.lit(0.0), lambda s, v: s + v) / period))
    return got.withColumn("upper", F.col("middle") + width * F.col("w_sd")).withColumn("lower", F.col("middle") - width * F.col("w_sd")).drop("w_v", "w_sd")


def _two_before(steps: DataFrame, closed: DataFrame, by) -> DataFrame:
    held = lambda w: {"w_h1": F.col("high"), "w_l1": F.col("low"), "w_h2": F.lag("high").over(w), "w_l2": F.lag("low").over(w)}
    return _seen(steps, _numbered_closed(closed), held, by, 1)


def forming_fractals(steps: DataFrame, closed: DataFrame, by=SERIES) -> DataFrame:
    """``fractal_up`` and ``fractal_down`` of the closed bar before the one of each base step."""
    got = _two_before(steps, closed, by)
    flag = lambda c: F.when(F.col("bar_no") >= 3, c.cast("double"))
    up, down = (F.col("w_h2") < F.col("w_h1")) & (F.col("high") <= F.col("w_h1")), (F.col("w_l2") > F.col("w_l1")) & (F.col("low") >= F.col("w_l1"))
    return got.withColumns({"fractal_up": flag(up), "fractal_down": flag(down)}).drop("w_h1", "w_l1", "w_h2", "w_l2")


def forming_fair_value_gap(steps: DataFrame, closed: DataFrame, by=SERIES) -> DataFrame:
    """``bullish``, ``bearish``, ``gap_top`` and ``gap_bottom`` of the bar of each base step and the two closed ones before."""
    got, full = _two_before(steps, closed, by), F.col("bar_no") >= 3
    bull = full & (F.col("w_h2") < F.col("low"))
    bear = full & ~bull & (F.col("w_l2") > F.col("high"))
    top, bottom = F.when(bull, F.col("low")).when(bear, F.col("w_l2")), F.when(bull, F.col("w_h2")).when(bear, F.col("high"))
    return got.withColumns({"bullish": F.when(full, bull.cast("double")), "bearish": F.when(full, bear.cast("double")), "gap_top": top, "gap_bottom": bottom}).drop("w_h1", "w_l1", "w_h2", "w_l2")


def forming_adx(steps: DataFrame, closed: DataFrame, period: int = 14, by=SERIES) -> DataFrame:
    """``adx``, ``plus_di`` and ``minus_di`` as seen at each base step."""
    c = _directed(_numbered_closed(closed), period, by)
    lines = {"tr": "w_str", "pdm": "w_spdm", "mdm": "w_smdm"}
    columns = {"w_ph": "high", "w_pl": "low", "w_pc": "close", "w_pa": "adx"} | {f"w_p{x}": s for x, s in lines.items()}
    sums = {"w_ds": "w_dx"} | {f"w_t{x}": f"w_{x}" for x in lines}
    held = lambda w: {n: F.col(c) for n, c in columns.items()} | {n: _sum_of(c, period - 1, w) for n, c in sums.items()}
    got, no = _seen(steps, c, held, by, period), F.col("bar_no")
    moves = _moves(F.col("high") - F.col("w_ph"), F.col("w_pl") - F.col("low"))
    now = {"tr": _range("w_pc"), "pdm": moves["w_pdm"], "mdm": moves["w_mdm"]}
    step = lambda n, x, before, total: _stepped(n, period, x, F.col(before), F.col(total), (period - 1) / period, 1 / period)
    got = got.withColumns({f"w_n{x}": step(no - 1, v, f"w_p{x}", f"w_t{x}") for x, v in now.items()})
    plus, minus, dx = _directions(F.col("w_ntr"), F.col("w_npdm"), F.col("w_nmdm"))
    warm = no >= 2 * period
    got = got.withColumn("w_dx", dx)
    out = {"plus_di": F.when(warm, plus), "minus_di": F.when(warm, minus), "adx": F.when(warm, F.least(step(no - period, F.col("w_dx"), "w_pa", "w_ds"), F.lit(100.0)))}
    return got.withColumns(out).drop("w_dx", *columns, *sums, *[f"w_n{x}" for x in lines])
