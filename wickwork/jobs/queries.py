"""The registered queries over the driver's tables: name -> job, and name -> DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickwork.functions import sessions, timeframe
from wickwork.jobs import oracle as o
from wickwork.operators import advisor, fills, indicators, joins, metrics, resample, series, signals
from wickwork.schema import KEY, instruments
from wickwork.sources import ingest, ticks
from wickwork.sources.scratch import path, written
from wickwork.streaming import bars as streaming

HOUR, DAY, WEEK = 3600, 86400, 604800
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def job(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, made once: later steps read them more than once."""
    return written(ticks.event_bars(spark, sf_dir, HOUR), "hours")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(indicators.numbered(ticks.event_bars(spark, sf_dir, HOUR)), "numbered")


def _steps(spark: SparkSession, sf_dir: str, tfs: list[int]) -> DataFrame:
    b = _hours(spark, sf_dir)
    return resample.forming(b, instruments(b), tfs, HOUR)


def _out(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


# bars and sessions --------------------------------------------------------------------------------


@job("s4_base_bars", o.sql(o.bars(), final="SELECT * FROM bars"))
def s4_base_bars(spark, sf_dir):
    """Hourly bars from ticks, times in whole seconds."""
    return ticks.event_bars(spark, sf_dir, HOUR)


@job(
    "t1_timeframes",
    """WITH e AS (SELECT event_id, ' ' || (event_id % 61 + 1) || ['m','H','d','W'][event_id % 4 + 1] AS text FROM events),
s AS (SELECT *, (event_id % 61 + 1) * [60, 3600, 86400, 604800][event_id % 4 + 1] AS seconds FROM e)
SELECT event_id, seconds::BIGINT AS seconds, CASE WHEN seconds % 604800 = 0 THEN seconds // 604800 || 'w' WHEN seconds % 86400 = 0 THEN seconds // 86400 || 'd'
 WHEN seconds % 3600 = 0 THEN seconds // 3600 || 'h' ELSE seconds // 60 || 'm' END AS label, seconds % 900 = 0 AS fits_15m, min(seconds) OVER (PARTITION BY event_id % 61)::BIGINT AS finest FROM s""",
)
def t1_timeframes(spark, sf_dir):
    """Timeframe texts to seconds and back, multiples, the finest of a group."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit(" "), (F.col("event_id") % 61 + 1).cast("string"), F.element_at(F.array(*map(F.lit, "mHdW")), (F.col("event_id") % 4 + 1).cast("int"))).alias("text"))
    e = e.withColumn("seconds", timeframe.seconds(F.col("text")))
    finest = F.min("seconds").over(Window.partitionBy(F.col("event_id") % 61))
    return e.select("event_id", "seconds", timeframe.label(F.col("seconds")).alias("label"), timeframe.is_multiple(F.col("seconds"), F.lit(900)).alias("fits_15m"), finest.alias("finest"))


@job(
    "t4_sessions",
    o.sql(
        o.bars(), o.INST,
        "e AS (SELECT event_id, ts, tz, open_sec, close_sec, anchor, epoch_us((ts AT TIME ZONE 'UTC') AT TIME ZONE tz) // 1000000 AS l FROM events JOIN inst ON ticker = event_type)",
        "f AS (SELECT *, l // 86400 * 86400 AS mid FROM e)",
        final="""SELECT event_id, close_sec IS NULL OR ((l // 86400 + 3) % 7 < 5 AND l - mid >= open_sec AND l - mid < close_sec) AS is_open,
 (make_timestamp((mid + open_sec) * 1000000) AT TIME ZONE tz) AT TIME ZONE 'UTC' AS session_open, (make_timestamp((mid + close_sec) * 1000000) AT TIME ZONE tz) AT TIME ZONE 'UTC' AS session_close,
 (CASE WHEN l < mid + coalesce(anchor, 0) THEN mid + anchor - 86400 ELSE mid + coalesce(anchor, 0) END)::BIGINT AS anchor_local FROM f""",
    ),
)
def t4_sessions(spark, sf_dir):
    """Market hours, session bounds in UTC and the trading day's start of every tick."""
    t = ticks.event_ticks(spark, sf_dir)
    t = sessions.with_local(t.join(instruments(t), list(KEY)))
    t = sessions.session_bounds(t.withColumn("is_open", sessions.is_open(t)))
    return t.select(F.col("seq").alias("event_id"), "is_open", "session_open", "session_close", sessions.day_anchor(F.col("local_sec"), F.col("day_anchor_sec")).cast("long").alias("anchor_local"))


@job("t6_bucket_bounds", o.sql(o.bars(), o.INST, o.bounds([900 * 4, 4 * HOUR, DAY, 2 * DAY, WEEK, 2 * WEEK], HOUR), final="SELECT source, ticker, tf_seconds, ts, open_utc, close_utc FROM x5"))
def t6_bucket_bounds(spark, sf_dir):
    """Bucket bounds of every bar for timeframes from an hour to two weeks."""
    b = _hours(spark, sf_dir)
    rows = b.drop("tf_seconds").join(instruments(b), list(KEY)).withColumn("tf_seconds", F.explode(F.array(*[F.lit(t).cast("long") for t in (HOUR, 4 * HOUR, DAY, 2 * DAY, WEEK, 2 * WEEK)])))
    return sessions.bucket_bounds(rows).select(*KEY, "tf_seconds", "ts", "open_utc", "close_utc")


@job(
    "t8_lead_in",
    o.sql(
        o.bars(), o.INST, "g AS (SELECT unnest([20, 50, 200]) AS look, unnest([3600, 14400, 86400]) AS tf)", "h AS (SELECT *, floor(look * (tf // 3600) * 1.2) + 5 AS needed FROM inst, g)",
        "k AS (SELECT source, ticker, max(1.5 * CASE WHEN close_sec IS NULL THEN needed * 3600 ELSE needed * 3600 / greatest((close_sec - open_sec) / 86400.0, 0.05) * 7 / 5 END) AS lead_sec FROM h GROUP BY 1, 2)",
        final="SELECT source, ticker, round(lead_sec, 6) AS lead_sec, count(*) AS bars_read FROM bars JOIN k USING (source, ticker) WHERE ts >= TIMESTAMP '2024-03-01' - to_seconds(floor(lead_sec)::BIGINT) GROUP BY 1, 2, lead_sec",
    ),
)
def t8_lead_in(spark, sf_dir):
    """Seconds of lead-in that a set of lookbacks needs, the earliest winning, and the bars it reads."""
    b = _hours(spark, sf_dir)
    g = instruments(b).select("*", F.inline(F.array(*[F.struct(F.lit(n).alias("look"), F.lit(t).alias("tf")) for n, t in ((20, HOUR), (50, 4 * HOUR), (200, DAY))])))
    lead = g.withColumn("s", timeframe.lead_in_seconds(F.col("look"), F.col("tf"), F.lit(HOUR), F.col("open_sec"), F.col("close_sec"))).groupBy(*KEY).agg(F.max("s").alias("lead_sec"))
    start = F.expr("timestampadd(SECOND, -cast(floor(lead_sec) as bigint), TIMESTAMP_NTZ'2024-03-01 00:00:00')")
    return rounded(b.join(lead, list(KEY)).where(F.col("ts") >= start).groupBy(*KEY, "lead_sec").agg(F.count(F.lit(1)).alias("bars_read")))


TFS = [HOUR, 4 * HOUR, DAY, WEEK]


@job("a2_forming_bars", o.sql(o.bars(), o.steps(TFS, HOUR), final="SELECT * FROM steps"))
def a2_forming_bars(spark, sf_dir):
    """A2, A3, A5: the bar of each timeframe as it stands at every hourly step."""
    return _steps(spark, sf_dir, TFS)


@job("a1_closed_bars", o.sql(o.bars(), o.steps(TFS, HOUR), final="SELECT *, true AS is_closed FROM closed"))
def a1_closed_bars(spark, sf_dir):
    """A1, A5: closed bars of all timeframes."""
    b = _hours(spark, sf_dir)
    return resample.closed(b, instruments(b), TFS, HOUR)


@job("a4_rebuilt_bars", o.sql(o.bars(), o.steps([4 * HOUR, 8 * HOUR, DAY], HOUR), final="SELECT 'rebuilt' AS origin, source, ticker, tf_seconds, ts, open, high, low, close, volume FROM closed UNION ALL SELECT 'native', source, ticker, tf_seconds, ts, open, high, low, close, volume FROM bars"))
def a4_rebuilt_bars(spark, sf_dir):
    """Bars of up to an hour as they are, longer ones rebuilt from hourly bars."""
    b = _hours(spark, sf_dir)
    cols = ["tf_seconds", "ts", "open", "high", "low", "close", "volume"]
    rebuilt = resample.closed(b, instruments(b), [4 * HOUR, 8 * HOUR, DAY], HOUR)
    return b.unionByName(rebuilt, allowMissingColumns=True).select(ingest.route_native(F.col("tf_seconds")).alias("origin"), *KEY, *cols)


@job("a1_long_bars", o.sql(o.order_bars(), o.steps([DAY, 2 * DAY, WEEK, 2 * WEEK], DAY), final="SELECT *, true AS is_closed FROM closed"))
def a1_long_bars(spark, sf_dir):
    """A1 over years of daily bars: two-day, weekly and two-week buckets begin anew each day or Monday."""
    b = ticks.base_bars(ticks.order_ticks(spark, sf_dir), DAY)
    return resample.closed(b, instruments(b), [DAY, 2 * DAY, WEEK, 2 * WEEK], DAY)


# indicators -----------------------------------------------------------------------------------------


def _lines(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df.select(*KEY, "ts", *names))


def _ind(final: str, *ctes: str) -> str:
    return o.sql(o.bars(), o.NUMBERED, *ctes, final=final)


LISTS = f"v AS (SELECT *, list(close) OVER ({o.W}) AS v FROM nb)"


@job("i1_sma", _ind(f"SELECT source, ticker, ts, CASE WHEN n >= 20 THEN round(avg(close) OVER ({o.W} ROWS 19 PRECEDING), 6) END AS sma, CASE WHEN n >= 5 THEN round(avg(volume) OVER ({o.W} ROWS 4 PRECEDING), 6) END AS volume_sma FROM nb"))
def i1_sma(spark, sf_dir):
    """I1."""
    return _lines(indicators.averages(_numbered(spark, sf_dir), {"sma": (20, "close"), "volume_sma": (5, "volume")}), "sma", "volume_sma")


@job("i2_ema", _ind(f"SELECT source, ticker, ts, CASE WHEN n >= 20 THEN round({o.ema('v', 20)}, 6) END AS ema, CASE WHEN n >= 200 THEN round({o.ema('v', 200)}, 6) END AS slow_ema FROM v", LISTS))
def i2_ema(spark, sf_dir):
    """I2."""
    return _lines(indicators.ema(indicators.ema(_numbered(spark, sf_dir), 20), 200, out="slow_ema"), "ema", "slow_ema")


CHANGES = f"c AS (SELECT *, close - lag(close) OVER ({o.W}) AS ch FROM nb)"
RSI = f"g AS (SELECT *, list(greatest(ch, 0)) FILTER (WHERE ch IS NOT NULL) OVER ({o.W}) AS up, list(greatest(-ch, 0)) FILTER (WHERE ch IS NOT NULL) OVER ({o.W}) AS dn FROM c)"


@job("i3_rsi", _ind("SELECT source, ticker, ts, round(CASE WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + u / d) END, 6) AS rsi FROM h", CHANGES, RSI, f"h AS (SELECT *, CASE WHEN n >= 15 THEN {o.wilder('up', 14)} END AS u, CASE WHEN n >= 15 THEN {o.wilder('dn', 14)} END AS d FROM g)"))
def i3_rsi(spark, sf_dir):
    """I3."""
    return _lines(indicators.rsi(_numbered(spark, sf_dir)), "rsi")


TR = f"t AS (SELECT *, CASE WHEN n > 1 THEN greatest(high - low, abs(high - lag(close) OVER k), abs(low - lag(close) OVER k)) END AS tr FROM nb WINDOW k AS ({o.W}))"


@job("i4_atr", _ind(f"SELECT source, ticker, ts, round(tr, 6) AS true_range, CASE WHEN n >= 15 THEN round({o.wilder('l', 14)}, 6) END AS atr FROM (SELECT *, list(tr) FILTER (WHERE tr IS NOT NULL) OVER ({o.W}) AS l FROM t)", TR))
def i4_atr(spark, sf_dir):
    """I4, I11."""
    return _lines(indicators.atr(indicators.true_range(_numbered(spark, sf_dir))), "true_range", "atr")


@job(
    "i5_macd",
    _ind(
        "SELECT source, ticker, ts, round(macd, 6) AS macd, round(signal, 6) AS signal, round(macd - signal, 6) AS hist FROM s", LISTS,
        f"m AS (SELECT *, CASE WHEN n >= 26 THEN {o.ema('v', 12)} - {o.ema('v', 26)} END AS macd FROM v)", f"ml AS (SELECT *, list(macd) FILTER (WHERE macd IS NOT NULL) OVER ({o.W}) AS l FROM m)",
        f"s AS (SELECT *, CASE WHEN n >= 34 THEN {o.ema('l', 9)} END AS signal FROM ml)",
    ),
)
def i5_macd(spark, sf_dir):
    """I5."""
    return _lines(indicators.macd(_numbered(spark, sf_dir)), "macd", "signal", "hist")


@job("i6_bollinger", _ind(f"SELECT source, ticker, ts, round(m - 2 * s, 6) AS lower, round(m, 6) AS middle, round(m + 2 * s, 6) AS upper FROM (SELECT *, CASE WHEN n >= 20 THEN avg(close) OVER w END AS m, CASE WHEN n >= 20 THEN stddev_pop(close) OVER w END AS s FROM nb WINDOW w AS ({o.W} ROWS 19 PRECEDING))"))
def i6_bollinger(spark, sf_dir):
    """I6."""
    return _lines(indicators.bollinger(_numbered(spark, sf_dir)), "lower", "middle", "upper")


FRACTAL = f"""fr AS (SELECT *, CASE WHEN n >= 3 THEN (lag(high, 2) OVER k < lag(high) OVER k AND high <= lag(high) OVER k)::INT::DOUBLE END AS fractal_up,
 CASE WHEN n >= 3 THEN (lag(low, 2) OVER k > lag(low) OVER k AND low >= lag(low) OVER k)::INT::DOUBLE END AS fractal_down FROM nb WINDOW k AS ({o.W}))"""
GAPS = f"""ga AS (SELECT source, ticker, tf_seconds, n, ts, low, high, lag(ts, 2) OVER k AS first_ts, lag(high, 2) OVER k AS h2, lag(low, 2) OVER k AS l2 FROM nb WINDOW k AS ({o.W})),
gap AS (SELECT *, CASE WHEN n >= 3 THEN (h2 < low)::INT::DOUBLE END AS bullish, CASE WHEN n >= 3 THEN (NOT h2 < low AND l2 > high)::INT::DOUBLE END AS bearish,
 CASE WHEN n < 3 THEN NULL WHEN h2 < low THEN low WHEN l2 > high THEN l2 END AS gap_top, CASE WHEN n < 3 THEN NULL WHEN h2 < low THEN h2 WHEN l2 > high THEN high END AS gap_bottom FROM ga)"""


@job("i7_fractals", _ind("SELECT source, ticker, ts, fractal_up, fractal_down FROM fr", FRACTAL))
def i7_fractals(spark, sf_dir):
    """I7."""
    return _lines(indicators.fractals(_numbered(spark, sf_dir)), "fractal_up", "fractal_down")


@job("i8_fair_value_gap", _ind("SELECT source, ticker, ts, bullish, bearish, gap_top, gap_bottom FROM gap", GAPS))
def i8_fair_value_gap(spark, sf_dir):
    """I8."""
    return _lines(indicators.fair_value_gap(_numbered(spark, sf_dir)), "bullish", "bearish", "gap_top", "gap_bottom")


@job(
    "i9_adx",
    _ind(
        "SELECT source, ticker, ts, CASE WHEN n >= 28 THEN round(%s, 6) END AS adx, CASE WHEN n >= 28 THEN round(pdi, 6) END AS plus_di, CASE WHEN n >= 28 THEN round(mdi, 6) END AS minus_di FROM q" % o.wilder("dxs", 14), TR,
        f"d AS (SELECT *, high - lag(high) OVER k AS up, lag(low) OVER k - low AS dn FROM t WINDOW k AS ({o.W}))",
        f"l AS (SELECT *, list(tr) FILTER (WHERE n > 1) OVER k AS a, list(CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END::DOUBLE) FILTER (WHERE n > 1) OVER k AS b, list(CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END::DOUBLE) FILTER (WHERE n > 1) OVER k AS c FROM d WINDOW k AS ({o.W}))",
        f"w AS (SELECT *, CASE WHEN n >= 15 THEN {o.wilder('a', 14)} END AS sa, CASE WHEN n >= 15 THEN {o.wilder('b', 14)} END AS sb, CASE WHEN n >= 15 THEN {o.wilder('c', 14)} END AS sc FROM l)",
        "i AS (SELECT *, CASE WHEN sa = 0 THEN 0 ELSE 100 * sb / sa END AS pdi, CASE WHEN sa = 0 THEN 0 ELSE 100 * sc / sa END AS mdi FROM w)",
        f"q AS (SELECT *, list(CASE WHEN pdi + mdi = 0 THEN 0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END::DOUBLE) FILTER (WHERE n >= 15) OVER ({o.W}) AS dxs FROM i)",
    ),
)
def i9_adx(spark, sf_dir):
    """I9."""
    return _lines(indicators.adx(_numbered(spark, sf_dir)), "adx", "plus_di", "minus_di")


@job("i10_library_function", _ind(f"SELECT source, ticker, ts, CASE WHEN n >= 10 THEN round(max(high) OVER w, 6) END AS top, CASE WHEN n >= 10 THEN round(min(low) OVER w, 6) END AS bottom FROM nb WINDOW w AS ({o.W} ROWS 9 PRECEDING)"))
def i10_library_function(spark, sf_dir):
    """A user's pandas function (here a ten-bar channel, which looks back nine bars) over chunks of each series."""

    def channel(bars: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"hi": bars["high"].rolling(10).max(), "lo": bars["low"].rolling(10).min()})

    return _lines(indicators.from_function(_numbered(spark, sf_dir), channel, ["top", "bottom"], 10, history=9), "top", "bottom")


@job(
    "i2_forming_averages",
    o.sql(
        o.bars(), o.steps([4 * HOUR], HOUR), f"cl AS (SELECT *, bar_no + 1 AS nx, list(close) OVER (PARTITION BY source, ticker, tf_seconds ORDER BY bar_no) AS v FROM closed)",
        f"""st AS (SELECT s.*, c.v, CASE WHEN len(c.v) >= 20 THEN {o.ema('c.v', 20)} END AS e FROM steps s LEFT JOIN cl c ON s.source = c.source AND s.ticker = c.ticker AND s.tf_seconds = c.tf_seconds AND s.bar_no = c.nx)""",
        final="""SELECT source, ticker, step, bar_no, CASE WHEN bar_no >= 20 THEN round((list_sum(v[-19:]) + close) / 20, 6) END AS sma,
 round(CASE WHEN bar_no = 20 THEN (list_sum(v[-19:]) + close) / 20 WHEN bar_no > 20 THEN close * (2.0 / 21)::DOUBLE + e * (1 - 2.0::DOUBLE / 21) END, 6) AS ema FROM st""".replace("(2.0 / 21)::DOUBLE", "(2.0::DOUBLE / 21)"),
    ),
)
def i2_forming_averages(spark, sf_dir):
    """I1 and I2 in their forming form: four-hour averages as seen at every hourly step."""
    steps = written(_steps(spark, sf_dir, [4 * HOUR]), "steps")
    closed = resample.bars_of(steps).where("is_closed")
    out = indicators.forming_ema(indicators.forming_sma(steps, closed, 20), closed, 20)
    return rounded(out.select(*KEY, "step", "bar_no", "sma", "ema"))


#: The closed bars of each series and the bar of each step behind them, as lists: every value is computed anew over its whole history.
HISTORY = (
    o.bars(), o.steps([4 * HOUR], HOUR),
    "cl AS (SELECT *, list(close) OVER w AS v, list(high) OVER w AS vh, list(low) OVER w AS vl FROM closed WINDOW w AS (PARTITION BY source, ticker, tf_seconds ORDER BY bar_no))",
    """fs AS (SELECT s.source, s.ticker, s.step, s.bar_no, list_append(coalesce(c.v, []), s.close) AS v, list_append(coalesce(c.vh, []), s.high) AS vh, list_append(coalesce(c.vl, []), s.low) AS vl
 FROM steps s LEFT JOIN cl c ON s.source = c.source AND s.ticker = c.ticker AND s.tf_seconds = c.tf_seconds AND s.bar_no = c.bar_no + 1)""",
)
RANGES = "[greatest(vh[i] - vl[i], abs(vh[i] - v[i - 1]), abs(vl[i] - v[i - 1])) for i in range(2, len(v) + 1)]"


def _forming(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Four-hour bars as they stand at every hourly step, and the closed ones."""
    steps = written(_steps(spark, sf_dir, [4 * HOUR]), "steps")
    return steps, written(resample.bars_of(steps).where("is_closed"), "closed")


def _step_lines(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df.select(*KEY, "step", *names))


@job(
    "i3_forming_rsi",
    o.sql(
        *HISTORY, "ch AS (SELECT *, [greatest(v[i] - v[i - 1], 0) for i in range(2, len(v) + 1)] AS up, [greatest(v[i - 1] - v[i], 0) for i in range(2, len(v) + 1)] AS dn FROM fs)",
        f"h AS (SELECT *, CASE WHEN bar_no >= 15 THEN {o.wilder('up', 14)} END AS u, CASE WHEN bar_no >= 15 THEN {o.wilder('dn', 14)} END AS d FROM ch)",
        final="SELECT source, ticker, step, round(CASE WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + u / d) END, 6) AS rsi FROM h",
    ),
)
def i3_forming_rsi(spark, sf_dir):
    """I3 in its forming form."""
    return _step_lines(indicators.forming_rsi(*_forming(spark, sf_dir)), "rsi")


@job("i4_forming_atr", o.sql(*HISTORY, f"r AS (SELECT *, {RANGES} AS l FROM fs)", final=f"SELECT source, ticker, step, CASE WHEN bar_no >= 15 THEN round({o.wilder('l', 14)}, 6) END AS atr FROM r"))
def i4_forming_atr(spark, sf_dir):
    """I4 in its forming form."""
    return _step_lines(indicators.forming_atr(*_forming(spark, sf_dir)), "atr")


@job(
    "i5_forming_macd",
    o.sql(
        *HISTORY, f"mc AS (SELECT source, ticker, bar_no, CASE WHEN bar_no >= 26 THEN {o.ema('v', 12)} - {o.ema('v', 26)} END AS macd FROM cl)",
        "ml AS (SELECT source, ticker, bar_no + 1 AS bar_no, list(macd) FILTER (WHERE macd IS NOT NULL) OVER (PARTITION BY source, ticker ORDER BY bar_no) AS l FROM mc)",
        f"mf AS (SELECT *, CASE WHEN bar_no >= 26 THEN {o.ema('v', 12)} - {o.ema('v', 26)} END AS macd FROM fs)", "mj AS (SELECT mf.source, mf.ticker, step, mf.bar_no, macd, list_append(coalesce(l, []), macd) AS l FROM mf LEFT JOIN ml USING (source, ticker, bar_no))",
        f"ms AS (SELECT *, CASE WHEN bar_no >= 34 THEN {o.ema('l', 9)} END AS signal FROM mj)",
        final="SELECT source, ticker, step, round(macd, 6) AS macd, round(signal, 6) AS signal, round(macd - signal, 6) AS hist FROM ms",
    ),
)
def i5_forming_macd(spark, sf_dir):
    """I5 in its forming form."""
    return _step_lines(indicators.forming_macd(*_forming(spark, sf_dir)), "macd", "signal", "hist")


@job("i6_forming_bollinger", o.sql(*HISTORY, "b AS (SELECT *, CASE WHEN bar_no >= 20 THEN list_avg(v[-20:]) END AS m, CASE WHEN bar_no >= 20 THEN list_stddev_pop(v[-20:]) END AS s FROM fs)", final="SELECT source, ticker, step, round(m - 2 * s, 6) AS lower, round(m, 6) AS middle, round(m + 2 * s, 6) AS upper FROM b"))
def i6_forming_bollinger(spark, sf_dir):
    """I6 in its forming form."""
    return _step_lines(indicators.forming_bollinger(*_forming(spark, sf_dir)), "lower", "middle", "upper")


@job("i7_forming_fractals", o.sql(*HISTORY, final="SELECT source, ticker, step, CASE WHEN bar_no >= 3 THEN (vh[-3] < vh[-2] AND vh[-1] <= vh[-2])::INT::DOUBLE END AS fractal_up, CASE WHEN bar_no >= 3 THEN (vl[-3] > vl[-2] AND vl[-1] >= vl[-2])::INT::DOUBLE END AS fractal_down FROM fs"))
def i7_forming_fractals(spark, sf_dir):
    """I7 in its forming form."""
    return _step_lines(indicators.forming_fractals(*_forming(spark, sf_dir)), "fractal_up", "fractal_down")


@job(
    "i8_forming_gaps",
    o.sql(
        *HISTORY, "g AS (SELECT *, bar_no >= 3 AS f, vh[-3] < vl[-1] AS bull, NOT vh[-3] < vl[-1] AND vl[-3] > vh[-1] AS bear FROM fs)",
        final="SELECT source, ticker, step, CASE WHEN f THEN bull::INT::DOUBLE END AS bullish, CASE WHEN f THEN bear::INT::DOUBLE END AS bearish, CASE WHEN f AND bull THEN vl[-1] WHEN f AND bear THEN vl[-3] END AS gap_top, CASE WHEN f AND bull THEN vh[-3] WHEN f AND bear THEN vh[-1] END AS gap_bottom FROM g",
    ),
)
def i8_forming_gaps(spark, sf_dir):
    """I8 in its forming form."""
    return _step_lines(indicators.forming_fair_value_gap(*_forming(spark, sf_dir)), "bullish", "bearish", "gap_top", "gap_bottom")


@job(
    "i9_forming_adx",
    o.sql(
        *HISTORY, "al AS (SELECT source, ticker, NULL::TIMESTAMP AS step, bar_no, v, vh, vl FROM cl UNION ALL SELECT source, ticker, step, bar_no, v, vh, vl FROM fs)",
        f"""mv AS (SELECT *, {RANGES} AS a, [CASE WHEN vh[i] - vh[i - 1] > vl[i - 1] - vl[i] AND vh[i] > vh[i - 1] THEN vh[i] - vh[i - 1] ELSE 0 END for i in range(2, len(v) + 1)] AS b,
 [CASE WHEN vl[i - 1] - vl[i] > vh[i] - vh[i - 1] AND vl[i - 1] > vl[i] THEN vl[i - 1] - vl[i] ELSE 0 END for i in range(2, len(v) + 1)] AS c FROM al)""",
        f"sm AS (SELECT source, ticker, step, bar_no, {o.wilder('a', 14)} AS sa, {o.wilder('b', 14)} AS sb, {o.wilder('c', 14)} AS sc FROM mv WHERE bar_no >= 15)",
        "di AS (SELECT *, CASE WHEN sa = 0 THEN 0 ELSE 100 * sb / sa END AS pdi, CASE WHEN sa = 0 THEN 0 ELSE 100 * sc / sa END AS mdi FROM sm)", "dx AS (SELECT *, (CASE WHEN pdi + mdi = 0 THEN 0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END)::DOUBLE AS dx FROM di)",
        "dl AS (SELECT source, ticker, bar_no + 1 AS bar_no, list(dx) OVER (PARTITION BY source, ticker ORDER BY bar_no) AS l FROM dx WHERE step IS NULL)",
        "dj AS (SELECT dx.* EXCLUDE (dx), list_append(coalesce(l, []), dx) AS l FROM dx LEFT JOIN dl USING (source, ticker, bar_no) WHERE step IS NOT NULL)",
        final=f"SELECT fs.source, fs.ticker, fs.step, CASE WHEN fs.bar_no >= 28 THEN round({o.wilder('l', 14)}, 6) END AS adx, CASE WHEN fs.bar_no >= 28 THEN round(pdi, 6) END AS plus_di, CASE WHEN fs.bar_no >= 28 THEN round(mdi, 6) END AS minus_di FROM fs LEFT JOIN dj USING (source, ticker, step)",
    ),
)
def i9_forming_adx(spark, sf_dir):
    """I9 in its forming form."""
    return _step_lines(indicators.forming_adx(*_forming(spark, sf_dir)), "adx", "plus_di", "minus_di")


# joins ------------------------------------------------------------------------------------------------

REF = """ref AS (SELECT ts, close, row_number() OVER (ORDER BY ts) AS n, avg(close) OVER (ORDER BY ts ROWS 1 PRECEDING) AS sma FROM ref_bars)"""


@job(
    "j1_reference_asof",
    o.sql(
        o.bars(), o.bars(DAY, "'all'", "ref_bars"), REF,
        final="""SELECT b.source, b.ticker, b.ts, round(r.close, 6) AS ref_close, round(r.sma, 6) AS ref_sma, round(c.close, 6) AS safe_close FROM bars b
 ASOF LEFT JOIN ref r ON b.ts >= r.ts ASOF LEFT JOIN (SELECT ts + INTERVAL 1 DAY AS t, close FROM ref) c ON b.ts >= c.t""",
    ),
)
def j1_reference_asof(spark, sf_dir):
    """The market's daily bar as of every hourly bar of each symbol, from its opening time and, safely, from its end on."""
    b = _hours(spark, sf_dir)
    t = ticks.event_ticks(spark, sf_dir).withColumn("ticker", F.lit("all"))
    ref = indicators.sma(indicators.numbered(ticks.base_bars(t, DAY)), 1)
    ref = series.looking_back(ref, 1, lambda w: {"ema": F.avg("close").over(w.rowsBetween(-1, 0))}, KEY)
    ref = written(ref.select("ts", "close", "ema"), "reference")
    out = signals.regime(b, ref).select(*KEY, "ts", "ref_close", F.col("ref_ema").alias("ref_sma"))
    safe = signals.regime(b, ref, available_at="close", secs=DAY).select(*KEY, "ts", F.col("ref_close").alias("safe_close"))
    return rounded(out.join(safe, [*KEY, "ts"]))


SWINGS = """sw AS (SELECT source, ticker, ts, n, lag(ts) OVER k AS swing_ts, lag(low) OVER k AS low, lag(high) OVER k AS high, fractal_up, fractal_down FROM fr WINDOW k AS (PARTITION BY source, ticker, tf_seconds ORDER BY n))"""


def _swings(bars: DataFrame) -> DataFrame:
    """Confirmed swings: the bar before the one that confirms it."""

    def of(b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return series.looking_back(indicators.fractals(b, keys), 2, lambda w: {f"before_{c}": F.lag(c).over(w) for c in ("ts", "low", "high")}, keys)

    f = series.in_chunks(bars, 2, of, KEY)
    return f.select(*KEY, F.col("before_ts").alias("ts"), F.col("ts").alias("confirmed_ts"), F.col("before_low").alias("low"), F.col("before_high").alias("high"), "fractal_up", "fractal_down").where("fractal_up = 1 or fractal_down = 1")


@job(
    "j2_swings",
    _ind(
        """SELECT b.source, b.ticker, b.ts, l.low AS last_low, (SELECT max(s.high) FROM sw s WHERE s.fractal_up = 1 AND s.source = b.source AND s.ticker = b.ticker AND s.swing_ts >= b.ts - INTERVAL 12 HOUR AND s.swing_ts < b.ts) AS top_12h,
 (SELECT max(s.high) FROM sw s WHERE s.fractal_up = 1 AND s.source = b.source AND s.ticker = b.ticker AND s.swing_ts >= b.ts AND s.swing_ts < b.ts + INTERVAL 1 DAY AND s.high > b.high) AS beyond_1d
 FROM nb b ASOF LEFT JOIN (SELECT * FROM sw WHERE fractal_down = 1) l ON b.source = l.source AND b.ticker = l.ticker AND b.ts >= l.ts""",
        FRACTAL, SWINGS,
    ),
)
def j2_swings(spark, sf_dir):
    """Per bar the last swing low that it has seen confirmed, the highest swing of the twelve hours before, and the next day's highest beyond its own high."""
    b = _numbered(spark, sf_dir)
    s = written(_swings(b), "swings")
    lows, highs = s.where("fractal_down = 1").select(*KEY, "confirmed_ts", F.col("low").alias("last_low")), s.where("fractal_up = 1").select(*KEY, F.col("ts").alias("swing_ts"), F.col("high").alias("swing_high"))
    out = joins.asof(b.select(*KEY, "ts", "high"), lows, list(KEY), "ts", "confirmed_ts", ["last_low"])
    out = out.withColumn("from_ts", F.expr("ts - INTERVAL '12' HOUR")).withColumn("to_ts", F.expr("ts + INTERVAL '1' DAY"))
    out = joins.interval_extreme(out, highs, list(KEY), "from_ts", "ts", "swing_ts", F.col("swing_high"), "top_12h", True)
    out = joins.interval_extreme(out, highs, list(KEY), "ts", "to_ts", "swing_ts", F.col("swing_high"), "top_1d", True)
    # the largest of the day lies beyond the bar's high or none does
    return out.select(*KEY, "ts", "last_low", "top_12h", F.when(F.col("top_1d") > F.col("high"), F.col("top_1d")).alias("beyond_1d"))


@job(
    "j6_sub_bars",
    o.sql(o.bars(), o.bars(900, name="fine"), final="SELECT b.source, b.ticker, b.ts, count(*) AS subs, max(f.ts) AS last_sub, max(f.high) AS high FROM bars b JOIN fine f ON b.source = f.source AND b.ticker = f.ticker AND f.ts >= b.ts AND f.ts <= b.ts + INTERVAL 1 HOUR WHERE b.high - b.low > 50 GROUP BY 1, 2, 3"),
)
def j6_sub_bars(spark, sf_dir):
    """The quarter-hour bars of wide hourly bars, the next hour's first one included."""
    wide = _hours(spark, sf_dir).where("high - low > 50").select(*KEY, "ts")
    s = joins.sub_bars(wide, ticks.event_bars(spark, sf_dir, 900), list(KEY), "ts", HOUR, ["high"])
    return s.groupBy(*KEY, "ts").agg(F.count(F.lit(1)).alias("subs"), F.max("sub_ts").alias("last_sub"), F.max("sub_high").alias("high"))


# trades -------------------------------------------------------------------------------------------------
# Every bar that a bar follows makes a candidate trade, up or down by its own direction.

TRADES = f"""nx AS (SELECT *, lead(ts) OVER k AS next_ts, lead(open) OVER k AS next_open FROM nb WINDOW k AS ({o.W})),
tr AS (SELECT source || ':' || ticker || ':' || n AS trade_id, source, ticker, n, ts AS signal_ts, close AS ref, CASE WHEN close >= open THEN 'buy' ELSE 'sell' END AS side, next_ts AS entry_time, next_open AS entry_price,
 CASE WHEN close >= open THEN close * 0.5 ELSE close * 1.5 END AS stop_loss, CASE WHEN close >= open THEN close * 2 ELSE close * 0.25 END AS take_profit FROM nx WHERE next_ts IS NOT NULL AND next_open > 0)"""
EXITS = """hit AS (SELECT t.trade_id, min(b.ts) AS x FROM tr t JOIN nb b ON t.source = b.source AND t.ticker = b.ticker AND b.ts > t.entry_time
 AND (CASE WHEN side = 'buy' THEN b.low <= stop_loss OR b.high >= take_profit ELSE b.high >= stop_loss OR b.low <= take_profit END) GROUP BY 1),
ex0 AS (SELECT t.*, b.ts AS exit_time, b.open AS xo, b.n AS exit_no, CASE WHEN side = 'buy' THEN b.low <= stop_loss ELSE b.high >= stop_loss END AS s, CASE WHEN side = 'buy' THEN b.high >= take_profit ELSE b.low <= take_profit END AS p
 FROM tr t LEFT JOIN hit USING (trade_id) LEFT JOIN nb b ON b.source = t.source AND b.ticker = t.ticker AND b.ts = hit.x),
sub AS (SELECT e.trade_id, min_by(CASE WHEN CASE WHEN side = 'buy' THEN f.low <= stop_loss ELSE f.high >= stop_loss END THEN 'stop_loss' ELSE 'take_profit' END, f.ts) AS fine_reason
 FROM ex0 e JOIN fine f ON e.source = f.source AND e.ticker = f.ticker AND f.ts >= e.exit_time AND f.ts <= e.exit_time + INTERVAL 1 HOUR WHERE e.s AND e.p
 AND CASE WHEN side = 'buy' THEN f.low <= stop_loss OR f.high >= take_profit ELSE f.high >= stop_loss OR f.low <= take_profit END GROUP BY 1),
ex1 AS (SELECT *, CASE WHEN s AND p THEN coalesce(fine_reason, 'stop_loss') WHEN s THEN 'stop_loss' WHEN p THEN 'take_profit' END AS exit_reason FROM ex0 LEFT JOIN sub USING (trade_id)),
ex AS (SELECT *, CASE exit_reason WHEN 'stop_loss' THEN CASE WHEN side = 'buy' THEN least(stop_loss, xo) ELSE greatest(stop_loss, xo) END
 WHEN 'take_profit' THEN CASE WHEN side = 'buy' THEN greatest(take_profit, xo) ELSE least(take_profit, xo) END END AS exit_price FROM ex1)"""
TRADE_BASE = (o.bars(), o.bars(900, name="fine"), o.NUMBERED, TRADES, EXITS)


def _trades(bars: DataFrame) -> DataFrame:
    up = F.col("close") >= F.col("open")
    b = fills.with_next(bars).where("next_ts is not null and next_open > 0")
    return b.select(
        F.concat_ws(":", *KEY, F.col("n").cast("string")).alias("trade_id"), *KEY, "n", F.col("ts").alias("signal_ts"), F.col("close").alias("ref"), F.when(up, "buy").otherwise("sell").alias("side"),
        F.col("next_ts").alias("entry_time"), F.col("next_open").alias("entry_price"), F.when(up, F.col("close") * 0.5).otherwise(F.col("close") * 1.5).alias("stop_loss"), F.when(up, F.col("close") * 2).otherwise(F.col("close") * 0.25).alias("take_profit"),
    )


def _exited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = _numbered(spark, sf_dir)
    return bars, written(fills.bracket_exits(_trades(bars), bars, KEY, ticks.event_bars(spark, sf_dir, 900), HOUR), "exits")


@job("f1_market_fills", o.sql(*TRADE_BASE[:4], final="SELECT trade_id, side, signal_ts, entry_time, entry_price FROM tr"))
def f1_market_fills(spark, sf_dir):
    """market orders fill at the next bar's open."""
    return _trades(_numbered(spark, sf_dir)).select("trade_id", "side", "signal_ts", "entry_time", "entry_price")


RESTING = """od AS (SELECT source || ':' || ticker || ':' || n AS order_id, source, ticker, CASE WHEN n % 2 = 0 THEN 'limit' ELSE 'stop' END AS type, CASE WHEN n % 3 = 0 THEN 'buy' ELSE 'sell' END AS side,
 CASE WHEN (n % 2 = 0) = (n % 3 = 0) THEN close * 0.8 ELSE close * 1.2 END AS price, ts AS created_at, CASE WHEN n % 4 = 0 THEN ts + INTERVAL 6 HOUR END AS cancelled_at FROM nb),
oh AS (SELECT order_id, min(b.ts) AS x FROM od t JOIN nb b ON t.source = b.source AND t.ticker = b.ticker AND b.ts > created_at AND (cancelled_at IS NULL OR b.ts <= cancelled_at)
 AND CASE WHEN (type = 'limit') = (side = 'buy') THEN b.low <= price ELSE b.high >= price END GROUP BY 1)"""


@job("f2_resting_orders", o.sql(o.bars(), o.NUMBERED, RESTING, final="""SELECT order_id, type, side, price, b.ts AS fill_ts, CASE WHEN (type = 'limit') = (side = 'buy') THEN least(price, open) WHEN b.ts IS NOT NULL THEN greatest(price, open) END AS fill_price,
 side = 'sell' AND length(od.ticker) % 3 <> 2 AS rejected FROM od LEFT JOIN oh USING (order_id) LEFT JOIN nb b ON b.source = od.source AND b.ticker = od.ticker AND b.ts = oh.x""".replace("THEN least(price, open) WHEN", "AND b.ts IS NOT NULL THEN least(price, open) WHEN")))
def f2_resting_orders(spark, sf_dir):
    """Limit and stop orders until filled or cancelled, and sells rejected where shorting is not allowed."""
    b = _numbered(spark, sf_dir)
    even, third = F.col("n") % 2 == 0, F.col("n") % 3 == 0
    orders = b.select(
        F.concat_ws(":", *KEY, F.col("n").cast("string")).alias("order_id"), *KEY, F.when(even, "limit").otherwise("stop").alias("type"), F.when(third, "buy").otherwise("sell").alias("side"),
        F.when(even == third, F.col("close") * 0.8).otherwise(F.col("close") * 1.2).alias("price"), F.col("ts").alias("created_at"), F.when(F.col("n") % 4 == 0, F.expr("ts + INTERVAL '6' HOUR")).alias("cancelled_at"),
    )
    out = fills.fill_resting(orders, b).join(instruments(b).select(*KEY, "can_short"), list(KEY))
    return out.select("order_id", "type", "side", "price", "fill_ts", "fill_price", fills.rejected(F.col("side"), F.col("can_short"), F.lit(False)).alias("rejected"))


@job("f5_bracket_exits", o.sql(*TRADE_BASE, final="SELECT trade_id, side, entry_time, exit_time, exit_reason, exit_price FROM ex"))
def f5_bracket_exits(spark, sf_dir):
    """First touch of stop or target, clashes decided by quarter-hour bars."""
    return _exited(spark, sf_dir)[1].select("trade_id", "side", "entry_time", "exit_time", "exit_reason", "exit_price")


@job(
    "f7_signal_close",
    o.sql(
        *TRADE_BASE, "cl AS (SELECT e.*, b.ts AS close_ts, b.open AS close_open FROM ex e LEFT JOIN nb b ON b.source = e.source AND b.ticker = e.ticker AND b.n = e.n + 6)",
        final="""SELECT trade_id, CASE WHEN f THEN close_ts ELSE exit_time END AS exit_time, CASE WHEN f THEN close_open ELSE exit_price END AS exit_price, CASE WHEN f THEN 'signal' ELSE exit_reason END AS exit_reason
 FROM (SELECT *, close_ts IS NOT NULL AND (exit_time IS NULL OR close_ts <= exit_time) AS f FROM cl)""",
    ),
)
def f7_signal_close(spark, sf_dir):
    """a close signalled five bars after the signal fills at the next open and wins over that bar's levels."""
    bars, ex = _exited(spark, sf_dir)
    at = bars.select(*KEY, (F.col("n") - 6).alias("n"), F.col("ts").alias("close_ts"), F.col("open").alias("close_open"))
    return fills.with_signal_close(ex.join(at, [*KEY, "n"], "left")).select("trade_id", "exit_time", "exit_price", "exit_reason")


@job(
    "f8_moving_levels",
    o.sql(
        *TRADE_BASE[:4],
        "st AS (SELECT t.trade_id, t.side, b.ts, b.n - t.n AS age, b.open, b.high, b.low, CASE WHEN b.n - t.n > 4 THEN entry_price ELSE stop_loss END AS stop_loss, take_profit FROM tr t JOIN nb b ON b.source = t.source AND b.ticker = t.ticker AND b.ts > t.entry_time)",
        final="""SELECT trade_id, min(ts) AS exit_time, arg_min(CASE WHEN CASE WHEN side = 'buy' THEN low <= stop_loss ELSE high >= stop_loss END THEN 'stop_loss' ELSE 'take_profit' END, ts) AS exit_reason FROM st
 WHERE CASE WHEN side = 'buy' THEN low <= stop_loss OR high >= take_profit ELSE high >= stop_loss OR low <= take_profit END GROUP BY 1""",
    ),
)
def f8_moving_levels(spark, sf_dir):
    """F8: stops moved to the entry price four bars after the signal, until a level is reached: one first touch per stretch of equal levels."""
    b = _numbered(spark, sf_dir)
    move = b.select(*KEY, (F.col("n") - 4).alias("n"), F.col("ts").alias("move_ts"))
    t = _trades(b).join(move, [*KEY, "n"], "left").select("trade_id", *KEY, "side", "entry_time", "entry_price", "stop_loss", "take_profit", "move_ts")
    part = lambda k, after, until, stop: F.struct(F.concat_ws("/", "trade_id", F.lit(k)).alias("part_id"), F.col(after).alias("w_after"), until.alias("w_until"), F.col(stop).alias("w_stop"))
    parts = F.array(part("0", "entry_time", F.col("move_ts"), "stop_loss"), part("1", "move_ts", F.lit(None).cast("timestamp_ntz"), "entry_price"))
    p = t.select("trade_id", *KEY, "side", "take_profit", F.explode(parts).alias("w_p")).select("trade_id", *KEY, "side", "take_profit", "w_p.*").where("w_after is not null")
    long = F.col("side") == "buy"
    sl = lambda low, high: F.when(long, F.col(low) <= F.col("w_stop")).otherwise(F.col(high) >= F.col("w_stop"))
    either = sl("low", "high") | F.when(long, F.col("high") >= F.col("take_profit")).otherwise(F.col("low") <= F.col("take_profit"))
    hit = joins.first_touch(p, b, list(KEY), "part_id", "w_after", "w_until", either, either, ["ts", "high", "low"])
    x = p.join(hit, "part_id")
    return x.groupBy("trade_id").agg(F.min("hit_ts").alias("exit_time"), F.min_by(F.when(sl("hit_low", "hit_high"), "stop_loss").otherwise("take_profit"), "hit_ts").alias("exit_reason"))


COSTED = """cs AS (SELECT e.* EXCLUDE (entry_price, exit_price), 2.0::DOUBLE AS size, i.contract_size, i.leverage, i.tick_size, i.asset_class, i.price_basis,
 CASE WHEN asset_class = 'crypto' THEN 0.001 ELSE 0 END::DOUBLE AS rate, CASE WHEN asset_class = 'cfd' THEN 2 * tick_size ELSE 0 END AS points, CASE WHEN asset_class = 'crypto' THEN 0 ELSE 1 END AS ticks,
 CASE WHEN asset_class = 'crypto' THEN 0.0002 ELSE 0 END::DOUBLE AS pct, CASE WHEN asset_class = 'cfd' THEN 0.05 ELSE 0 END::DOUBLE AS annual, entry_price AS p0, exit_price AS p1, CASE WHEN side = 'buy' THEN 'sell' ELSE 'buy' END AS back FROM ex e JOIN inst i USING (source, ticker)),
sp AS (SELECT *, p0 + CASE WHEN price_basis = 'bid' THEN CASE WHEN side = 'buy' THEN points ELSE 0 END WHEN side = 'buy' THEN points / 2 ELSE -points / 2 END AS s0,
 CASE WHEN exit_reason = 'take_profit' THEN p1 ELSE p1 + CASE WHEN price_basis = 'bid' THEN CASE WHEN back = 'buy' THEN points ELSE 0 END WHEN back = 'buy' THEN points / 2 ELSE -points / 2 END END AS s1 FROM cs),
sl AS (SELECT *, CASE WHEN side = 'buy' THEN s0 + (ticks * tick_size + pct * s0) ELSE s0 - (ticks * tick_size + pct * s0) END AS entry_price,
 CASE WHEN exit_reason = 'take_profit' THEN s1 WHEN back = 'buy' THEN s1 + (ticks * tick_size + pct * s1) ELSE s1 - (ticks * tick_size + pct * s1) END AS exit_price FROM sp),
dy AS (SELECT source, ticker, ts, prev FROM (SELECT b.*, lag(close) OVER k AS prev, ((b.ts AT TIME ZONE 'UTC') AT TIME ZONE tz)::DATE AS d, lag(((b.ts AT TIME ZONE 'UTC') AT TIME ZONE tz)::DATE) OVER k AS pd FROM nb b JOIN inst USING (source, ticker) WINDOW k AS (PARTITION BY b.source, b.ticker ORDER BY b.ts)) WHERE d <> pd),
fi AS (SELECT trade_id, sum(abs(prev * size * contract_size) * annual / 365) AS financing FROM sl t JOIN dy USING (source, ticker) WHERE dy.ts > entry_time AND (exit_time IS NULL OR dy.ts <= exit_time) GROUP BY 1),
bl AS (SELECT sl.*, coalesce(financing, 0) AS financing, abs(entry_price * size * contract_size) * rate AS entry_commission, abs(exit_price * size * contract_size) * rate AS exit_commission,
 (exit_price - entry_price) * CASE WHEN side = 'buy' THEN 1 ELSE -1 END * size * contract_size AS gross_pnl FROM sl LEFT JOIN fi USING (trade_id)),
blotter AS (SELECT *, entry_commission + exit_commission + financing AS costs, gross_pnl - (entry_commission + exit_commission + financing) AS net_pnl FROM bl)"""
BLOTTER = (o.bars(), o.bars(900, name="fine"), o.INST, o.NUMBERED, TRADES, EXITS, COSTED)


def _blotter(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars, and all trades of size 2 with costs; open ones have null exits."""
    bars, ex = _exited(spark, sf_dir)
    inst = fills.default_costs(instruments(bars))
    t = ex.join(inst, list(KEY)).withColumn("size", F.lit(2.0)).withColumn("back", F.when(F.col("side") == "buy", "sell").otherwise("buy"))
    taker, out = fills.entry_liquidity(F.lit("market")), fills.exit_liquidity(F.col("exit_reason"))
    c = F.col
    t = t.withColumn("entry_price", fills.slipped_price(fills.spread_price(c("entry_price"), c("side"), c("price_basis"), c("spread_points"), taker), c("side"), c("slip_ticks"), c("tick_size"), c("slip_percent"), taker))
    t = t.withColumn("exit_price", fills.slipped_price(fills.spread_price(c("exit_price"), c("back"), c("price_basis"), c("spread_points"), out), c("back"), c("slip_ticks"), c("tick_size"), c("slip_percent"), out))
    none = F.lit(0.0)
    pay = lambda p, liq: fills.commission(c("commission_model"), c(p), c("size"), c("contract_size"), liq, none, c("maker_rate"), c("taker_rate"), none, none, none)
    t = t.withColumn("entry_commission", pay("entry_price", taker)).withColumn("exit_commission", F.when(c("exit_price").isNotNull(), pay("exit_price", out)))
    dated = bars.join(inst.select(*KEY, "tz"), list(KEY)).withColumn("local_date", F.to_date(sessions.to_local("ts", "tz")))
    t = t.join(fills.financing(t, dated), "trade_id", "left").withColumn("financing", F.coalesce("financing", none))
    return bars, written(fills.blotter(t), "blotter")


@job("f17_blotter", o.sql(*BLOTTER, final="SELECT trade_id, side, entry_time, exit_time, exit_reason, " + ", ".join(f"round({n}, 9) + 0.0 AS {n}" for n in ("entry_price", "exit_price", "financing", "gross_pnl", "costs", "net_pnl")) + " FROM blotter WHERE exit_time IS NOT NULL"))
def f17_blotter(spark, sf_dir):
    """Closed trades with spread, slippage, commissions and financing."""
    t = _blotter(spark, sf_dir)[1].where("exit_time is not null")
    return rounded(t.select("trade_id", "side", "entry_time", "exit_time", "exit_reason", "entry_price", "exit_price", "financing", "gross_pnl", "costs", "net_pnl"), 9)  # as many digits as products of prices, slippage and fees have: no ties


@job("f20_open_trades", o.sql(*BLOTTER, final=f"SELECT trade_id, side, entry_time, {_out('entry_price', 'stop_loss', 'take_profit')} FROM blotter WHERE exit_time IS NULL"))
def f20_open_trades(spark, sf_dir):
    """trades that no bar has closed."""
    return rounded(_blotter(spark, sf_dir)[1].where("exit_time is null").select("trade_id", "side", "entry_time", "entry_price", "stop_loss", "take_profit"))


@job(
    "f9_sizing",
    o.sql(
        *TRADE_BASE[:3], o.INST, TRADES,
        final=f"""SELECT trade_id, round(1000 / (ref * contract_size), 6) AS notional, round(100 / (abs(ref - stop_loss) * contract_size), 6) AS risk_cash, round(10000 * 0.01 / (abs(ref - stop_loss) * contract_size), 6) AS risk_percent,
 abs(ref * 5 * contract_size) / leverage <= 10000 - entry_price + 1e-9 AS margin_ok, CASE WHEN n % 2 = 0 THEN round(greatest(5 * 0.01, 1.0), 6) ELSE round(abs(ref * 5 * contract_size) * -0.0002, 6) END AS commission
 FROM tr JOIN inst USING (source, ticker) WHERE ref > 0""",
    ),
)
def f9_sizing(spark, sf_dir):
    """sizes by cash and risk, the margin check, per-share and rebate commissions."""
    b = _numbered(spark, sf_dir)
    t = _trades(b).where("ref > 0").join(instruments(b), list(KEY))
    c, lit = F.col, F.lit
    even = c("n") % 2 == 0
    fee = fills.commission(F.when(even, "per_share").otherwise("maker_taker"), c("ref"), lit(5.0), c("contract_size"), lit("maker"), lit(0.0), lit(-0.0002), lit(0.0005), lit(0.01), lit(1.0), lit(0.0))
    return rounded(
        t.select(
            "trade_id", fills.notional_cash(lit(1000.0), c("ref"), c("contract_size")).alias("notional"), fills.risk_cash(lit(100.0), c("ref"), c("stop_loss"), c("contract_size")).alias("risk_cash"),
            fills.risk_percent(lit(10000.0), lit(0.01), c("ref"), c("stop_loss"), c("contract_size")).alias("risk_percent"), fills.margin_ok(c("ref"), lit(5.0), c("contract_size"), c("leverage"), lit(10000.0), c("entry_price")).alias("margin_ok"), fee.alias("commission"),
        )
    )


EQUITY = """mv AS (SELECT source, ticker, entry_time AS ts, -entry_commission AS dc, sg * size * contract_size AS da, sg * size * contract_size * entry_price AS db, sg * size AS dp FROM (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sg FROM blotter)
 UNION ALL SELECT source, ticker, exit_time, gross_pnl - exit_commission, -sg * size * contract_size, -sg * size * contract_size * entry_price, -sg * size FROM (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sg FROM blotter WHERE exit_time IS NOT NULL)),
eq0 AS (SELECT b.source, b.ticker, b.ts, b.close, sum(m.dc) AS dc, sum(m.da) AS da, sum(m.db) AS db, sum(m.dp) AS dp FROM nb b LEFT JOIN mv m USING (source, ticker, ts) GROUP BY ALL),
eq AS (SELECT source, ticker, ts, round(1000000 + coalesce(sum(dc) OVER w, 0) + close * coalesce(sum(da) OVER w, 0) - coalesce(sum(db) OVER w, 0), 4) AS equity, coalesce(sum(dp) OVER w, 0) AS position FROM eq0 WINDOW w AS (PARTITION BY source, ticker ORDER BY ts ROWS UNBOUNDED PRECEDING))"""


def _equity(spark: SparkSession, sf_dir: str, shared: bool = False) -> tuple[DataFrame, DataFrame]:
    """Curves that start with 1,000,000 each, or with equal shares of it, and the trades."""
    bars, t = _blotter(spark, sf_dir)
    cash = 1_000_000.0 / max(1, bars.select(*KEY).distinct().count()) if shared else 1_000_000.0
    # to a hundredth of a cent: the order of a sum's terms must not make returns of 1e-16
    return written(rounded(fills.equity_curve(t, bars, cash), 4), "equity"), t


@job("f19_equity", o.sql(*BLOTTER, EQUITY, final="SELECT source, ticker, ts, round(equity, 4) AS equity, round(position, 4) AS position FROM eq"))
def f19_equity(spark, sf_dir):
    """equity and net position at every bar, open trades included."""
    return rounded(_equity(spark, sf_dir)[0], 4)


METRICS = """r0 AS (SELECT *, lag(equity) OVER k AS prev, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER k AS st, max(equity) OVER (PARTITION BY source, ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM eq WINDOW k AS (PARTITION BY source, ticker ORDER BY ts)),
r1 AS (SELECT *, CASE WHEN prev > 0 THEN equity / prev - 1 END AS ret, CASE WHEN peak > 0 THEN equity / peak - 1 ELSE 0 END AS dd FROM r0),
r2 AS (SELECT source, ticker, count(*) AS np, arg_min(equity, ts) AS e0, arg_max(equity, ts) AS e1, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / 86400 AS days, avg(ret) AS mu, stddev_pop(ret) AS sd, sqrt(avg(ret * ret) FILTER (WHERE ret < 0)) AS dn, min(dd) AS mdd,
 list_sort(list(st) FILTER (WHERE st > 0)) AS sl FROM r1 GROUP BY 1, 2),
mt AS (SELECT source, ticker, e1 / e0 - 1 AS total_return, CASE WHEN days >= 1 AND e1 > 0 THEN pow(e1 / e0, 365.25 / days) - 1 END AS cagr, mu / sd * sqrt(31557600 / sl[len(sl) // 2 + 1]) AS sharpe, mu / dn * sqrt(31557600 / sl[len(sl) // 2 + 1]) AS sortino, least(mdd, 0) AS max_drawdown FROM r2)"""
STATS = """ts AS (SELECT source, ticker, count(*) AS num_trades, avg((net_pnl > 0)::INT) AS win_rate, CASE WHEN count(*) FILTER (WHERE net_pnl < 0) = 0 THEN 'inf'::DOUBLE ELSE coalesce(sum(net_pnl) FILTER (WHERE net_pnl > 0), 0) / -sum(net_pnl) FILTER (WHERE net_pnl < 0) END AS profit_factor,
 sum(net_pnl) AS net_pnl FROM blotter WHERE exit_time IS NOT NULL GROUP BY 1, 2)"""


@job("m1_returns", o.sql(*BLOTTER, EQUITY, METRICS, final="SELECT source, ticker, ts, round(ret, 8) + 0.0 AS ret, round(dd, 8) + 0.0 AS drawdown FROM r1"))
def m1_returns(spark, sf_dir):
    """M1, M6: step returns and drawdowns."""
    return rounded(metrics.returns(_equity(spark, sf_dir)[0], list(KEY)).select(*KEY, "ts", "ret", "drawdown"), 8)


@job("m2_curve_metrics", o.sql(*BLOTTER, EQUITY, METRICS, final=f"SELECT source, ticker, {_out('total_return', 'cagr', 'sharpe', 'sortino', 'max_drawdown')} FROM mt"))
def m2_curve_metrics(spark, sf_dir):
    """M2 to M6."""
    return rounded(metrics.curve_metrics(_equity(spark, sf_dir)[0], list(KEY)))


@job("m7_trade_stats", o.sql(*BLOTTER, STATS, final=f"SELECT source, ticker, num_trades, {_out('win_rate', 'profit_factor', 'net_pnl')} FROM ts"))
def m7_trade_stats(spark, sf_dir):
    """M7."""
    return rounded(metrics.trade_stats(_blotter(spark, sf_dir)[1].where("exit_time is not null"), list(KEY)))


@job("u1_summary", o.sql(*BLOTTER, EQUITY, METRICS, STATS, final="""SELECT source, ticker, round(total_return * 100, 2) AS return_pct, round(sharpe, 2) AS sharpe, round(max_drawdown * 100, 2) AS max_dd_pct, round(win_rate * 100, 2) AS win_pct, round(profit_factor, 2) AS profit_factor,
 coalesce(num_trades, 0) AS trades, row_number() OVER (ORDER BY total_return DESC, source, ticker) AS place FROM mt LEFT JOIN ts USING (source, ticker) ORDER BY total_return DESC LIMIT 20"""))
def u1_summary(spark, sf_dir):
    """The summary, best return first (a top-20 report)."""
    eq, t = _equity(spark, sf_dir)
    m = metrics.curve_metrics(eq, list(KEY))
    s = metrics.summary(m, metrics.trade_stats(t.where("exit_time is not null"), list(KEY)), list(KEY)).drop("cagr_pct").join(m.select(*KEY, "total_return"), list(KEY))
    top = s.orderBy(F.col("total_return").desc(), *KEY).limit(20)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("total_return").desc(), *KEY)).cast("long")).drop("total_return")


@job("u2_universe_totals", o.sql(*BLOTTER, EQUITY, METRICS, STATS, final="SELECT count(*) AS symbols, round(avg(total_return), 6) AS mean_return, round(median(sharpe), 6) AS median_sharpe, round(avg((total_return > 0)::INT), 6) AS profitable, sum(num_trades)::BIGINT AS trades FROM mt LEFT JOIN ts USING (source, ticker)"))
def u2_universe_totals(spark, sf_dir):
    """U2."""
    eq, t = _equity(spark, sf_dir)
    m = metrics.curve_metrics(eq, list(KEY)).join(metrics.trade_stats(t.where("exit_time is not null"), list(KEY)), list(KEY), "left")
    return rounded(metrics.universe_totals(m))


ENTERED = (
    "fe AS (SELECT source, ticker, arg_min(equity, ts) AS e0 FROM eq GROUP BY 1, 2)",
    "en AS (SELECT b.source, b.ticker, b.n, b.exit_time, b.net_pnl, coalesce(e.equity, fe.e0) AS base FROM (SELECT * FROM blotter WHERE exit_time IS NOT NULL) b ASOF LEFT JOIN eq e ON b.source = e.source AND b.ticker = e.ticker AND b.entry_time >= e.ts JOIN fe ON fe.source = b.source AND fe.ticker = b.ticker)",
)


def _closed(t: DataFrame) -> DataFrame:
    return t.where("exit_time is not null").select(*KEY, "entry_time", "exit_time", "net_pnl", F.col("n").alias("seq"))


@job(
    "u3_combined_curve",
    o.sql(
        *BLOTTER, EQUITY, *ENTERED,
        final="SELECT exit_time AS ts, source, ticker, n AS seq, round((SELECT sum(e0) FROM fe) * product(1 + net_pnl / base) OVER (ORDER BY exit_time, source, ticker, n ROWS UNBOUNDED PRECEDING), 2) AS equity FROM en WHERE base > 0",
    ),
)
def u3_combined_curve(spark, sf_dir):
    """The compounding curve of all sleeves from their closed trades."""
    eq, t = _equity(spark, sf_dir)
    return rounded(metrics.combined_curve(_closed(t), eq, list(KEY)), 2)


@job(
    "u4_combined_result",
    o.sql(
        *BLOTTER, EQUITY.replace("1000000 +", "1000000::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT source, ticker FROM bars)) +"), *ENTERED,
        """cc AS (SELECT 0 AS rk, min(ts) AS ts, NULL AS source, NULL AS ticker, NULL AS n, round((SELECT sum(e0) FROM fe), 4) AS equity FROM eq
 UNION ALL SELECT 1, exit_time, source, ticker, n, round((SELECT sum(e0) FROM fe) * product(1 + net_pnl / base) OVER (ORDER BY exit_time, source, ticker, n ROWS UNBOUNDED PRECEDING), 4) FROM en WHERE base > 0)""",
        """c0 AS (SELECT *, lag(equity) OVER k AS prev, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER k AS st, max(equity) OVER (k ROWS UNBOUNDED PRECEDING) AS peak, row_number() OVER k AS i FROM cc WINDOW k AS (ORDER BY ts, rk, source, ticker, n)),
c1 AS (SELECT *, CASE WHEN prev > 0 THEN equity / prev - 1 END AS ret, CASE WHEN peak > 0 THEN equity / peak - 1 ELSE 0 END AS dd FROM c0),
c2 AS (SELECT arg_min(equity, i) AS e0, arg_max(equity, i) AS e1, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / 86400 AS days, avg(ret) AS mu, stddev_pop(ret) AS sd, sqrt(avg(ret * ret) FILTER (WHERE ret < 0)) AS dn, min(dd) AS mdd, list_sort(list(st) FILTER (WHERE st > 0)) AS sl FROM c1),
ps AS (SELECT count(*) AS num_trades, avg((net_pnl > 0)::INT) AS win_rate, coalesce(sum(net_pnl) FILTER (WHERE net_pnl > 0), 0) / -sum(net_pnl) FILTER (WHERE net_pnl < 0) AS profit_factor, sum(net_pnl) AS net_pnl FROM blotter WHERE exit_time IS NOT NULL)""",
        final="""SELECT round(e1 / e0 - 1, 6) + 0.0 AS total_return, CASE WHEN days >= 1 AND e1 > 0 THEN round(pow(e1 / e0, 365.25 / days) - 1, 6) + 0.0 END AS cagr, round(mu / sd * sqrt(31557600 / sl[len(sl) // 2 + 1]), 6) + 0.0 AS sharpe,
 round(mu / dn * sqrt(31557600 / sl[len(sl) // 2 + 1]), 6) + 0.0 AS sortino, round(least(mdd, 0), 6) + 0.0 AS max_drawdown, num_trades, round(win_rate, 6) AS win_rate, round(profit_factor, 6) AS profit_factor, round(net_pnl, 2) + 0.0 AS net_pnl FROM c2, ps""",
    ),
)
def u4_combined_result(spark, sf_dir):
    """Metrics of the combined curve, whose sleeves start with equal shares of the cash, and statistics of all trades pooled."""
    eq, t = _equity(spark, sf_dir, shared=True)
    r = rounded(metrics.combined_result(_closed(t), eq, list(KEY)))
    return r.withColumn("net_pnl", F.round("net_pnl", 2) + F.lit(0.0))


# signals ------------------------------------------------------------------------------------------------

CROSS_CTES = (
    o.bars(), o.steps([4 * HOUR], HOUR),
    "hb AS (SELECT *, row_number() OVER (PARTITION BY source, ticker ORDER BY ts) AS n FROM bars)",
    "cl AS (SELECT *, bar_no + 1 AS nx, list(close) OVER (PARTITION BY source, ticker ORDER BY bar_no) AS v FROM closed)",
    "td AS (SELECT s.source, s.ticker, s.step AS ts, CASE WHEN s.bar_no >= 20 THEN (list_sum(c.v[-19:]) + s.close) / 20 END AS trend FROM steps s LEFT JOIN cl c ON s.source = c.source AND s.ticker = c.ticker AND s.bar_no = c.nx)",
    """sg AS (SELECT b.*, t.trend, CASE WHEN n >= 10 THEN avg(close) OVER (w ROWS 9 PRECEDING) END AS fast, CASE WHEN n >= 30 THEN avg(close) OVER (w ROWS 29 PRECEDING) END AS slow, lead(ts) OVER w AS next_ts, lead(open) OVER w AS next_open
 FROM hb b JOIN td t USING (source, ticker, ts) WINDOW w AS (PARTITION BY b.source, b.ticker ORDER BY b.ts))""",
)
CROSS = "coalesce(fast - slow > 1e-9 AND close > trend, false)"


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with fast and slow averages and the four-hour trend as seen at each bar."""
    hours = _hours(spark, sf_dir)
    steps = resample.forming(hours, instruments(hours), [4 * HOUR], HOUR)
    closed = resample.bars_of(steps).where("is_closed")
    trend = indicators.forming_sma(steps, closed, 20, out="trend").select(*KEY, F.col("step").alias("ts"), "trend", "bar_no")
    b = indicators.numbered(hours)
    b = indicators.averages(b, {"fast": (10, "close"), "slow": (30, "close")}, KEY).withColumn("slow", F.col("slow") + 1e-9)
    return signals.sma_cross(fills.with_next(b.join(trend, [*KEY, "ts"])))


@job("g1_sma_cross", o.sql(*CROSS_CTES, final=f"SELECT source, ticker, ts, {CROSS} AS enter, coalesce(fast - slow < 1e-9, false) AS leave, CASE WHEN {CROSS} THEN round(close * 0.98, 6) END AS stop_loss, CASE WHEN {CROSS} THEN round(close * 1.04, 6) END AS take_profit FROM sg"))
def g1_sma_cross(spark, sf_dir):
    """Moving-average cross with a higher trend, none while an average is missing."""
    s = _cross(spark, sf_dir)
    return rounded(s.select(*KEY, "ts", "enter", "leave", F.when(F.col("enter"), F.col("stop_loss")).alias("stop_loss"), F.when(F.col("enter"), F.col("take_profit")).alias("take_profit")))


@job(
    "t9_trading_window",
    o.sql(
        *CROSS_CTES, o.bars(DAY, "'all'", "ref_bars"), "rn AS (SELECT ts, row_number() OVER (ORDER BY ts) AS ref_no FROM ref_bars)",
        final=f"""SELECT g.source, g.ticker, g.ts, {CROSS} AS enter, coalesce(fast - slow < 1e-9, false) AS leave FROM sg g JOIN (SELECT source, ticker, step AS ts, bar_no FROM steps) s USING (source, ticker, ts)
 ASOF LEFT JOIN rn r ON g.ts >= r.ts WHERE g.ts >= TIMESTAMP '2024-01-10' AND n >= 30 AND s.bar_no >= 20 AND coalesce(ref_no, 0) >= 12""",
    ),
)
def t9_trading_window(spark, sf_dir):
    """Signals from a start on, once the hourly, four-hour and reference bars seen are as many as the longest lookbacks need."""
    s = _cross(spark, sf_dir)
    t = ticks.event_ticks(spark, sf_dir).withColumn("ticker", F.lit("all"))
    ref = written(indicators.numbered(ticks.base_bars(t, DAY)).select(F.lit(1).alias("w_one"), "ts", F.col("n").alias("ref_no")), "reference")
    s = written(s.select(*KEY, "ts", "n", "bar_no", "enter", "leave"), "signals")
    # the reference as of distinct times, then an equi-join: the bars of all symbols do not meet in one task
    times = joins.asof(s.select(F.lit(1).alias("w_one"), "ts").distinct(), ref, ["w_one"], "ts", "ts", ["ref_no"]).drop("w_one")
    seen = s.join(times, "ts")
    return signals.trading_window(seen, F.lit("2024-01-10").cast("timestamp_ntz"), {"n": 30, "bar_no": 20, "ref_no": 12}).select(*KEY, "ts", "enter", "leave")


@job(
    "g2_drop_with_regime",
    o.sql(
        o.bars(), o.NUMBERED, o.bars(DAY, "'all'", "ref_bars"), "rl AS (SELECT ts, close, row_number() OVER (ORDER BY ts) AS n, list(close) OVER (ORDER BY ts) AS v FROM ref_bars)",
        f"re AS (SELECT ts, close, CASE WHEN n >= 5 THEN {o.ema('v', 5)} END AS ema FROM rl)", f"pk AS (SELECT *, CASE WHEN n >= 24 THEN max(close) OVER ({o.W} ROWS 23 PRECEDING) END AS peak FROM nb)",
        final="SELECT p.source, p.ticker, p.ts, p.peak, coalesce(p.peak > 0 AND (p.peak - p.close) / p.peak >= 0.5, false) AS dropped, coalesce(r.close >= r.ema, false) AS market_ok FROM pk p ASOF LEFT JOIN re r ON p.ts >= r.ts",
    ),
)
def g2_drop_with_regime(spark, sf_dir):
    """A drop from the recent peak, allowed while the market is above its average."""
    t = ticks.event_ticks(spark, sf_dir).withColumn("ticker", F.lit("all"))
    ref = written(indicators.ema(indicators.numbered(ticks.base_bars(t, DAY)), 5).select("ts", "close", "ema"), "reference")
    return signals.regime(signals.drop_from_peak(_numbered(spark, sf_dir), 24, 0.5), ref).select(*KEY, "ts", "peak", "dropped", "market_ok")


TREND = (
    o.steps([4 * HOUR], HOUR), "cl AS (SELECT *, bar_no + 1 AS nx, list(close) OVER (PARTITION BY source, ticker, tf_seconds ORDER BY bar_no) AS v FROM closed)",
    f"""st AS (SELECT s.*, c.v, CASE WHEN len(c.v) >= 20 THEN {o.ema('c.v', 20)} END AS e FROM steps s LEFT JOIN cl c ON s.source = c.source AND s.ticker = c.ticker AND s.tf_seconds = c.tf_seconds AND s.bar_no = c.nx)""",
    "tn AS (SELECT source, ticker, step AS ts, CASE WHEN bar_no = 20 THEN (list_sum(v[-19:]) + close) / 20 WHEN bar_no > 20 THEN close * (2.0::DOUBLE / 21) + e * (1 - 2.0::DOUBLE / 21) END AS trend FROM st)",
)
GAP_SETUPS = (
    o.bars(), o.NUMBERED, FRACTAL, SWINGS, GAPS, *TREND,
    """gs0 AS (SELECT g.*, b.close, trend, first_ts + INTERVAL 1 HOUR AS c1_end FROM gap g JOIN nb b USING (source, ticker, n) JOIN tn ON tn.source = g.source AND tn.ticker = g.ticker AND tn.ts = g.ts WHERE bullish = 1 OR bearish = 1)""",
    # swings are known from the bar behind them on
    """gs AS (SELECT g.*, CASE WHEN bullish = 1 THEN (SELECT max_by(s.low, s.swing_ts) FROM sw s WHERE fractal_down = 1 AND s.source = g.source AND s.ticker = g.ticker AND s.swing_ts <= g.c1_end AND s.ts <= g.ts)
 ELSE (SELECT max_by(s.high, s.swing_ts) FROM sw s WHERE fractal_up = 1 AND s.source = g.source AND s.ticker = g.ticker AND s.swing_ts <= g.c1_end AND s.ts <= g.ts) END AS sl,
 CASE WHEN bullish = 1 THEN (SELECT max(s.high) FROM sw s WHERE fractal_up = 1 AND s.source = g.source AND s.ticker = g.ticker AND s.swing_ts >= g.first_ts AND s.ts <= g.ts)
 ELSE (SELECT min(s.low) FROM sw s WHERE fractal_down = 1 AND s.source = g.source AND s.ticker = g.ticker AND s.swing_ts >= g.first_ts AND s.ts <= g.ts) END AS tp FROM gs0 g)""",
    """ge AS (SELECT *, (tp + 0.5::DOUBLE * sl) / 1.5::DOUBLE AS e FROM gs)""",
    """gf AS (SELECT *, CASE WHEN bullish = 1 THEN CASE WHEN e > gap_top THEN gap_top WHEN e > gap_bottom THEN e END ELSE CASE WHEN e < gap_bottom THEN gap_top WHEN e < gap_top THEN e END END AS entry FROM ge)""",
    """setups AS (SELECT source || ':' || ticker || ':' || n AS setup_id, source, ticker, n, ts, bullish, gap_top, gap_bottom, sl, tp, entry, CASE WHEN bullish = 1 THEN high > tp ELSE low < tp END AS broken
 FROM gf WHERE entry IS NOT NULL AND CASE WHEN bullish = 1 THEN close > trend ELSE close < trend END)""",
)


def _setups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, setups and swings."""
    b = _numbered(spark, sf_dir)
    steps = written(resample.forming(b.drop("n"), instruments(b), [4 * HOUR], HOUR), "steps")
    trend = indicators.forming_ema(steps, resample.bars_of(steps).where("is_closed"), 20, out="trend").select(*KEY, F.col("step").alias("ts"), "trend")
    first = series.looking_back(b, 2, lambda w: {"first_ts": F.lag("ts", 2).over(w)}, KEY)
    gaps = indicators.fair_value_gap(first).select(*KEY, "n", "ts", "first_ts", "high", "low", "close", "bullish", "bearish", "gap_top", "gap_bottom")
    swings = written(_swings(b), "swings")
    s = signals.gap_setups(written(gaps.join(trend, [*KEY, "ts"]), "gaps"), swings, HOUR, 0.5)
    return b, written(s.withColumn("setup_id", F.concat_ws(":", *KEY, F.col("n").cast("string"))), "setups"), swings


@job("g4_gap_setups", o.sql(*GAP_SETUPS, final=f"SELECT source, ticker, ts, bullish, {_out('gap_top', 'gap_bottom', 'sl', 'tp', 'entry')} FROM setups"))
def g4_gap_setups(spark, sf_dir):
    """Gap setups in the trend's direction with stop, target and limit price, from swings known at the third bar."""
    s = _setups(spark, sf_dir)[1]
    return rounded(s.select(*KEY, "ts", "bullish", "gap_top", "gap_bottom", F.col("stop_loss").alias("sl"), F.col("take_profit").alias("tp"), "entry"))


def _orders_sql(renewals: int) -> str:
    """Orders by bar numbers: one set of steps for the first order and each renewal."""
    beyond = "(bullish = 1 AND s.fractal_up = 1 AND s.high > tp OR bullish = 0 AND s.fractal_down = 1 AND s.low < tp)"
    test, ctes, ends = "CASE WHEN bullish = 1 THEN b.low <= gap_top ELSE b.high >= gap_bottom END", ["a0 AS (SELECT *, n AS after FROM setups)"], []
    for k in range(renewals + 1):
        ctes.append(f"""h{k} AS (SELECT a.setup_id, min(b.n) AS x FROM a{k} a JOIN nb b ON a.source = b.source AND a.ticker = b.ticker AND b.n > after AND NOT broken AND ({test} OR CASE WHEN bullish = 1 THEN b.high > tp ELSE b.low < tp END) GROUP BY 1),
g{k} AS (SELECT a.*, CASE WHEN broken THEN after ELSE x END AS at_n, CASE WHEN broken THEN 'expired' WHEN x IS NULL THEN 'resting' WHEN CASE WHEN bullish = 1 THEN b.low <= entry ELSE b.high >= entry END THEN 'filled' WHEN {test} THEN 'tested' ELSE 'expired' END AS state
 FROM a{k} a LEFT JOIN h{k} USING (setup_id) LEFT JOIN nb b ON b.source = a.source AND b.ticker = a.ticker AND b.n = x)""")
        ends.append(f"SELECT setup_id, source, ticker, state, at_n, {k} AS renewals FROM g{k}" + (" WHERE state <> 'expired'" if k < renewals else ""))
        if k < renewals:
            ctes.append(f"""w{k} AS (SELECT g.* EXCLUDE (state), (SELECT min(b.n) FROM nb b WHERE b.source = g.source AND b.ticker = g.ticker AND b.n > g.at_n AND {test}) AS t,
 (SELECT min(b.n) FROM nb b WHERE b.source = g.source AND b.ticker = g.ticker AND b.n > g.at_n) AS nx, (SELECT min(s.n) FROM sw s WHERE s.source = g.source AND s.ticker = g.ticker AND s.n > g.n + 1 AND {beyond}) AS c FROM g{k} g WHERE state = 'expired'),
v{k} AS (SELECT *, CASE WHEN nx IS NOT NULL AND c IS NOT NULL THEN greatest(nx, c) END AS r FROM w{k}),
u{k} AS (SELECT v.* EXCLUDE (tp), CASE WHEN bullish = 1 THEN (SELECT max(s.high) FROM sw s WHERE s.source = v.source AND s.ticker = v.ticker AND s.fractal_up = 1 AND s.n > v.n + 1 AND s.n <= v.r)
 ELSE (SELECT min(s.low) FROM sw s WHERE s.source = v.source AND s.ticker = v.ticker AND s.fractal_down = 1 AND s.n > v.n + 1 AND s.n <= v.r) END AS tp FROM v{k} v WHERE r IS NOT NULL AND (t IS NULL OR t > r)),
p{k} AS (SELECT * EXCLUDE (entry), (tp + 0.5::DOUBLE * sl) / 1.5::DOUBLE AS e FROM u{k}),
q{k} AS (SELECT *, CASE WHEN bullish = 1 THEN CASE WHEN e > gap_top THEN gap_top WHEN e > gap_bottom THEN e END ELSE CASE WHEN e < gap_bottom THEN gap_top WHEN e < gap_top THEN e END END AS entry FROM p{k}),
a{k + 1} AS (SELECT setup_id, source, ticker, n, ts, bullish, gap_top, gap_bottom, sl, tp, entry, false AS broken, r AS after FROM q{k} WHERE entry IS NOT NULL)""")
            ends.append(f"SELECT setup_id, source, ticker, CASE WHEN t IS NULL THEN 'resting' ELSE 'tested' END, t, {k} FROM v{k} WHERE t IS NOT NULL AND (r IS NULL OR t <= r) OR t IS NULL AND r IS NULL")
            ends.append(f"SELECT setup_id, source, ticker, 'expired', r, {k} FROM q{k} WHERE entry IS NULL")
    ctes.append("every_end AS (" + " UNION ALL ".join(ends) + ")")
    more = ", renewals" if renewals else ""
    return o.sql(*GAP_SETUPS, *ctes, final=f"SELECT setup_id, state, b.ts AS state_ts{more} FROM every_end e LEFT JOIN nb b ON b.source = e.source AND b.ticker = e.ticker AND b.n = e.at_n")


@job("g5_gap_orders", _orders_sql(0))
def g5_gap_orders(spark, sf_dir):
    """What becomes of each gap order, however late; without renewals."""
    b, s, swings = _setups(spark, sf_dir)
    return signals.gap_orders(s, b, swings, 0.5).drop("renewals")


@job("g5_gap_orders_renewed", _orders_sql(2))
def g5_gap_orders_renewed(spark, sf_dir):
    """G5, J4 with up to two renewals of the target by confirmed swings."""
    b, s, swings = _setups(spark, sf_dir)
    return signals.gap_orders(s, b, swings, 0.5, max_renewals=2)


GATE = """cn AS (SELECT trade_id, source, ticker, n AS signal_no, exit_no, exit_reason, row_number() OVER (PARTITION BY source, ticker ORDER BY n) AS i FROM ex),
walk AS (SELECT source, ticker, i, trade_id, true AS taken, CASE WHEN exit_no IS NULL THEN 1000000000 WHEN exit_reason = 'stop_loss' THEN exit_no + 5 ELSE exit_no END AS free FROM cn WHERE i = 1
 UNION ALL SELECT c.source, c.ticker, c.i, c.trade_id, c.signal_no >= w.free, CASE WHEN c.signal_no < w.free THEN w.free WHEN c.exit_no IS NULL THEN 1000000000 WHEN c.exit_reason = 'stop_loss' THEN c.exit_no + 5 ELSE c.exit_no END
 FROM walk w JOIN cn c ON c.source = w.source AND c.ticker = w.ticker AND c.i = w.i + 1)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, ex = _exited(spark, sf_dir)
    no = bars.select(*KEY, F.col("ts").alias("exit_time"), F.col("n").alias("exit_no"))
    return ex.join(no, [*KEY, "exit_time"], "left").select(*KEY, "trade_id", F.col("n").alias("signal_no"), F.col("exit_no").cast("double").alias("exit_no"), "exit_reason")


@job("g6_gated_trades", "WITH RECURSIVE " + ",\n".join([*TRADE_BASE, GATE]) + "\nSELECT source, ticker, trade_id FROM walk WHERE taken")
def g6_gated_trades(spark, sf_dir):
    """One position at a time, and a rest of five bars after a stop."""
    return signals.gate(_candidates(spark, sf_dir), cooldown=5).select(*KEY, "trade_id")


SWEEP = "pm AS (SELECT unnest([5, 10, 20]) AS fast_p, unnest([20, 30, 60]) AS slow_p)"


@job(
    "u8_parameter_sweep",
    o.sql(
        o.bars(symbol="user_id"), o.NUMBERED,
        *[f"a{p} AS (SELECT source, ticker, ts, n, close, {p} AS p, CASE WHEN n >= {p} THEN avg(close) OVER ({o.W} ROWS {p - 1} PRECEDING) END AS a FROM nb)" for p in (5, 10, 20, 30, 60)],
        SWEEP, "al AS (SELECT * FROM a5 UNION ALL SELECT * FROM a10 UNION ALL SELECT * FROM a20 UNION ALL SELECT * FROM a30 UNION ALL SELECT * FROM a60)",
        final="SELECT fast_p || '/' || slow_p AS param_id, f.source, f.ticker, count(*) FILTER (WHERE f.a - s.a > 1e-9) AS long_bars, count(*) FILTER (WHERE s.a IS NOT NULL) AS warm_bars FROM pm JOIN al f ON f.p = fast_p JOIN al s ON s.p = slow_p AND s.source = f.source AND s.ticker = f.ticker AND s.ts = f.ts GROUP BY 1, 2, 3",
    ),
)
def u8_parameter_sweep(spark, sf_dir):
    """U8, G1 per parameter set: each distinct average once, whatever number of sets uses it."""
    b = indicators.numbered(ticks.event_bars(spark, sf_dir, HOUR, "user_id"))
    sets = [(5, 20), (10, 30), (20, 60)]
    b = indicators.averages(b, {f"a{p}": (p, "close") for s in sets for p in s})
    rows = b.select(*KEY, F.explode(F.array(*[F.struct(F.lit(f"{f}/{s}").alias("param_id"), F.col(f"a{f}").alias("fast"), F.col(f"a{s}").alias("slow")) for f, s in sets])).alias("x")).select(*KEY, "x.*")
    return rows.groupBy("param_id", *KEY).agg(F.count_if(F.col("fast") - F.col("slow") > 1e-9).alias("long_bars"), F.count("slow").alias("warm_bars"))


@job(
    "u7_strategy_scan",
    o.sql(
        o.bars(symbol="user_id"), o.NUMBERED,
        final="SELECT source, ticker, count(*)::DOUBLE AS bars, round(max(close) - min(close), 6) AS span, NULL::VARCHAR AS error FROM nb GROUP BY 1, 2 HAVING min(low) > 0.5 UNION ALL SELECT source, ticker, NULL, NULL, 'ValueError: a price of at most 0.5' FROM nb GROUP BY 1, 2 HAVING min(low) <= 0.5",
    ),
)
def u7_strategy_scan(spark, sf_dir):
    """A user's step per symbol; symbols that fail become error rows."""

    def step(bars: pd.DataFrame) -> pd.DataFrame:
        if bars["low"].min() <= 0.5:
            raise ValueError("a price of at most 0.5")
        return pd.DataFrame({"bars": [float(len(bars))], "span": [bars["close"].max() - bars["close"].min()]})

    rows = indicators.numbered(ticks.event_bars(spark, sf_dir, HOUR, "user_id"))
    good, bad = signals.scan(rows, step, "bars double, span double", list(KEY))
    return rounded(good.withColumn("error", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True))


@job(
    "u2_universe_errors",
    o.sql(
        o.bars(symbol="user_id"), o.NUMBERED,
        "hr AS (SELECT source, ticker, min(low) > 0.5 AS ok, arg_max(close, ts) / arg_min(close, ts) - 1 AS total_return, count(*) > 1 AS several FROM nb GROUP BY 1, 2)",
        final="SELECT count(*) FILTER (WHERE ok) AS symbols, round(avg(total_return) FILTER (WHERE ok AND several), 6) AS mean_return, round(avg((total_return > 0)::INT) FILTER (WHERE ok AND several), 6) AS profitable, count(*) FILTER (WHERE ok AND several) AS trades, count(*) FILTER (WHERE NOT ok) AS errors FROM hr",
    ),
)
def u2_universe_errors(spark, sf_dir):
    """Totals over the runs of a user's buy-and-hold step, with the number of symbols that failed."""

    def step(bars: pd.DataFrame) -> pd.DataFrame:
        if bars["low"].min() <= 0.5:
            raise ValueError("a price of at most 0.5")
        held = len(bars) > 1
        return pd.DataFrame({"total_return": [bars["close"].iloc[-1] / bars["close"].iloc[0] - 1 if held else None], "sharpe": [None], "num_trades": [int(held)]})

    good, bad = signals.scan(ticks.event_bars(spark, sf_dir, HOUR, "user_id"), step, "total_return double, sharpe double, num_trades long", list(KEY))
    return rounded(metrics.universe_totals(good, bad).drop("median_sharpe"))


# ingest -------------------------------------------------------------------------------------------------


@job("s1_upsert", o.sql(o.bars(), final="SELECT source, ticker, tf_seconds, ts, open, high, low, CASE WHEN hour(ts) % 3 = 0 THEN close + 1 ELSE close END AS close, volume FROM bars"))
def s1_upsert(spark, sf_dir):
    """Newer rows replace older ones of the same key and time, the last of several winning."""
    b = _hours(spark, sf_dir).withColumn("seq", F.lit(0))
    third = b.where("hour(ts) % 3 = 0")
    new = third.withColumn("close", F.col("close") - 5).unionByName(third.withColumn("close", F.col("close") + 1).withColumn("seq", F.lit(1)))
    return ingest.upsert(b, new).drop("seq")


@job(
    "s3_gaps_and_backfill",
    o.sql(
        o.bars(), "h AS (SELECT source, ticker, tf_seconds, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY ALL)",
        "g AS (SELECT source, ticker, tf_seconds, unnest([{'a': TIMESTAMP '2023-09-01', 'b': lo}, {'a': hi, 'b': TIMESTAMP '2024-04-01'}]) AS x FROM h UNION ALL SELECT 'events', 'none', 3600, {'a': TIMESTAMP '2023-09-01', 'b': TIMESTAMP '2024-04-01'})",
        "p AS (SELECT source, ticker, tf_seconds, x.b AS stop, unnest(generate_series(x.a, x.b, INTERVAL 1000 HOUR)) AS page_start FROM g)",
        final="SELECT source, ticker, tf_seconds, page_start, least(page_start + INTERVAL 999 HOUR, stop) AS page_end FROM p",
    ),
)
def s3_gaps_and_backfill(spark, sf_dir):
    """What is missing before and after the bars held, in pages of 1000 bars."""
    b = _hours(spark, sf_dir)
    keys = b.select(*KEY, "tf_seconds").distinct()
    keys = keys.unionByName(keys.limit(1).select("source", F.lit("none").alias("ticker"), "tf_seconds"))
    r = keys.withColumns({"start": F.expr("TIMESTAMP_NTZ'2023-09-01 00:00:00'"), "end": F.expr("TIMESTAMP_NTZ'2024-04-01 00:00:00'")})
    return ingest.backfill_plan(ingest.coverage_gaps(b, r))


@job("s5_klines", o.sql(o.bars(), final="SELECT source, ticker, ts, open, high, low, close, volume FROM bars"))
def s5_klines(spark, sf_dir):
    """Bars written as provider JSON, one array per symbol and day, and decoded again."""
    b = _hours(spark, sf_dir)
    k = F.array((sessions.epoch("ts") * 1000).cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")])
    raw = b.groupBy(*KEY, F.to_date("ts").alias("day")).agg(F.to_json(F.collect_list(k)).alias("payload")).drop("day")
    return ingest.decode_klines(raw)


@job("s6_exchange_info", "SELECT DISTINCT event_type AS ticker, CASE WHEN length(event_type) % 3 = 1 THEN '' ELSE upper(event_type) END AS base, 'USDT' AS quote, CASE WHEN length(event_type) % 3 = 1 THEN 0.01 ELSE 0.5 END::DOUBLE AS tick_size FROM events")
def s6_exchange_info(spark, sf_dir):
    """Exchange information per symbol, with defaults where it is broken."""
    t = ticks.event_ticks(spark, sf_dir).select("ticker").distinct()
    good = F.concat(F.lit('{"symbols":[{"baseAsset":"'), F.upper("ticker"), F.lit('","quoteAsset":"USDT","filters":[{"filterType":"LOT_SIZE"},{"filterType":"PRICE_FILTER","tickSize":"0.5"}]}]}'))
    return ingest.decode_exchange_info(t.withColumn("payload", F.when(F.length("ticker") % 3 == 1, '{"symbols":[').otherwise(good))).drop("payload")


@job("s7_trendbars", "SELECT event_id, make_timestamp((epoch_us(ts) // 60000000 - 60) * 60000000) AS ts, round((floor(value * 1000) + 500) / 1e5, 8) AS open, round((floor(value * 1000) + 900) / 1e5, 8) AS high, round(floor(value * 1000) / 1e5, 8) AS low, round((floor(value * 1000) + 200) / 1e5, 8) AS close, 7.0::DOUBLE AS volume FROM events")
def s7_trendbars(spark, sf_dir):
    """Relative integer bars with a server offset of an hour."""
    t = ticks.event_ticks(spark, sf_dir).withColumn("w", sessions.epoch("ts"))
    raw = t.select(F.col("seq").alias("event_id"), F.floor(F.col("price") * 1000).alias("low"), *[F.lit(v).alias(c) for c, v in (("delta_open", 500), ("delta_high", 900), ("delta_close", 200), ("volume", 7))], F.floor(F.col("w") / 60).alias("minutes"))
    return rounded(ingest.decode_trendbars(raw, 60), 8)


SPLIT = "CASE WHEN hour(ts) = 5 AND day(ts) % 10 = 0 THEN 2.0 WHEN hour(ts) = 6 AND day(ts) % 10 = 0 THEN 0.0 END::DOUBLE"


@job(
    "s8_split_adjusted",
    o.sql(
        o.bars(), f"sp AS (SELECT *, coalesce(nullif({SPLIT}, 0), 1) AS f, hour(ts) = 7 AS bad FROM bars)", "ad AS (SELECT *, coalesce(product(f) OVER (PARTITION BY source, ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS p FROM sp)",
        final="SELECT source, ticker, tf_seconds, (ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS ts, round(open / p, 6) AS open, round(high / p, 6) AS high, round(low / p, 6) AS low, round(close / p, 6) AS close, volume * p AS volume FROM ad WHERE NOT bad",
    ),
)
def s8_split_adjusted(spark, sf_dir):
    """Later splits divide earlier prices, rows without a price go, local times become UTC."""
    b = _hours(spark, sf_dir)
    at = lambda h: (F.hour("ts") == h) & (F.dayofmonth("ts") % 10 == 0)
    b = b.withColumn("split", F.when(at(5), 2.0).when(at(6), 0.0)).withColumn("high", F.when(F.hour("ts") == 7, float("nan")).otherwise(F.col("high")))
    return rounded(ingest.local_to_utc(ingest.drop_bad(ingest.adjust_splits(b)), "America/New_York"))


@job("s10_universes", "SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'nations' END AS source, n_name AS ticker, (row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1)::INT AS pos FROM nation JOIN region ON n_regionkey = r_regionkey")
def s10_universes(spark, sf_dir):
    """Lists of tickers, bare or with a source."""
    n, r = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    lists = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name", "r_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("tickers"))
    whole = F.to_json(F.struct(F.lit("nations").alias("source"), "tickers"))
    return ingest.universes(lists.select(F.col("r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 0, whole).otherwise(F.to_json("tickers")).alias("text")))


def _run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    eq, t = _equity(spark, sf_dir)
    cols = ["side", "size", "entry_price", "entry_time", "exit_price", "exit_time", "exit_reason", "stop_loss", "take_profit", "gross_pnl", "costs", "net_pnl"]
    closed = t.where("exit_time is not null")
    m = metrics.curve_metrics(eq, list(KEY)).join(metrics.trade_stats(closed, list(KEY)), list(KEY), "left")
    return ingest.run_results(m, eq, closed.select(*KEY, F.concat_ws(":", *KEY).alias("symbol"), *cols), list(KEY))


@job("s13_run_export", o.sql(*BLOTTER, final="SELECT source, ticker, count(*) FILTER (WHERE exit_time IS NOT NULL) AS trades, (SELECT count(*) FROM nb WHERE nb.source = blotter.source AND nb.ticker = blotter.ticker) AS points, 16 AS id_chars FROM blotter GROUP BY 1, 2"))
def s13_run_export(spark, sf_dir):
    """Each symbol's result as JSON with a content address; parsed back to count what it holds."""
    r = _run_results(spark, sf_dir)
    back = F.from_json("result", "trades array<struct<symbol:string>>, equity_curve array<struct<ts:string,equity:double>>")
    return r.select(*KEY, F.size(back["trades"]).cast("long").alias("trades"), F.size(back["equity_curve"]).cast("long").alias("points"), F.length("run_id").alias("id_chars"))


@job(
    "s13_run_contents",
    o.sql(
        *BLOTTER, EQUITY, METRICS, STATS,
        "eb AS (SELECT source, ticker, count(*) AS points, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_ts, arg_min(equity, ts) AS first_equity, arg_max(equity, ts) AS last_equity, sum(floor(equity * 1e6 + 0.5)::BIGINT)::BIGINT AS total_equity FROM eq GROUP BY 1, 2)",
        "tb AS (SELECT source, ticker, count(*) FILTER (WHERE exit_reason = 'stop_loss') AS stops, sum(floor(entry_price * 1e6 + 0.5)::BIGINT)::BIGINT AS entries, sum(floor(exit_price * 1e6 + 0.5)::BIGINT)::BIGINT AS exits, sum(floor(costs * 1e6 + 0.5)::BIGINT)::BIGINT AS costs FROM blotter WHERE exit_time IS NOT NULL GROUP BY 1, 2)",
        final=f"""SELECT source, ticker, {_out('total_return', 'max_drawdown', 'sharpe', 'win_rate')}, coalesce(num_trades, 0) AS num_trades, points, first_ts, last_ts, {_out('first_equity', 'last_equity')}, total_equity, coalesce(stops, 0) AS stops, coalesce(entries, 0) AS entries, coalesce(exits, 0) AS exits, coalesce(costs, 0) AS costs, source || ':' || ticker AS symbol, true AS id_ok FROM mt JOIN eb USING (source, ticker) LEFT JOIN ts USING (source, ticker) LEFT JOIN tb USING (source, ticker)""",
    ),
)
def s13_run_contents(spark, sf_dir):
    """What each result's JSON says of metrics, curve and trades, read back from it; its content address, computed again."""
    back = F.from_json("result", "metrics struct<total_return:double,max_drawdown:double,sharpe:double,win_rate:double,num_trades:long>, equity_curve array<struct<ts:string,equity:double>>, trades array<struct<symbol:string,entry_price:double,exit_price:double,exit_reason:string,costs:double>>")
    r = _run_results(spark, sf_dir).select(*KEY, "run_id", F.substring(F.sha2("result", 256), 1, 16).alias("again"), back.alias("x")).select(*KEY, (F.col("run_id") == F.col("again")).alias("id_ok"), "x.*")
    # in whole millionths, whose sums do not depend on their order
    total = lambda col, field: F.aggregate(col, F.lit(0).cast("long"), lambda a, t: a + F.floor(t[field] * 1e6 + 0.5))
    curve, trades = F.col("equity_curve"), F.col("trades")
    out = r.select(
        *KEY, "metrics.total_return", "metrics.max_drawdown", "metrics.sharpe", "metrics.win_rate", F.coalesce("metrics.num_trades", F.lit(0)).alias("num_trades"), F.size(curve).cast("long").alias("points"),
        curve[0]["ts"].alias("first_ts"), F.element_at(curve, -1)["ts"].alias("last_ts"), curve[0]["equity"].alias("first_equity"), F.element_at(curve, -1)["equity"].alias("last_equity"), total(curve, "equity").alias("total_equity"),
        F.size(F.filter(trades, lambda t: t["exit_reason"] == "stop_loss")).cast("long").alias("stops"), *[total(trades, f).alias(name) for f, name in (("entry_price", "entries"), ("exit_price", "exits"), ("costs", "costs"))],
        F.coalesce(F.get(trades, F.lit(0))["symbol"], F.concat_ws(":", *KEY)).alias("symbol"), "id_ok",
    )
    return rounded(out)


# advisor ------------------------------------------------------------------------------------------------

CONTEXT = """rw AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M') || ' ' || printf('%.4f,%.4f,%.4f,%.4f', open, high, low, close) || ' ' || volume::BIGINT AS line FROM steps),
fin AS (SELECT source, ticker, tf_seconds, bar_no, arg_max(line, step) AS line FROM rw GROUP BY ALL),
bf AS (SELECT source, ticker, bar_no, list(line) OVER (PARTITION BY source, ticker ORDER BY bar_no ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING) AS before FROM fin),
cx AS (SELECT t.trade_id, t.signal_ts, t.side, 'é "trade"?' || chr(10) || t.side || ' 1.0000 stop ' || printf('%.4f', stop_loss) || ' target ' || printf('%.4f', take_profit) || chr(10) || CASE WHEN ref <> stop_loss THEN 'reward:risk ' || printf('%.2f', abs(take_profit - ref) / abs(ref - stop_loss)) || chr(10) ELSE '' END
 || array_to_string(list_append(coalesce(before, []), line || CASE WHEN is_closed THEN '' ELSE ' <forming>' END), chr(10)) AS text FROM tr t JOIN rw ON rw.source = t.source AND rw.ticker = t.ticker AND rw.step = t.signal_ts JOIN bf ON bf.source = t.source AND bf.ticker = t.ticker AND bf.bar_no = rw.bar_no),
ky AS (SELECT *, sha256('["m1", "' || replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), 'é', '\\u00e9') || '"]') AS key FROM cx)"""


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _numbered(spark, sf_dir)
    lines = advisor.bar_lines(resample.forming(b, instruments(b), [4 * HOUR], HOUR)).select(*KEY, F.col("step").alias("signal_ts"), "lines")
    t = _trades(b).join(lines, [*KEY, "signal_ts"])
    text = advisor.context(F.col("side"), F.lit(1.0), F.col("stop_loss"), F.col("take_profit"), F.col("ref"), F.col("lines"), F.lit('é "trade"?'))
    return t.withColumn("text", text).withColumn("key", advisor.decision_key(F.lit("m1"), F.col("text")))


@job("d1_contexts", o.sql(o.bars(), o.NUMBERED, o.steps([4 * HOUR], HOUR), TRADES, CONTEXT, final="SELECT trade_id, text, key FROM ky"))
def d1_contexts(spark, sf_dir):
    """What an advisor would read about each candidate, and the key of its decision."""
    return _contexts(spark, sf_dir).select("trade_id", "text", "key")


@job("d3_decisions", o.sql(o.bars(), o.NUMBERED, o.steps([4 * HOUR], HOUR), TRADES, CONTEXT, final="SELECT trade_id, side = 'sell' AS known FROM ky WHERE side = 'buy' OR day(signal_ts) % 2 = 0"))
def d3_decisions(spark, sf_dir):
    """Candidates with a stored decision (here on sells), vetoed ones dropped, unknown ones approved."""
    c = written(_contexts(spark, sf_dir).select("trade_id", "side", "signal_ts", "key"), "contexts")
    stored = c.where("side = 'sell'").select("key", (F.dayofmonth("signal_ts") % 2 == 0).alias("approved"), F.lit("m1").alias("model_id"))
    decided, _ = advisor.lookup(c, stored)
    return advisor.not_vetoed(decided).select("trade_id", F.col("approved").isNotNull().alias("known"))


# streaming ------------------------------------------------------------------------------------------------


def _tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return e.select(F.lit("events").alias("source"), F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"))


def _drained(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now; its rows, from a table in the shared folder."""
    out = path(spark, "stream")
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", path(spark, "stream-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@job("x1_stream_bars", o.sql(o.bars(), final="SELECT source, ticker, ts, open, high, low, close, volume FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"))
def x1_stream_bars(spark, sf_dir):
    """Hourly bars of a tick stream once the watermark has passed them."""
    out = _drained(spark, streaming.tumbling(streaming.unique_ticks(_tick_stream(spark, sf_dir), "10 minutes"), HOUR))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@job(
    "x2_stream_forming",
    o.sql(o.bars(), final="SELECT source, ticker, ts, open, high, low, close, volume FROM bars"),
)
def x2_stream_forming(spark, sf_dir):
    """Still-forming hourly bars in update mode, merged into a table that holds one row per key and bar."""
    out, state = path(spark, "stream"), path(spark, "stream-state")
    bars = streaming.tumbling(_tick_stream(spark, sf_dir).withWatermark("ts", "10 minutes"), HOUR)
    bars.writeStream.outputMode("update").foreachBatch(streaming.upsert_sink(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(*KEY, F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


@job(
    "x3_stream_session_bars",
    o.sql(
        o.bars(), o.steps([4 * HOUR], HOUR), "cu AS (SELECT source, ticker, tf_seconds, bar_no, max(close_utc) AS cu FROM x8 GROUP BY ALL)",
        # a last bar counts as well once the watermark, an hour behind, has passed its close
        final="""SELECT source, ticker, tf_seconds, ts, open, high, low, close, volume FROM every JOIN cu USING (source, ticker, tf_seconds, bar_no)
 WHERE cu < (SELECT max(ts) - INTERVAL 1 HOUR FROM bars) OR (source, ticker, tf_seconds, bar_no) IN (SELECT (source, ticker, tf_seconds, bar_no) FROM closed)""",
    ),
)
def x3_stream_session_bars(spark, sf_dir):
    """Session-bounded four-hour bars with keyed state, over a stream of hourly bars written day by day."""
    b = _hours(spark, sf_dir)
    inst = instruments(b)
    rows = b.drop("tf_seconds").join(inst.select(*KEY, *resample.SESSION), list(KEY)).withColumn("tf_seconds", F.lit(4 * HOUR).cast("long"))
    rows = sessions.bucket_bounds(rows).select(*KEY, "tf_seconds", *[F.col(c).cast("timestamp").alias(c) for c in ("ts", "open_utc", "close_utc")], "open", "high", "low", "close", "volume")
    where = path(spark, "stream-in")
    rows.write.parquet(where)
    stream = spark.readStream.schema(rows.schema).parquet(where).withWatermark("ts", "1 hour")
    out = _drained(spark, streaming.session_bars(stream, HOUR))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


FLAG = f"""cd AS (SELECT source || ':' || ticker || ':' || n AS trade_id, source, ticker, n AS signal_no, 'buy' AS side, next_ts AS entry_time, next_open AS entry_price, close * 0.98::DOUBLE AS stop_loss, close * 1.04::DOUBLE AS take_profit FROM sg WHERE {CROSS} AND next_ts IS NOT NULL),
h0 AS (SELECT c.trade_id, min(b.ts) AS x FROM cd c JOIN sg b ON b.source = c.source AND b.ticker = c.ticker AND b.ts > c.entry_time AND (b.low <= stop_loss OR b.high >= take_profit) GROUP BY 1),
cn AS (SELECT c.*, b.n AS exit_no, b.ts AS exit_time, CASE WHEN b.low <= stop_loss THEN 'stop_loss' WHEN b.high >= take_profit THEN 'take_profit' END AS exit_reason,
 CASE WHEN b.low <= stop_loss THEN least(stop_loss, b.open) WHEN b.high >= take_profit THEN greatest(take_profit, b.open) END AS exit_price, row_number() OVER (PARTITION BY c.source, c.ticker ORDER BY signal_no) AS i
 FROM cd c LEFT JOIN h0 USING (trade_id) LEFT JOIN sg b ON b.source = c.source AND b.ticker = c.ticker AND b.ts = h0.x),
walk AS (SELECT source, ticker, i, trade_id, true AS taken, coalesce(exit_no, 1000000000) AS free FROM cn WHERE i = 1
 UNION ALL SELECT c.source, c.ticker, c.i, c.trade_id, c.signal_no >= w.free, CASE WHEN c.signal_no < w.free THEN w.free ELSE coalesce(c.exit_no, 1000000000) END FROM walk w JOIN cn c ON c.source = w.source AND c.ticker = w.ticker AND c.i = w.i + 1),
bt AS (SELECT source, ticker, exit_price - entry_price AS net_pnl FROM cn JOIN walk USING (source, ticker, i) WHERE taken AND exit_time IS NOT NULL)"""


@job(
    "strategy_sma_cross",
    "WITH RECURSIVE " + ",\n".join([*CROSS_CTES, FLAG])
    + """\nSELECT source, ticker, count(*) AS num_trades, round(avg((net_pnl > 0)::INT), 6) + 0.0 AS win_rate, round(CASE WHEN count(*) FILTER (WHERE net_pnl < 0) = 0 THEN 'inf'::DOUBLE ELSE coalesce(sum(net_pnl) FILTER (WHERE net_pnl > 0), 0) / -sum(net_pnl) FILTER (WHERE net_pnl < 0) END, 6) + 0.0 AS profit_factor,
 round(sum(net_pnl), 6) + 0.0 AS net_pnl FROM bt GROUP BY 1, 2""",
)
def strategy_sma_cross(spark, sf_dir):
    """The whole path: bars, forming trend, signals, fills, brackets, one position at a time, statistics per symbol."""
    s = written(_cross(spark, sf_dir), "signals")
    c = s.where("enter and next_ts is not null").select(
        F.concat_ws(":", *KEY, F.col("n").cast("string")).alias("trade_id"), *KEY, F.col("n").alias("signal_no"), F.lit("buy").alias("side"), F.col("next_ts").alias("entry_time"), F.col("next_open").alias("entry_price"), "stop_loss", "take_profit"
    )
    x = fills.bracket_exits(c, s)
    no = s.select(*KEY, F.col("ts").alias("exit_time"), F.col("n").cast("double").alias("exit_no"))
    taken = signals.gate(x.join(no, [*KEY, "exit_time"], "left"))
    done = taken.where("exit_time is not null").withColumns({"size": F.lit(1.0), "contract_size": F.lit(1.0), "entry_commission": F.lit(0.0), "exit_commission": F.lit(0.0), "financing": F.lit(0.0)})
    return rounded(metrics.trade_stats(fills.blotter(done), list(KEY)))


def _walked(s: DataFrame, leave=None, max_hold: int | None = None, cooldown: int = 0) -> DataFrame:
    """The trades taken of all that ``s`` enters, with levels and closes at the open after a signal or a time, whichever comes first."""
    c = s.where("enter and next_ts is not null").select(
        F.concat_ws(":", *KEY, F.col("n").cast("string")).alias("trade_id"), *KEY, F.col("n").alias("signal_no"), F.lit("buy").alias("side"), F.col("next_ts").alias("entry_time"), F.col("next_open").alias("entry_price"), "stop_loss", "take_profit"
    )
    x = fills.with_signal_close(fills.signal_closes(fills.bracket_exits(c, s), s, leave, max_hold))
    no = s.select(*KEY, F.col("ts").alias("exit_time"), F.col("n").cast("double").alias("exit_no"))
    return signals.gate(x.join(no, [*KEY, "exit_time"], "left"), cooldown)


def _stats(taken: DataFrame, by=KEY) -> DataFrame:
    done = taken.where("exit_time is not null").withColumns({"size": F.lit(1.0), "contract_size": F.lit(1.0), "entry_commission": F.lit(0.0), "exit_commission": F.lit(0.0), "financing": F.lit(0.0)})
    return rounded(metrics.trade_stats(fills.blotter(done), list(by)))


def _drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fills.with_next(_numbered(spark, sf_dir))
    flags = g2_drop_with_regime(spark, sf_dir).select(*KEY, "ts", (F.col("dropped") & F.col("market_ok")).alias("enter"))
    s = s.join(flags, [*KEY, "ts"])
    return written(s.withColumns({"stop_loss": F.col("close") * 0.5, "take_profit": F.col("close") * 2.0}), "drops")


SETS = [(5, 20), (10, 30), (20, 60)]


@job(
    "u8_sweep_trades",
    "WITH RECURSIVE "
    + ",\n".join([
        o.bars(), o.NUMBERED,
        *[f"a{p} AS (SELECT source, ticker, n, {p} AS p, CASE WHEN n >= {p} THEN avg(close) OVER ({o.W} ROWS {p - 1} PRECEDING) END AS a FROM nb)" for p in sorted({p for s in SETS for p in s})],
        "al AS (" + " UNION ALL ".join(f"SELECT * FROM a{p}" for p in sorted({p for s in SETS for p in s})) + ")",
        f"nx AS (SELECT *, lead(ts) OVER ({o.W}) AS next_ts, lead(open) OVER ({o.W}) AS next_open FROM nb)",
        "sg AS (SELECT b.* EXCLUDE (ticker), b.ticker || '#' || fast_p || '/' || slow_p AS ticker, -1 AS trend, f.a AS fast, s.a AS slow FROM nx b JOIN (VALUES " + ", ".join(map(str, SETS)) + ") pm(fast_p, slow_p) ON true JOIN al f ON f.p = fast_p AND f.source = b.source AND f.ticker = b.ticker AND f.n = b.n JOIN al s ON s.p = slow_p AND s.source = b.source AND s.ticker = b.ticker AND s.n = b.n)",
        FLAG,
    ])
    + """\nSELECT split_part(ticker, '#', 2) AS param_id, source, split_part(ticker, '#', 1) AS ticker, count(*) AS num_trades, round(avg((net_pnl > 0)::INT), 6) + 0.0 AS win_rate, round(CASE WHEN count(*) FILTER (WHERE net_pnl < 0) = 0 THEN 'inf'::DOUBLE ELSE coalesce(sum(net_pnl) FILTER (WHERE net_pnl > 0), 0) / -sum(net_pnl) FILTER (WHERE net_pnl < 0) END, 6) + 0.0 AS profit_factor,
 round(sum(net_pnl), 6) + 0.0 AS net_pnl FROM bt GROUP BY ALL""",
)
def u8_sweep_trades(spark, sf_dir):
    """Trade statistics per parameter set and symbol; bars and averages are made once, exits found for the trades of all sets in one join."""
    b = indicators.numbered(ticks.event_bars(spark, sf_dir, HOUR))
    b = indicators.averages(b, {f"a{p}": (p, "close") for s in SETS for p in s}, KEY)
    b = written(fills.with_next(b), "sweep")
    each = F.explode(F.array(*[F.struct(F.lit(f"{f}/{s}").alias("param_id"), (F.col(f"a{f}") - F.col(f"a{s}") > 1e-9).alias("enter")) for f, s in SETS]))
    c = b.where("next_ts is not null").withColumn("x", each).where("x.enter").select(
        "x.param_id", F.concat_ws(":", *KEY, F.col("n").cast("string"), "x.param_id").alias("trade_id"), *KEY, F.col("n").alias("signal_no"), F.lit("buy").alias("side"), F.col("next_ts").alias("entry_time"), F.col("next_open").alias("entry_price"),
        (F.col("close") * 0.98).alias("stop_loss"), (F.col("close") * 1.04).alias("take_profit"),
    )
    no = b.select(*KEY, F.col("ts").alias("exit_time"), F.col("n").cast("double").alias("exit_no"))
    by = ["param_id", *KEY]
    return _stats(signals.gate(fills.bracket_exits(c, b).join(no, [*KEY, "exit_time"], "left"), by=by), by)


from wickwork.jobs import accounts as _accounts  # noqa: E402, F401  registers its queries
