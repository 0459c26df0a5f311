"""DuckDB SQL pieces that state the same results as the jobs, for tests and the correctness check."""

from __future__ import annotations


def sql(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


def bars(secs: int = 3600, symbol: str = "event_type", name: str = "bars") -> str:
    return f"""{name} AS (SELECT 'events' AS source, ticker, {secs}::BIGINT AS tf_seconds, make_timestamp(b * 1000000) AS ts, arg_min(value, ts) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
 FROM (SELECT {symbol}::VARCHAR AS ticker, ts, value, (epoch_us(ts) // 1000000) // {secs} * {secs} AS b FROM events) GROUP BY ticker, b)"""


def order_bars(secs: int = 86400) -> str:
    return f"""bars AS (SELECT 'orders' AS source, ticker, {secs}::BIGINT AS tf_seconds, make_timestamp(b * 1000000) AS ts, first(p ORDER BY ts, k) AS open, max(p) AS high,
 min(p) AS low, last(p ORDER BY ts, k) AS close, count(*)::DOUBLE AS volume
 FROM (SELECT o_orderpriority AS ticker, o_orderdate AS ts, o_totalprice AS p, o_orderkey AS k, (epoch_us(o_orderdate) // 1000000) // {secs} * {secs} AS b FROM orders) GROUP BY ticker, b)"""


INST = """inst AS (SELECT DISTINCT source, ticker, CASE length(ticker) % 3 WHEN 0 THEN 'crypto' WHEN 1 THEN 'stock' ELSE 'cfd' END AS asset_class,
 CASE length(ticker) % 3 WHEN 2 THEN 0.001 ELSE 0.01 END::DOUBLE AS tick_size, CASE length(ticker) % 3 WHEN 2 THEN 'bid' ELSE 'last' END AS price_basis, length(ticker) % 3 = 2 AS can_short,
 CASE length(ticker) % 3 WHEN 2 THEN 100.0 ELSE 1.0 END::DOUBLE AS contract_size, CASE length(ticker) % 3 WHEN 2 THEN 30.0 ELSE 1.0 END::DOUBLE AS leverage,
 CASE length(ticker) % 3 WHEN 0 THEN 'UTC' ELSE 'America/New_York' END AS tz, CASE WHEN length(ticker) % 3 = 1 THEN 34200 END AS open_sec,
 CASE WHEN length(ticker) % 3 = 1 THEN 57600 END AS close_sec, CASE WHEN length(ticker) % 3 = 2 THEN 61200 END AS anchor FROM bars)"""


def bounds(timeframes: list[int], base: int) -> str:
    return f"""x0 AS (SELECT b.* EXCLUDE (tf_seconds), tz, open_sec, close_sec, anchor, tf AS tf_seconds, epoch_us((ts AT TIME ZONE 'UTC') AT TIME ZONE tz) // 1000000 AS l
 FROM bars b JOIN inst USING (source, ticker), (SELECT unnest({sorted(timeframes)})::BIGINT AS tf)),
x1 AS (SELECT *, l // 86400 * 86400 AS mid, (l // 86400 + 3) % 7 AS wd FROM x0),
x2 AS (SELECT *, CASE WHEN l < mid + coalesce(anchor, 0) THEN mid + anchor - 86400 ELSE mid + coalesce(anchor, 0) END AS ref FROM x1),
x3 AS (SELECT *, CASE WHEN tf_seconds % 604800 = 0 THEN mid - wd * 86400 ELSE ref + (l - ref) // tf_seconds * tf_seconds END AS s FROM x2),
x4 AS (SELECT *, CASE WHEN tf_seconds % 604800 <> 0 AND tf_seconds <= 86400 AND mid + close_sec < s + tf_seconds THEN mid + close_sec ELSE s + tf_seconds END AS e FROM x3),
x5 AS (SELECT *, (make_timestamp(s * 1000000) AT TIME ZONE tz) AT TIME ZONE 'UTC' AS open_utc, (make_timestamp(e * 1000000) AT TIME ZONE tz) AT TIME ZONE 'UTC' AS close_utc FROM x4)"""


def steps(timeframes: list[int], base: int) -> str:
    return f"""{INST},
{bounds(timeframes, base)},
x6 AS (SELECT * REPLACE (CASE WHEN tf_seconds = {base} THEN ts ELSE open_utc END AS open_utc), tf_seconds = {base} OR ts + INTERVAL {base} SECOND >= close_utc AS closes FROM x5),
x7 AS (SELECT *, coalesce(open_utc <> lag(open_utc) OVER k OR lag(closes) OVER k, true)::INT AS begins FROM x6 WINDOW k AS (PARTITION BY source, ticker, tf_seconds ORDER BY ts)),
x8 AS (SELECT *, (sum(begins) OVER (PARTITION BY source, ticker, tf_seconds ORDER BY ts ROWS UNBOUNDED PRECEDING))::BIGINT AS bar_no FROM x7),
steps AS (SELECT source, ticker, tf_seconds, ts AS step, bar_no, open_utc AS ts, first_value(open) OVER r AS open, max(high) OVER r AS high, min(low) OVER r AS low, close,
 sum(volume) OVER r AS volume, closes AS is_closed, count(*) OVER r AS n FROM x8 WINDOW r AS (PARTITION BY source, ticker, tf_seconds, bar_no ORDER BY ts ROWS UNBOUNDED PRECEDING)),
every AS (SELECT source, ticker, tf_seconds, bar_no, ts, arg_max(open, step) AS open, max(high) AS high, min(low) AS low, arg_max(close, step) AS close, max(volume) AS volume, bool_or(is_closed) AS c
 FROM steps GROUP BY source, ticker, tf_seconds, bar_no, ts),
closed AS (SELECT * EXCLUDE (c, is_closed) FROM (SELECT *, c OR bar_no < max(bar_no) OVER (PARTITION BY source, ticker, tf_seconds) AS is_closed FROM every) WHERE is_closed)"""


NUMBERED = "nb AS (SELECT *, row_number() OVER (PARTITION BY source, ticker, tf_seconds ORDER BY ts) AS n FROM bars)"
W = "PARTITION BY source, ticker, tf_seconds ORDER BY n"


def fold(values: str, period: int, keep: float, weight: float) -> str:
    """Mean of the first ``period`` values, then keep * previous + weight * value."""
    return f"list_reduce(list_prepend(list_sum(({values})[1:{period}]) / {period}, ({values})[{period + 1}:]), lambda e, x: x * {weight!r} + e * {keep!r})"


def ema(values: str, period: int) -> str:
    k = 2.0 / (period + 1)
    return fold(values, period, 1 - k, k)


def wilder(values: str, period: int) -> str:
    return fold(values, period, (period - 1) / period, 1 / period)
