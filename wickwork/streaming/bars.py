"""Streaming bars: tumbling windows for round-the-clock markets, a keyed state for sessions.

Late ticks behind the watermark are dropped, and repeated ticks within it count once; the batch jobs take all rows, so
the two agree where the delay covers the disorder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wickwork.schema import KEY
from wickwork.sources.ingest import merge_table


def unique_ticks(ticks: DataFrame, delay: str) -> DataFrame:
    """One row per (key, seq) within the watermark."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*KEY, "seq"])


def tumbling(ticks: DataFrame, secs: int) -> DataFrame:
    """Bars of fixed UTC length over watermarked ticks: final bars in append mode, still-forming ones in update mode."""
    order = F.struct("ts", "seq")
    bars = ticks.groupBy(*KEY, F.window("ts", f"{secs} seconds").alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume")
    )
    return bars.select(*KEY, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def upsert_sink(path: str):
    """A ``foreachBatch`` function that keeps one row per key and bar in a Parquet table by day: the latest batch's.

    A batch merges only the days that it touches. Rows carry the number of the batch that wrote them, so a batch that is replayed, alone or after later ones, changes nothing.
    """

    def merge(rows: DataFrame, batch: int) -> None:
        dated = rows.withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "batch": F.lit(batch).cast("long")})
        merge_table(path, dated, [*KEY, "ts"], ["batch", "volume"], ["day"])

    return merge


STATE = "open_utc timestamp, close_utc timestamp, open double, high double, low double, close double, volume double, last timestamp"
OUT = "source string, ticker string, tf_seconds long, ts timestamp, open double, high double, low double, close double, volume double"


def session_bars(bars: DataFrame, base: int) -> DataFrame:
    """Closed bars of session-bounded buckets from base bars with ``open_utc`` and ``close_utc`` (see ``bucket_bounds``), per key and timeframe.

    A bar is emitted by the base bar that reaches its close, by the first one of a later bucket, or once the watermark has passed its
    close. The state holds the forming bar alone.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        now = state.get if state.exists else None

        def emit(bar: tuple) -> None:
            out.append((*key, bar[0], *bar[2:7]))

        if state.hasTimedOut:
            if now:
                emit(now)
            state.remove()
        else:
            rows = pd.concat(list(parts)).sort_values("ts")
            for r in rows.itertuples():
                if now and r.ts <= now[7]:
                    continue  # older than what the bar has seen
                if now and now[0] != r.open_utc:
                    emit(now)
                    now = None
                now = (r.open_utc, r.close_utc, r.open, r.high, r.low, r.close, r.volume, r.ts) if not now else (now[0], now[1], now[2], max(now[3], r.high), min(now[4], r.low), r.close, now[6] + r.volume, r.ts)
                if r.ts + pd.Timedelta(seconds=base) >= r.close_utc:
                    emit(now)
                    now = None
            if now:
                state.update(now)
                due = int(pd.Timestamp(now[1]).timestamp() * 1000)
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return bars.groupBy(*KEY, "tf_seconds").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
