"""Indicators that run along with a stream of bars: SMA, EMA and RSI with keyed state.

Bars may arrive out of order within the watermark's delay. They wait in a list state until the watermark has passed them, are then taken in the order of their times, and
advance the running values: a ring of the last closes for the SMA, and for EMA and RSI the number of bars, the mean so far (the seed) and the smoothed values. So the state
of a key holds the bars of one delay and one ring, whatever its history. A repeated bar (one time, one key) counts once, the first one to arrive.

Needs the RocksDB state store (``with_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from wickwork.schema import KEY

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUT = "source string, ticker string, ts timestamp, close double, n long, sma double, ema double, rsi double"
_RUN = ["n", "total", "ema", "gain", "loss", "last", "last_us"]


@contextmanager
def with_rocksdb(spark: SparkSession):
    """The session with the state store that these streams need; its setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _Running(StatefulProcessor):
    def __init__(self, period: int, rsi: int):
        self.period, self.rsi = period, rsi

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, close double")
        self.ring = handle.getListState("ring", "close double")
        self.run = handle.getValueState("run", "n long, total double, ema double, gain double, loss double, last double, last_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(t.value // 1000), float(c)) for part in rows for t, c in zip(part["ts"], part["close"], strict=True)]
        yield self._released(key, list(self.waiting.get()) + new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._released(key, list(self.waiting.get()), timerValues)

    def close(self) -> None:
        pass

    def _released(self, key: tuple, bars: list, timers) -> pd.DataFrame:
        mark = timers.getCurrentWatermarkInMs() * 1000
        state = dict(zip(_RUN, self.run.get(), strict=True)) if self.run.exists() else {c: None for c in _RUN} | {"n": 0, "total": 0.0, "gain": 0.0, "loss": 0.0}
        ring = [r[0] for r in self.ring.get()]
        out, later = [], []
        for us, close in sorted(bars, key=lambda b: b[0]):
            if us > mark:
                later.append((us, close))
            elif state["last_us"] is None or us > state["last_us"]:
                out.append((*key, pd.Timestamp(us, unit="us"), close, *self._step(state, ring, close)))
                state["last_us"] = us
        self.ring.put([(c,) for c in ring]) if ring else self.ring.clear()
        self.waiting.put(later) if later else self.waiting.clear()
        if state["n"]:
            self.run.update(tuple(state[c] for c in _RUN))
        if later:
            self.handle.registerTimer(later[0][0] // 1000 + 1)  # the first that waits
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def _step(self, s: dict, ring: list[float], close: float) -> tuple:
        """Number, SMA, EMA and RSI after one more close; None until warm."""
        p, q = self.period, self.rsi
        s["n"] += 1
        n = s["n"]
        ring.append(close)
        if len(ring) > p:
            del ring[0]
        if n <= p:
            s["total"] += close
            s["ema"] = s["total"] / p if n == p else None
        else:
            k = 2.0 / (p + 1)
            s["ema"] = close * k + s["ema"] * (1 - k)
        rsi = None
        if n > 1:
            up, down = max(close - s["last"], 0.0), max(s["last"] - close, 0.0)
            if n <= q + 1:  # the seed is a mean
                s["gain"], s["loss"] = s["gain"] + up / q, s["loss"] + down / q
            else:
                s["gain"], s["loss"] = (s["gain"] * (q - 1) + up) / q, (s["loss"] * (q - 1) + down) / q
            if n > q:
                rsi = 100.0 if s["loss"] == 0 else 100.0 - 100.0 / (1.0 + s["gain"] / s["loss"])
        s["last"] = close
        return n, sum(ring) / p if n >= p else None, s["ema"], rsi


def running(bars: DataFrame, period: int = 20, rsi: int = 14) -> DataFrame:
    """Per bar that the watermark has passed: key, ts, close, its number and the indicators' values, as the batch jobs give them.

    ``bars``: a stream of closed bars (key, ts, close) with a watermark on ``ts``.
    """
    grouped = bars.select(*KEY, "ts", "close").groupBy(*KEY)
    return grouped.transformWithStateInPandas(_Running(period, rsi), StructType.fromDDL(OUT), "Append", "eventTime")
