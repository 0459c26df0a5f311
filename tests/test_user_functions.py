"""A user's function in chunks and on forming bars against calls on whole histories."""

import datetime as dt
import random

import pandas as pd

from wickwork.operators import indicators

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "source string, ticker string, tf_seconds long, ts timestamp_ntz, open double, high double, low double, close double, volume double, n long"


def user_function():
    """Made inside, so that it goes to the workers by value."""

    def spread(bars):
        return pd.DataFrame({"a": bars["high"].rolling(5).max() - bars["low"].rolling(5).min(), "b": bars["close"].pct_change(3)})

    return spread


spread = user_function()


def test_chunks(spark):
    r = random.Random(6)
    rows = [("s", t, 3600, T0 + dt.timedelta(hours=k), *(r.random() + 1 for _ in range(5)), k + 1) for t in ("x", "y") for k in range(100 if t == "x" else 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, parts = (sorted(map(str, indicators.from_function(df, spread, ["a", "b"], 5, history=h, rows=k).select("ticker", "n", "a", "b").collect())) for h, k in ((None, None), (4, 16)))
    assert whole == parts and len(whole) == 103


def test_forming_steps(spark):
    """Equal to the function called at each step with all that is visible there."""
    r = random.Random(7)
    closed, steps = [], []
    for no in range(1, 25):
        o, h, low, c = 1 + r.random(), 3 + r.random(), r.random(), 1 + r.random()
        for k in range(3):
            steps.append(("s", "x", 3600, no, k, o, h - (2 - k) * 0.1, low + (2 - k) * 0.1, c + k, float(k + 1)))
        closed.append(("s", "x", 3600, no, o, h, low, c + 2, 3.0))
    cols = ", ".join(f"{c} double" for c in indicators.OHLCV)
    s = spark.createDataFrame(steps, f"source string, ticker string, tf_seconds long, bar_no long, step int, {cols}")
    b = spark.createDataFrame(closed, f"source string, ticker string, tf_seconds long, bar_no long, {cols}")
    got = {(x["bar_no"], x["step"]): (x["a"], x["b"]) for x in indicators.forming_function(s, b, spread, ["a", "b"], 5).collect()}
    assert len(got) == len(steps)
    for row in steps:
        seen = pd.DataFrame([x[4:] for x in closed if x[3] < row[3]] + [row[5:]], columns=list(indicators.OHLCV))
        want = spread(seen).iloc[-1]
        for v, w in zip(got[row[3], row[4]], want, strict=True):
            assert (v is None) == (row[3] < 5) and (v is None or abs(v - w) < 1e-12)


def test_fixed_lookbacks_spread(spark, monkeypatch):
    """One symbol over many chunks gives the rows of one window over its whole series, closed and forming."""
    from pyspark.sql import functions as F

    from wickwork.operators import series, signals

    r = random.Random(9)
    rows = [("s", "x", 3600, T0 + dt.timedelta(hours=k), *(r.random() + 1 for _ in range(5)), k + 1) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    closed = df.withColumn("bar_no", F.col("n")).drop("n")
    steps = closed.withColumn("close", F.col("close") * 1.01)
    by = ("source", "ticker", "tf_seconds")

    def rows_of():
        made = [
            indicators.averages(df, {"a": (5, "close"), "b": (20, "volume")}),
            *[f(df) for f in (indicators.rsi, indicators.atr, indicators.bollinger, indicators.fractals, indicators.fair_value_gap, indicators.adx)],
            signals.drop_from_peak(df, 12, 0.1, by),
            *[f(steps, closed, *a) for f, a in ((indicators.forming_sma, (20,)), (indicators.forming_ema, (5,)), (indicators.forming_rsi, ()), (indicators.forming_bollinger, ()), (indicators.forming_fractals, ()), (indicators.forming_adx, ()))],
        ]
        return [sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in x) for x in m.drop("ts").collect()) for m in made]

    whole = rows_of()
    monkeypatch.setattr(series, "CHUNK_ROWS", 8)
    assert rows_of() == whole and all(len(x) == 300 for x in whole)
    seen = series.in_chunks(df, 2, lambda b, keys: b.withColumn("task", F.col("w_chunk")), by).select("task").distinct().count()
    assert seen == 38
