"""The jobs against bar-by-bar models written for these tests, on random bars with gaps, after-hours rows and clock changes."""

import math
import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from wickwork.operators import indicators, joins, recurrence, resample
from wickwork.operators import series as series_module
from wickwork.streaming import bars as streaming

BAR = "source string, ticker string, tf_seconds long, ts timestamp_ntz, open double, high double, low double, close double, volume double"
INST = "source string, ticker string, tz string, open_sec int, close_sec int, day_anchor_sec int"
SESSIONS = {"utc": ("UTC", None, None, None), "ny": ("America/New_York", 34200, 57600, None), "anchor": ("America/New_York", None, None, 61200)}
TFS = [3600, 4 * 3600, 86400, 2 * 86400, 7 * 86400, 14 * 86400]


def series(seed, start, n, gap=0.2):
    rng, t, out = random.Random(seed), start, []
    for _ in range(n):
        t += timedelta(minutes=15 * (1 if rng.random() > gap else rng.randint(2, 60)))
        o, c = rng.uniform(50, 150), rng.uniform(50, 150)
        out.append((t, o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, float(rng.randint(1, 9))))
    return out


class Pusher:
    """Takes base bars one by one and keeps the forming bar and the closed ones."""

    def __init__(self, session, tf, base=900):
        self.zone, self.close, self.anchor = ZoneInfo(session[0]), session[2], session[3] or 0
        self.tf, self.base, self.now, self.closed = tf, base, None, []

    def utc(self, wall):
        return wall.replace(tzinfo=self.zone).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)

    def bounds(self, ts):
        wall = ts.replace(tzinfo=ZoneInfo("UTC")).astimezone(self.zone).replace(tzinfo=None)
        day = wall.replace(hour=0, minute=0, second=0)
        if self.tf % 604800 == 0:
            begin = day - timedelta(days=day.weekday())
            return self.utc(begin), self.utc(begin + timedelta(seconds=self.tf))
        ref = day + timedelta(seconds=self.anchor)
        if wall < ref:
            ref -= timedelta(days=1)
        begin = ref + timedelta(seconds=(wall - ref).total_seconds() // self.tf * self.tf)
        end = begin + timedelta(seconds=self.tf)
        if self.close and self.tf <= 86400:
            end = min(end, day + timedelta(seconds=self.close))
        return self.utc(begin), self.utc(end)

    def push(self, b):
        begin, end = self.bounds(b[0])
        if self.now and self.now[0] != begin:
            self.closed.append(self.now)
            self.now = None
        self.now = (begin, *b[1:]) if not self.now else (begin, self.now[1], max(self.now[2], b[2]), min(self.now[3], b[3]), b[4], self.now[5] + b[5])
        seen = self.now
        if b[0] + timedelta(seconds=self.base) >= end:
            self.closed.append(self.now)
            self.now = None
        return seen


@pytest.mark.parametrize("start", [datetime(2023, 3, 8), datetime(2023, 10, 20)])
def test_resampling(spark, monkeypatch, start):
    monkeypatch.setattr(series_module, "CELL", 3 * 86400)
    rows, inst, want_steps, want_closed = [], [], [], []
    for name, s in SESSIONS.items():
        inst.append(("s", name, *s))
        data = series(len(name) * 100 + start.month, start, 700)
        rows += [("s", name, 900, *b) for b in data]
        for tf in TFS:
            p = Pusher(s, tf)
            want_steps += [(name, tf, b[0], *p.push(b)) for b in data]
            want_closed += [(name, tf, *b) for b in p.closed]
    b, i = spark.createDataFrame(rows, BAR), spark.createDataFrame(inst, INST)
    cols = ("ts", "open", "high", "low", "close", "volume")
    steps = [(r["ticker"], r["tf_seconds"], r["step"], *(r[c] for c in cols)) for r in resample.forming(b, i, TFS, 900).collect()]
    assert sorted(steps) == sorted(want_steps)
    closed = [(r["ticker"], r["tf_seconds"], *(r[c] for c in cols)) for r in resample.closed(b, i, TFS, 900).collect()]
    assert sorted(closed) == sorted(want_closed)


def plain_smooth(values, period, keep, weight):
    out, e = [], None
    for n, v in enumerate(values, 1):
        e = None if n < period else sum(values[:period]) / period if n == period else keep * e + weight * v
        out.append(e)
    return out


@pytest.mark.parametrize("chunk", [7, 256])
def test_recurrence_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(recurrence, "CHUNK", chunk)
    rng = random.Random(2)
    values = [rng.uniform(-5, 100) for _ in range(900)]
    df = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(values)], "k string, n long, v double")
    for period in (1, 2, 14, 200):
        got = [r["e"] for r in recurrence.ema(df, {"e": F.col("v")}, "n", period, ("k",)).orderBy("n").collect()]
        k = 2 / (period + 1)
        want = plain_smooth(values, period, 1 - k, k)
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)) for a, b in zip(got, want, strict=True))
        got = [r["e"] for r in recurrence.wilder(df, {"e": F.col("v")}, "n", period, ("k",)).orderBy("n").collect()]
        want = plain_smooth(values, period, (period - 1) / period, 1 / period)
        assert all(a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_lookbacks_in_chunks(spark):
    data = series(8, datetime(2023, 5, 1), 400)
    b = indicators.numbered(spark.createDataFrame([("s", "utc", 900, *r) for r in data], BAR))
    assert [r["n"] for r in b.orderBy("ts").collect()] == list(range(1, 401))
    fns = {20: lambda x, by: indicators.bollinger(indicators.sma(x, 20, by=by), by=by), 2: lambda x, by: indicators.fair_value_gap(indicators.fractals(x, by), by)}
    for lookback, fn in fns.items():
        whole = sorted(map(str, fn(b, resample.SERIES).collect()))
        assert sorted(map(str, series_module.in_chunks(b, lookback, fn, resample.SERIES, rows=32).collect())) == whole


def test_forming_average_equals_full_history(spark):
    data = series(5, datetime(2023, 5, 1), 300)
    b = spark.createDataFrame([("s", "utc", 900, *r) for r in data], BAR)
    steps = resample.forming(b, spark.createDataFrame([("s", "utc", *SESSIONS["utc"])], INST), [3600], 900)
    closed = resample.bars_of(steps).where("is_closed")
    got = {r["step"]: (r["sma"], r["ema"]) for r in indicators.forming_ema(indicators.forming_sma(steps, closed, 5), closed, 5).collect()}
    p = Pusher(SESSIONS["utc"], 3600)
    for row in data:
        before = list(p.closed) + ([p.now] if p.now and p.now[0] != p.bounds(row[0])[0] else [])
        history = [x[4] for x in before] + [p.push(row)[4]]
        sma = sum(history[-5:]) / 5 if len(history) >= 5 else None
        ema = plain_smooth(history, 5, 1 - 2 / 6, 2 / 6)[-1]
        for a, w in zip(got[row[0]], (sma, ema), strict=True):
            assert (a is None) == (w is None) and (a is None or math.isclose(a, w, rel_tol=1e-9))


def test_asof_ties_and_strictness(spark):
    day = lambda d: datetime(2023, 1, d)
    left = spark.createDataFrame([("a", day(1)), ("a", day(2)), ("a", day(5)), ("b", day(5))], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", day(2), 1.0), ("a", day(4), None), ("c", day(1), 9.0)], "k string, r timestamp_ntz, v double")
    got = {(r["k"], r["t"]): r["v"] for r in joins.asof(left, right, ["k"], "t", "r", ["v"]).collect()}
    assert got == {("a", day(1)): None, ("a", day(2)): 1.0, ("a", day(5)): None, ("b", day(5)): None}
    got = {(r["k"], r["t"]): r["v"] for r in joins.asof(left, right, ["k"], "t", "r", ["v"], strict=True).collect()}
    assert got[("a", day(2))] is None


def test_asof_over_cells(spark):
    rng, t = random.Random(3), datetime(2023, 1, 1)
    at = lambda: t + timedelta(hours=rng.randint(0, 5000))
    left, right = [(rng.choice("ab"), at(), i) for i in range(300)], [(rng.choice("ab"), x, float(i)) for i, x in enumerate({at() for _ in range(40)})]
    l, r = spark.createDataFrame(left, "k string, t timestamp_ntz, i int"), spark.createDataFrame(right, "k string, r timestamp_ntz, v double")
    got = {x["i"]: x["v"] for x in joins.asof(l, r, ["k"], "t", "r", ["v"], cell=7 * 86400).collect()}
    assert got == {i: max(((y, v) for kk, y, v in right if kk == k and y <= x), default=(None, None))[1] for k, x, i in left}


def test_first_touch_opens_the_right_cells(spark):
    rng, t = random.Random(9), datetime(2023, 1, 1, 12)
    rows = [("s", "a", t + timedelta(hours=i), rng.uniform(90, 110)) for i in range(400)]
    bars = spark.createDataFrame([(s, k, x, v, v + 1, v - 1, v) for s, k, x, v in rows], "source string, ticker string, ts timestamp_ntz, open double, high double, low double, close double")
    orders = [(f"o{i}", "s", "a", rng.uniform(85, 115), t + timedelta(hours=rng.randint(0, 399)), None if i % 2 else t + timedelta(hours=rng.randint(0, 399))) for i in range(150)]
    o = spark.createDataFrame(orders, "order_id string, source string, ticker string, price double, created_at timestamp_ntz, cancelled_at timestamp_ntz")
    test = F.col("high") >= F.col("price")
    got = {r["order_id"]: r["hit_ts"] for r in joins.first_touch(o, bars, ["source", "ticker"], "order_id", "created_at", "cancelled_at", test, test, ["ts"]).collect()}
    want = {i: min(x for *_, x, v in rows if x > c and (e is None or x <= e) and v + 1 >= p) for i, _, _, p, c, e in orders if any(x > c and (e is None or x <= e) and v + 1 >= p for *_, x, v in rows)}
    assert got == want


def test_late_and_repeated_ticks(spark, tmp_path):
    """Two files in turn: repeated ticks count once, and one behind the watermark is dropped."""
    t = datetime(2024, 1, 1)
    schema = "source string, ticker string, ts timestamp, price double, volume double, seq long"
    src = str(tmp_path / "in")
    tick = lambda minutes, price, seq: ("s", "a", t + timedelta(minutes=minutes), price, 1.0, seq)
    for part in ([tick(1, 5.0, 1), tick(2, 7.0, 2), tick(2, 7.0, 2), tick(90, 6.0, 3)], [tick(3, 1.0, 4), tick(150, 6.0, 5)], [tick(400, 6.0, 6)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streaming.tumbling(streaming.unique_ticks(stream, "5 minutes"), 3600).writeStream.format("memory").queryName("late_bars").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["ts"]: (r["open"], r["close"], r["volume"], r["low"]) for r in spark.table("late_bars").collect()}
    assert got[t] in {(5.0, 7.0, 2.0, 5.0), (5.0, 1.0, 3.0, 1.0)}  # files come in any order; late only if the second is late
    assert got[t + timedelta(hours=1)] == (6.0, 6.0, 1.0, 6.0)
