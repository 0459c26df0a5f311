"""Worked examples with known values."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wickwork.functions import timeframe
from wickwork.operators import advisor, fills, indicators, metrics, resample, signals
from wickwork.sources import ingest

T0 = datetime(2023, 1, 2)
BAR = "source string, ticker string, tf_seconds long, ts timestamp_ntz, open double, high double, low double, close double, volume double"
INST = "source string, ticker string, tz string, open_sec int, close_sec int, day_anchor_sec int"
UTC, NY, ANCHOR = ("UTC", None, None, None), ("America/New_York", 34200, 57600, None), ("America/New_York", None, None, 61200)


def bars(spark, rows, step=timedelta(days=1), start=T0, secs=86400):
    """Rows of closes, or of (open, high, low, close)."""
    full = [(r, r, r, r) if isinstance(r, (int, float)) else r for r in rows]
    return indicators.numbered(spark.createDataFrame([("s", "a", secs, start + i * step, *map(float, r), 1.0) for i, r in enumerate(full)], BAR))


def last(df, *names):
    r = df.orderBy(F.col("n").desc()).first()
    return tuple(r[n] for n in names) if len(names) > 1 else r[names[0]]


def test_averages(spark):
    assert [r["sma"] for r in indicators.sma(bars(spark, [1, 2, 3, 4]), 3).orderBy("n").collect()] == [None, None, 2, 3]
    assert [r["ema"] for r in indicators.ema(bars(spark, [2, 4, 6, 8]), 3).orderBy("n").collect()] == [None, None, 4, 6]


def test_oscillators(spark):
    assert last(indicators.rsi(bars(spark, [1, 2, 3, 4, 5]), 3), "rsi") == 100
    assert last(indicators.rsi(bars(spark, list(range(1, 11))), 14), "rsi") is None
    assert last(indicators.atr(bars(spark, [(10, 11, 9, 10)] * 6), 3), "atr") == pytest.approx(2)
    assert all(v is not None for v in last(indicators.macd(bars(spark, list(range(1, 30))), 3, 6, 2), "macd", "signal", "hist"))
    lower, middle, upper = last(indicators.bollinger(bars(spark, [1, 2, 3, 4, 5]), 5), "lower", "middle", "upper")
    assert middle == 3 and lower < middle < upper and upper - middle == pytest.approx(2 * math.sqrt(2))


def test_adx(spark):
    rise = [(10 + 2 * i, 11 + 2 * i, 9 + 2 * i, 10 + 2 * i) for i in range(20)]
    adx, plus, minus = last(indicators.adx(bars(spark, rise), 5), "adx", "plus_di", "minus_di")
    assert plus > minus and 0 <= adx <= 100
    adx, plus, minus = last(indicators.adx(bars(spark, rise[::-1]), 5), "adx", "plus_di", "minus_di")
    assert minus > plus
    assert last(indicators.adx(bars(spark, rise[:9]), 5), "adx") is None and last(indicators.adx(bars(spark, rise[:10]), 5), "adx") is not None


def test_patterns(spark):
    f = indicators.fractals(bars(spark, [(0, 20, 10, 15), (0, 19, 8, 15), (0, 18, 9, 15)]))
    assert last(f, "fractal_up", "fractal_down") == (0, 1)
    f = indicators.fractals(bars(spark, [(0, 10, 5, 6), (0, 12, 6, 6), (0, 11, 7, 8)]))
    assert last(f, "fractal_up", "fractal_down") == (1, 0)
    g = indicators.fair_value_gap(bars(spark, [(8, 10, 7, 9), (9, 14, 9, 13), (13, 15, 12, 14)]))
    assert last(g, "bullish", "bearish", "gap_top", "gap_bottom") == (1, 0, 12, 10)
    g = indicators.fair_value_gap(bars(spark, [(22, 23, 20, 21), (20, 20, 15, 16), (16, 18, 14, 15)]))
    assert last(g, "bullish", "bearish", "gap_top", "gap_bottom") == (0, 1, 20, 18)


def inst(spark, session):
    return spark.createDataFrame([("s", "a", *session)], INST)


def ny(y, m, d, hh, mm=0):
    """New York winter or summer wall clock of 2023 in UTC."""
    return datetime(y, m, d, hh, mm) + timedelta(hours=4 if 3 < m < 11 else 5)


def quarter(spark, times, rows=None):
    rows = rows or [(100 + i, 101 + i, 99 + i, 100.5 + i) for i in range(len(times))]
    return spark.createDataFrame([("s", "a", 900, t, *map(float, r), 1.0) for t, r in zip(times, rows, strict=True)], BAR)


def test_forming_hour(spark):
    b = quarter(spark, [datetime(2023, 1, 2, 12, 0), datetime(2023, 1, 2, 12, 15)], [(15.55, 15.60, 15.50, 15.70), (15.70, 15.95, 15.65, 15.90)])
    s = resample.forming(b, inst(spark, UTC), [3600], 900).orderBy("step").collect()[-1]
    assert (s["ts"], s["open"], s["high"], s["low"], s["close"], s["volume"], s["is_closed"]) == (datetime(2023, 1, 2, 12), 15.55, 15.95, 15.50, 15.90, 2, False)


def test_sessions(spark):
    closed = lambda b, session, tf, base=900: resample.closed(b, inst(spark, session), [tf], base).orderBy("bar_no").collect()
    (r,) = closed(quarter(spark, [ny(2023, 1, 3, 9, 30), ny(2023, 1, 3, 9, 45)]), NY, 3600)
    assert r["ts"] == ny(2023, 1, 3, 9) and r["open"] == 100 and r["close"] == 101.5
    (r,) = closed(quarter(spark, [ny(2023, 1, 3, 9, 30) + timedelta(minutes=15 * i) for i in range(26)]), NY, 86400)
    assert r["ts"] == ny(2023, 1, 3, 0) and r["open"] == 100
    b = quarter(spark, [ny(2023, 1, 3, 15, 45), ny(2023, 1, 4, 9, 30)])
    assert len(closed(b, NY, 3600)) == 1
    hours = [("s", "a", 3600, ny(2023, 9, 5, 17) + timedelta(hours=i), 1.0 + i, 2.0 + i, float(i), 1.0 + i, 1.0) for i in range(8)]
    two = closed(spark.createDataFrame(hours, BAR), ANCHOR, 4 * 3600, 3600)
    assert [(r["ts"], r["open"], r["close"], r["high"]) for r in two] == [(ny(2023, 9, 5, 17), 1, 4, 5), (ny(2023, 9, 5, 21), 5, 8, 9)]


def test_timeframes(spark):
    got = spark.createDataFrame([("15m",), (" 1H",), ("1d",), ("1w",)], "t string").select(timeframe.seconds(F.col("t")).alias("s"), timeframe.label(timeframe.seconds(F.col("t"))).alias("l")).collect()
    assert [tuple(r) for r in got] == [(900, "15m"), (3600, "1h"), (86400, "1d"), (604800, "1w")]
    with pytest.raises(Exception, match="not a timeframe"):
        spark.createDataFrame([("3x",)], "t string").select(timeframe.seconds(F.col("t"))).collect()
    assert timeframe.finest([3600, 900]) == 900
    with pytest.raises(ValueError, match="no timeframe"):
        timeframe.finest([])
    with pytest.raises(ValueError, match="multiples"):
        timeframe.finest([2700, 7200])


def trade(spark, side="buy", sl=90.0, tp=110.0):
    return spark.createDataFrame([("t", "s", "a", side, T0 + timedelta(hours=1), sl, tp)], "trade_id string, source string, ticker string, side string, entry_time timestamp_ntz, stop_loss double, take_profit double")


@pytest.mark.parametrize(
    "third,side,sl,tp,price,reason",
    [((100, 115, 100, 105), "buy", 90, 110, 110, "take_profit"), ((100, 100, 85, 90), "buy", 90, 110, 90, "stop_loss"), ((100, 115, 85, 100), "buy", 90, 110, 90, "stop_loss"), ((100, 100, 85, 90), "sell", 110, 90, 90, "take_profit"), ((80, 85, 75, 80), "buy", 90, None, 80, "stop_loss")],
)
def test_brackets(spark, third, side, sl, tp, price, reason):
    b = bars(spark, [100, 100, third, 105], timedelta(hours=1), secs=3600)
    r = fills.bracket_exits(trade(spark, side, float(sl), tp and float(tp)), b).first()
    assert (r["exit_price"], r["exit_reason"], r["exit_time"]) == (price, reason, T0 + timedelta(hours=2))
    calm = fills.bracket_exits(trade(spark, side, 1.0 if side == "buy" else 999.0, None), b).first()
    assert calm["exit_reason"] is None and calm["exit_price"] is None


def test_clash_by_finer_bars(spark):
    b = bars(spark, [100, 100, (100, 115, 85, 100)], timedelta(hours=1), secs=3600)
    fine = bars(spark, [(100, 112, 99, 101), (101, 101, 85, 90)], timedelta(minutes=15), T0 + timedelta(hours=2), 900)
    r = fills.bracket_exits(trade(spark), b, fine=fine, secs=3600).first()
    assert (r["exit_reason"], r["exit_price"]) == ("take_profit", 110)


def test_costs(spark):
    c = lambda x: F.lit(float(x)) if isinstance(x, (int, float)) else F.lit(x)
    z = F.lit(0.0)
    row = spark.range(1).select(
        fills.commission(c("maker_taker"), c(100), c(2), c(1), c("taker"), z, c(-0.0002), c(0.0005), z, z, z).alias("taker"),
        fills.commission(c("maker_taker"), c(100), c(2), c(1), c("maker"), z, c(-0.0002), c(0.0005), z, z, z).alias("maker"),
        fills.commission(c("per_share"), c(100), c(0), c(1), c("taker"), z, z, z, c(0.01), c(1), z).alias("none"),
        fills.slipped_price(c(100), c("buy"), z, c(0.01), c(0.0002), c("taker")).alias("slip"),
        fills.slipped_price(c(100), c("buy"), z, c(0.01), c(0.0002), c("maker")).alias("no_slip"),
        fills.spread_price(c(100), c("buy"), c("last"), c(1), c("taker")).alias("half"),
        fills.spread_price(c(100), c("sell"), c("bid"), c(1), c("taker")).alias("bid_sell"),
        fills.risk_cash(c(100), c(50), c(50), c(1)).alias("no_risk"),
    ).first()
    assert row["taker"] == pytest.approx(0.1) and row["maker"] == pytest.approx(-0.04) and row["none"] == 0
    assert (row["slip"], row["no_slip"], row["half"], row["bid_sell"], row["no_risk"]) == (pytest.approx(100.02), 100, 100.5, 100, 0)


def test_combined_curve(spark):
    def run(symbols, curve, nets, entries):
        e = spark.createDataFrame([("s", k, T0 + timedelta(days=i), float(v)) for k in symbols for i, v in enumerate(curve)], "source string, ticker string, ts timestamp_ntz, equity double")
        t = spark.createDataFrame([("s", k, T0 + timedelta(days=en), T0 + timedelta(days=en + 1), float(n), i) for k in symbols for i, (n, en) in enumerate(zip(nets, entries, strict=True))], "source string, ticker string, entry_time timestamp_ntz, exit_time timestamp_ntz, net_pnl double, seq int")
        return [round(r["equity"], 6) for r in metrics.combined_curve(t, e, ["source", "ticker"], cell=86400).orderBy("ts", "ticker").collect()]

    assert run(["a"], [100, 102, 104.04], [2, 2.04], [0, 1]) == [102, 104.04]
    assert run(["a", "b"], [50, 51, 51], [1], [0]) == [102, 104.04]


def test_metrics_edges(spark):
    one = spark.createDataFrame([("s", "a", T0, 100.0)], "source string, ticker string, ts timestamp_ntz, equity double")
    r = metrics.curve_metrics(one, ["source", "ticker"]).first()
    assert all(r[c] is None for c in ("total_return", "cagr", "sharpe", "sortino", "max_drawdown"))
    won = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, net_pnl double")
    assert metrics.trade_stats(won, ["k"]).first()["profit_factor"] == math.inf


def test_ingest(spark):
    raw = spark.createDataFrame([(110000, 500, 800, 200, 1234, 28225440)], "low long, delta_open long, delta_high long, delta_close long, volume long, minutes long")
    r = ingest.decode_trendbars(raw, 60).first()
    assert (r["low"], r["open"], r["high"], r["close"]) == tuple(pytest.approx(v) for v in (1.10, 1.105, 1.108, 1.102)) and r["ts"] == datetime(2023, 8, 31, 23)
    have = bars(spark, [1, 2, 3, 4, 5], timedelta(hours=1), secs=3600)
    asked = spark.createDataFrame([("s", "a", 3600, T0, T0 + timedelta(hours=10)), ("s", "new", 3600, T0, T0 + timedelta(hours=1))], "source string, ticker string, tf_seconds long, start timestamp_ntz, end timestamp_ntz")
    gaps = {(r["ticker"], r["gap_start"], r["gap_end"]) for r in ingest.coverage_gaps(have, asked).collect()}
    assert gaps == {("a", T0 + timedelta(hours=4), T0 + timedelta(hours=10)), ("new", T0, T0 + timedelta(hours=1))}
    files = spark.createDataFrame([("x", '{"source":"stocks","tickers":["B","A"]}'), ("y", ' ["C"]')], "name string, text string")
    assert sorted(tuple(r) for r in ingest.universes(files).select("name", F.coalesce("source", F.lit("")), "ticker", "pos").collect()) == [("x", "stocks", "A", 1), ("x", "stocks", "B", 0), ("y", "", "C", 0)]


def test_bar_table(spark, tmp_path):
    b = bars(spark, [1, 2, 3], timedelta(days=20)).drop("n")
    ingest.write_bars(b, str(tmp_path / "t"))
    ingest.write_bars(b.where("close = 3").withColumn("close", F.lit(9.0)), str(tmp_path / "t"))
    held = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["close"] for r in held.collect()) == [1, 2, 9]
    got = ingest.in_range(held, "2023-01-02 00:00:00", "2023-01-22 00:00:00")
    assert got.count() == 2 and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in got._jdf.queryExecution().executedPlan().toString()


def test_decision_key(spark):
    import hashlib
    import json

    texts = ["plain", 'quote " back \\ tab\t line\n é 中 🙂 \x01', ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", advisor.decision_key(F.lit("m"), F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in rows} == {t: hashlib.sha256(json.dumps(["m", t]).encode()).hexdigest() for t in texts}


def test_failing_symbol(spark):
    b = bars(spark, [1, 2]).unionByName(bars(spark, [3, 4]).withColumn("ticker", F.lit("bad")))

    def step(x):
        if x["ticker"].iloc[0] == "bad":
            raise KeyError("no data")
        return x[["close"]].tail(1)

    good, bad = signals.scan(b, step, "close double", ["source", "ticker"])
    assert [r["close"] for r in good.collect()] == [2] and [(r["ticker"], r["error"]) for r in bad.collect()] == [("bad", "KeyError: 'no data'")]


def test_returns_by_cell(spark):
    rnd = random.Random(5)
    rows = [("s", k, datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(400)), i, float(rnd.randrange(-2, 50))) for k in ("a", "b") for i in range(300)]
    e = spark.createDataFrame(rows, "source string, ticker string, ts timestamp_ntz, seq long, equity double")
    got = {(r["ticker"], r["seq"]): (r["ret"], r["step_sec"], r["peak"], r["drawdown"]) for r in metrics.returns(e, ["source", "ticker"], ("ts", "seq"), 7200).collect()}
    for k in ("a", "b"):
        before, peak = None, -math.inf
        for _, _, ts, seq, eq in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[3])):
            peak = max(peak, eq)
            ret = eq / before[1] - 1 if before and before[1] > 0 else None
            assert got[k, seq] == (ret, (ts - before[0]).total_seconds() if before else None, peak, eq / peak - 1 if peak > 0 else 0.0)
            before = (ts, eq)
    wide = {r["ticker"]: r.asDict() for r in metrics.curve_metrics(e, ["source", "ticker"], ("ts", "seq")).collect()}
    for r in metrics.curve_metrics(e, ["source", "ticker"], ("ts", "seq"), 7200).collect():
        assert all(wide[r["ticker"]][c] == pytest.approx(v) for c, v in r.asDict().items())


def test_combined_result(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    eq = spark.createDataFrame([("s", "a", t(0), 100.0), ("s", "a", t(1), 110.0), ("s", "b", t(0), 100.0)], "source string, ticker string, ts timestamp_ntz, equity double")
    trades = spark.createDataFrame([("s", "a", t(1), t(3), 11.0, 1), ("s", "b", t(0), t(3), -50.0, 1)], "source string, ticker string, entry_time timestamp_ntz, exit_time timestamp_ntz, net_pnl double, seq long")
    r = metrics.combined_result(trades, eq, ["source", "ticker"]).first()
    assert r["total_return"] == pytest.approx(1.1 * 0.5 - 1) and r["max_drawdown"] == pytest.approx(-0.5)  # 200, 220, 110
    assert (r["num_trades"], r["win_rate"], r["net_pnl"]) == (2, 0.5, -39.0)
    alone = metrics.combined_result(trades.limit(0), eq, ["source", "ticker"]).first()
    assert alone["total_return"] is None and alone["num_trades"] == 0
    assert metrics.combined_result(trades.limit(0), eq.limit(0), ["source", "ticker"]).count() == 0


def test_trading_window(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    rows = spark.createDataFrame([(t(1), 5, 5), (t(2), 3, None), (t(3), 3, 1), (t(4), 3, 2), (t(5), 2, 2)], "ts timestamp_ntz, n long, other long")
    assert [r["ts"] for r in signals.trading_window(rows, F.lit(t(2)).cast("timestamp_ntz"), {"n": 3, "other": 2}).collect()] == [t(4)]
