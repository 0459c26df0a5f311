"""Queries over a running account and over open trades at an order's time; strategies with signal and time exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.functions import sessions
from wickwork.jobs import oracle as o
from wickwork.jobs import queries as q
from wickwork.operators import account, fills
from wickwork.operators.series import with_previous
from wickwork.schema import KEY, instruments
from wickwork.sources.scratch import written

CASH, RISK = 10_000.0, 0.01

#: First touch of a level and first signal of candidates ``cd`` over bars ``sg``; a close at an open wins over that bar's levels.
LEVELS = """eh AS (SELECT c.trade_id, min(b.ts) AS x FROM cd c JOIN sg b ON b.source = c.source AND b.ticker = c.ticker AND b.ts > c.entry_time
 AND CASE WHEN side = 'buy' THEN b.low <= stop_loss OR b.high >= take_profit ELSE b.high >= stop_loss OR b.low <= take_profit END GROUP BY 1),
e0 AS (SELECT c.*, b.ts AS x_ts, CASE WHEN b.ts IS NULL THEN NULL WHEN CASE WHEN side = 'buy' THEN b.low <= stop_loss ELSE b.high >= stop_loss END THEN 'stop_loss' ELSE 'take_profit' END AS x_reason, b.open AS x_open
 FROM cd c LEFT JOIN eh USING (trade_id) LEFT JOIN sg b ON b.source = c.source AND b.ticker = c.ticker AND b.ts = eh.x)"""


def _closed_sql(leave: str = "false", hold: int | None = None) -> str:
    """``ex``: the candidates with exit_time, exit_no, exit_reason and exit_price. ``leave`` is over side and bar ``b``."""
    held = f"OR b.n = c.signal_no + {1 + hold}" if hold is not None else ""
    return f"""{LEVELS},
el AS (SELECT c.trade_id, min(b.ts) AS y FROM cd c JOIN sg b ON b.source = c.source AND b.ticker = c.ticker AND b.ts >= c.entry_time AND {leave} GROUP BY 1),
ce AS (SELECT c.trade_id, min(b.next_ts) AS close_ts, arg_min(b.next_open, b.next_ts) AS close_open FROM cd c LEFT JOIN el USING (trade_id) JOIN sg b ON b.source = c.source AND b.ticker = c.ticker AND b.next_ts IS NOT NULL AND (b.ts = el.y {held}) GROUP BY 1),
e1 AS (SELECT e0.*, close_ts, close_open, close_ts IS NOT NULL AND (x_ts IS NULL OR close_ts <= x_ts) AS f FROM e0 LEFT JOIN ce USING (trade_id)),
e2 AS (SELECT * EXCLUDE (f), CASE WHEN f THEN close_ts ELSE x_ts END AS exit_time, CASE WHEN f THEN 'signal' ELSE x_reason END AS exit_reason, CASE WHEN f THEN close_open WHEN x_reason = 'stop_loss' THEN
 CASE WHEN side = 'buy' THEN least(stop_loss, x_open) ELSE greatest(stop_loss, x_open) END WHEN x_reason = 'take_profit' THEN CASE WHEN side = 'buy' THEN greatest(take_profit, x_open) ELSE least(take_profit, x_open) END END AS exit_price FROM e1),
ex AS (SELECT e2.*, b.n AS exit_no FROM e2 LEFT JOIN sg b ON b.source = e2.source AND b.ticker = e2.ticker AND b.ts = e2.exit_time)"""


def _gated_sql(rest: int = 0) -> str:
    free = f"CASE WHEN c.exit_no IS NULL THEN 1000000000 WHEN c.exit_reason = 'stop_loss' THEN c.exit_no + {rest} ELSE c.exit_no END"
    return f"""cn AS (SELECT *, row_number() OVER (PARTITION BY source, ticker ORDER BY signal_no) AS i FROM ex),
walk AS (SELECT source, ticker, i, true AS taken, {free} AS free FROM cn c WHERE i = 1
 UNION ALL SELECT c.source, c.ticker, c.i, c.signal_no >= w.free, CASE WHEN c.signal_no < w.free THEN w.free ELSE {free} END FROM walk w JOIN cn c ON c.source = w.source AND c.ticker = w.ticker AND c.i = w.i + 1),
bt AS (SELECT source, ticker, exit_price - entry_price AS net_pnl FROM cn JOIN walk USING (source, ticker, i) WHERE taken AND exit_time IS NOT NULL)"""


STATS = """\nSELECT source, ticker, count(*) AS num_trades, round(avg((net_pnl > 0)::INT), 6) + 0.0 AS win_rate, round(CASE WHEN count(*) FILTER (WHERE net_pnl < 0) = 0 THEN 'inf'::DOUBLE ELSE coalesce(sum(net_pnl) FILTER (WHERE net_pnl > 0), 0) / -sum(net_pnl) FILTER (WHERE net_pnl < 0) END, 6) + 0.0 AS profit_factor,
 round(sum(net_pnl), 6) + 0.0 AS net_pnl FROM bt GROUP BY 1, 2"""
_CD = "cd AS (SELECT source || ':' || ticker || ':' || n AS trade_id, source, ticker, n AS signal_no, 'buy' AS side, next_ts AS entry_time, next_open AS entry_price, close * {sl}::DOUBLE AS stop_loss, close * {tp}::DOUBLE AS take_profit FROM sg WHERE {enter} AND next_ts IS NOT NULL)"
BELOW = "coalesce(b.fast - b.slow < 1e-9, false)"


def _recursive(*ctes: str, final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


@q.job("strategy_sma_cross_exits", _recursive(*q.CROSS_CTES, _CD.format(sl=0.98, tp=1.04, enter=q.CROSS), _closed_sql(BELOW), _gated_sql(), final=STATS))
def strategy_sma_cross_exits(spark, sf_dir):
    """The flagship: signals, fills, levels and the exit signal (trades close at the open after fast < slow, unless a level is reached first), one position at a time."""
    return q._stats(q._walked(written(q._cross(spark, sf_dir), "signals"), leave=F.col("leave")))


_DROPS = (
    "re AS (SELECT ts, close, CASE WHEN n >= 5 THEN {} END AS ema FROM rl)".format(o.ema("v", 5)), f"pk AS (SELECT *, CASE WHEN n >= 24 THEN max(close) OVER ({o.W} ROWS 23 PRECEDING) END AS peak FROM nb)",
    "sg AS (SELECT p.*, coalesce(p.peak > 0 AND (p.peak - p.close) / p.peak >= 0.5, false) AND coalesce(r.close >= r.ema, false) AS enter, lead(p.ts) OVER k AS next_ts, lead(p.open) OVER k AS next_open FROM pk p ASOF LEFT JOIN re r ON p.ts >= r.ts WINDOW k AS (PARTITION BY p.source, p.ticker ORDER BY p.ts))",
)


@q.job(
    "strategy_drop_recovery",
    _recursive(
        o.bars(), o.NUMBERED, o.bars(q.DAY, "'all'", "ref_bars"), "rl AS (SELECT ts, close, row_number() OVER (ORDER BY ts) AS n, list(close) OVER (ORDER BY ts) AS v FROM ref_bars)", *_DROPS,
        _CD.format(sl=0.5, tp=2.0, enter="enter"), _closed_sql(hold=20), _gated_sql(5), final=STATS,
    ),
)
def strategy_drop_recovery(spark, sf_dir):
    """Drops while the market allows, closed at the open after 20 bars at the latest, and a rest of five bars after a stop."""
    return q._stats(q._walked(q._drops(spark, sf_dir), max_hold=20, cooldown=5))


# the account ----------------------------------------------------------------------------------------

_SELL = "coalesce(fast - slow < 1e-9 AND close < trend, false)"
_WAYS = f"""cd AS (SELECT source || ':' || ticker || ':' || n AS trade_id, source, ticker, n AS signal_no, side, close, next_ts AS entry_time, next_open AS entry_price, close * CASE WHEN side = 'buy' THEN 0.98 ELSE 1.02 END::DOUBLE AS stop_loss,
 close * CASE WHEN side = 'buy' THEN 1.04 ELSE 0.96 END::DOUBLE AS take_profit FROM (SELECT *, CASE WHEN {q.CROSS} THEN 'buy' WHEN {_SELL} THEN 'sell' END AS side FROM sg) WHERE side IS NOT NULL AND next_ts IS NOT NULL)"""
#: Prices after costs, fees and margins of a unit, and the carry paid up to a bar.
_UNITS = f"""cu AS (SELECT e.* EXCLUDE (entry_price, exit_price), i.contract_size AS cs, i.leverage, i.can_short, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sg, entry_price AS p0, exit_price AS p1, tick_size, price_basis, CASE WHEN side = 'buy' THEN 'sell' ELSE 'buy' END AS back,
 CASE WHEN asset_class = 'crypto' THEN 0.001 ELSE 0 END::DOUBLE AS fee, CASE WHEN asset_class = 'cfd' THEN 2 * tick_size ELSE 0 END AS points, CASE WHEN asset_class = 'crypto' THEN 0 ELSE 1 END AS ticks, CASE WHEN asset_class = 'crypto' THEN 0.0002 ELSE 0 END::DOUBLE AS pct,
 CASE WHEN asset_class = 'cfd' THEN 0.05 ELSE 0 END::DOUBLE AS annual FROM ex e JOIN inst i USING (source, ticker)),
cv AS (SELECT *, p0 + CASE WHEN price_basis = 'bid' THEN CASE WHEN side = 'buy' THEN points ELSE 0 END WHEN side = 'buy' THEN points / 2 ELSE -points / 2 END AS s0,
 CASE WHEN exit_reason = 'take_profit' THEN p1 ELSE p1 + CASE WHEN price_basis = 'bid' THEN CASE WHEN back = 'buy' THEN points ELSE 0 END WHEN back = 'buy' THEN points / 2 ELSE -points / 2 END END AS s1 FROM cu),
cw AS (SELECT *, s0 + sg * (ticks * tick_size + pct * s0) AS p, CASE WHEN exit_reason = 'take_profit' THEN s1 ELSE s1 - sg * (ticks * tick_size + pct * s1) END AS x FROM cv),
pd AS (SELECT source, ticker, n, sum(CASE WHEN d <> before THEN abs(prev) ELSE 0 END) OVER (PARTITION BY source, ticker ORDER BY n) AS paid FROM (SELECT b.source, b.ticker, b.n, lag(close) OVER k AS prev, ((b.ts AT TIME ZONE 'UTC') AT TIME ZONE tz)::DATE AS d,
 lag(((b.ts AT TIME ZONE 'UTC') AT TIME ZONE tz)::DATE) OVER k AS before FROM sg b JOIN inst USING (source, ticker) WINDOW k AS (PARTITION BY b.source, b.ticker ORDER BY b.n))),
od AS (SELECT c.*, s.paid AS paid_s, f.paid AS paid_f, y.paid AS paid_x, row_number() OVER (PARTITION BY c.source, c.ticker ORDER BY c.signal_no) AS i FROM cw c JOIN pd s ON s.source = c.source AND s.ticker = c.ticker AND s.n = c.signal_no
 JOIN pd f ON f.source = c.source AND f.ticker = c.ticker AND f.n = c.signal_no + 1 LEFT JOIN pd y ON y.source = c.source AND y.ticker = c.ticker AND y.n = c.exit_no)"""
#: Of each order what a unit of every order before has earned and binds at its close; the walk keeps the sizes taken so far.
_FOLD = f"""pr AS (SELECT a.source, a.ticker, a.i, b.i AS j, b.exit_no <= a.signal_no AS gone, CASE WHEN b.exit_no <= a.signal_no THEN (b.x - b.p) * b.sg * b.cs - abs(b.p * b.cs) * b.fee - abs(b.x * b.cs) * b.fee - b.cs * b.annual / 365 * (b.paid_x - b.paid_f)
 ELSE (a.close - b.p) * b.sg * b.cs - abs(b.p * b.cs) * b.fee - b.cs * b.annual / 365 * (a.paid_s - b.paid_f) END AS g, abs(b.p * b.cs) / b.leverage AS m FROM od a JOIN od b ON b.source = a.source AND b.ticker = a.ticker AND b.i < a.i),
gl AS (SELECT source, ticker, i, list(g ORDER BY j) AS g, list(CASE WHEN coalesce(gone, false) THEN 0 ELSE m END ORDER BY j) AS m, list(CASE WHEN coalesce(gone, false) THEN 0 ELSE 1 END::DOUBLE ORDER BY j) AS k FROM pr GROUP BY 1, 2, 3),
ol AS (SELECT o.*, list_prepend(0.0::DOUBLE, coalesce(g, []::DOUBLE[])) AS g, list_prepend(0.0::DOUBLE, coalesce(m, []::DOUBLE[])) AS m, list_prepend(0.0::DOUBLE, coalesce(k, []::DOUBLE[])) AS k FROM od o LEFT JOIN gl USING (source, ticker, i)),
walk AS (SELECT source, ticker, 0::BIGINT AS i, NULL::VARCHAR AS order_id, [0.0::DOUBLE] AS sizes, 0.0::DOUBLE AS equity, 0.0::DOUBLE AS used, 0::BIGINT AS opened, 0.0::DOUBLE AS size, NULL::VARCHAR AS status FROM ol WHERE i = 1
 UNION ALL SELECT source, ticker, i, trade_id, list_append(sizes, CASE WHEN status = 'accepted' THEN size ELSE 0 END), equity, used, opened, size, status
 FROM (SELECT *, CASE WHEN side = 'sell' AND NOT can_short AND opened = 0 THEN 'short' WHEN size * abs(close * cs) / leverage > equity - used + 1e-9 THEN 'margin' ELSE 'accepted' END AS status
 FROM (SELECT *, CASE WHEN abs(close - stop_loss) * cs > 0 THEN abs(equity * {RISK} / (abs(close - stop_loss) * cs)) ELSE 0 END AS size
 FROM (SELECT c.*, w.sizes, {CASH} + list_inner_product(w.sizes, c.g) AS equity, list_inner_product(w.sizes, c.m) AS used, list_inner_product(list_transform(w.sizes, lambda z: (z > 0)::DOUBLE), c.k)::BIGINT AS opened
 FROM walk w JOIN ol c ON c.source = w.source AND c.ticker = w.ticker AND c.i = w.i + 1))))"""


def _sized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders at every bar that calls for one, either way, with the fill and exit that each finds, costs a unit, and sizes of 1 % of the equity over the risk of a unit."""
    s = written(q._cross(spark, sf_dir), "signals")
    below = F.coalesce(F.col("leave") & (F.col("close") < F.col("trend")), F.lit(False))
    side = F.when(F.col("enter"), "buy").when(below, "sell")
    up = F.col("side") == "buy"
    c = s.withColumn("side", side).where("side is not null and next_ts is not null").select(
        F.concat_ws(":", *KEY, F.col("n").cast("string")).alias("trade_id"), *KEY, F.col("n").alias("signal_no"), "side", "close", F.col("next_ts").alias("entry_time"), F.col("next_open").alias("entry_price"),
        F.when(up, F.col("close") * 0.98).otherwise(F.col("close") * 1.02).alias("stop_loss"), F.when(up, F.col("close") * 1.04).otherwise(F.col("close") * 0.96).alias("take_profit"),
    )
    x = written(fills.bracket_exits(c, s), "order-exits")
    ends = lambda way, leave: fills.with_signal_close(fills.signal_closes(x.where(F.col("side") == way), s, leave))
    x = ends("buy", F.col("leave")).unionByName(ends("sell", F.coalesce(F.col("fast") > F.col("slow"), F.lit(False))))
    inst = fills.default_costs(instruments(s))
    x = _after_costs(x.join(inst, list(KEY)))
    dated = s.select(*KEY, "ts", "n", "close").join(inst.select(*KEY, "tz"), list(KEY)).withColumn("w_date", F.to_date(sessions.to_local("ts", "tz")))
    dated = with_previous(dated, KEY, "ts", {"prev_close": "close", "w_before": "w_date"})
    paid = written(account.carried(dated.withColumn("new_day", F.coalesce(F.col("w_date") != F.col("w_before"), F.lit(False)))), "carry")
    x = x.join(s.select(*KEY, F.col("ts").alias("exit_time"), F.col("n").alias("exit_no")), [*KEY, "exit_time"], "left").withColumn("fill_no", F.col("signal_no") + 1)
    for name in ("signal", "fill", "exit"):
        x = x.join(paid.select(*KEY, F.col("n").alias(f"{name}_no"), F.col("paid").alias(f"paid_{name}")), [*KEY, f"{name}_no"], "left")
    risk = F.abs(F.col("close") - F.col("stop_loss")) * F.col("contract_size")
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    return x.withColumn("order_id", F.col("trade_id")).withColumns(
        {"size_fixed": zero, "size_share": F.when(risk > 0, F.lit(RISK) / risk).otherwise(zero), "unit_margin": F.abs(F.col("close") * F.col("contract_size")) / F.col("leverage"), "fee_minimum": none, "exit_rest": F.lit(0)}
    )


def _after_costs(x: DataFrame) -> DataFrame:
    """Entry and exit prices after spread and slippage, and the fees of a unit."""
    c = F.col
    taker, out = fills.entry_liquidity(F.lit("market")), fills.exit_liquidity(c("exit_reason"))
    x = x.withColumn("w_back", F.when(c("side") == "buy", "sell").otherwise("buy"))

    def price(p: str, side: str, liquidity: Column) -> Column:
        return fills.slipped_price(fills.spread_price(c(p), c(side), c("price_basis"), c("spread_points"), liquidity), c(side), c("slip_ticks"), c("tick_size"), c("slip_percent"), liquidity)

    x = x.withColumn("entry_price", price("entry_price", "side", taker)).withColumn("exit_price", price("exit_price", "w_back", out))
    none = F.lit(0.0)
    fee = lambda p, liquidity: fills.commission(c("commission_model"), c(p), F.lit(1.0), c("contract_size"), liquidity, none, c("maker_rate"), c("taker_rate"), none, none, none)
    return x.withColumn("entry_fee", fee("entry_price", taker)).withColumn("exit_fee", fee("exit_price", out)).drop("w_back")


@q.job(
    "u7_equity_sized",
    _recursive(*q.CROSS_CTES, _WAYS, _closed_sql(f"CASE WHEN side = 'buy' THEN {BELOW} ELSE coalesce(b.fast - b.slow > 1e-9, false) END"), _UNITS, _FOLD,
               final="SELECT source, ticker, order_id, status, opened AS open_trades, round(equity, 6) + 0.0 AS equity, round(used, 6) + 0.0 AS used_margin, round(size, 6) + 0.0 AS size FROM walk WHERE i > 0"),
)
def u7_equity_sized(spark, sf_dir):
    """Orders either way sized by 1 % of the equity of the moment; rejected without margin, or as a short where none is allowed and nothing is open."""
    got = account.decide(_sized_orders(spark, sf_dir), CASH)
    # what has come back to zero within rounding is zero
    return q.rounded(got.select(*KEY, "order_id", "status", "open_trades", "equity", "used_margin", "size"))


@q.job(
    "f4_open_at_order",
    o.sql(
        *q.BLOTTER,
        "od AS (SELECT source || ':' || ticker || ':' || n AS order_id, source, ticker, CASE WHEN n % 3 = 0 THEN 'buy' ELSE 'sell' END AS side, ts AS created_at FROM nb)",
        final="""SELECT order_id, od.side, count(t.trade_id) AS open_trades, round(coalesce(sum(abs(t.entry_price * t.size * t.contract_size) / t.leverage), 0), 4) + 0.0 AS used_margin,
 od.side = 'sell' AND length(od.ticker) % 3 <> 2 AND count(t.trade_id) = 0 AS rejected FROM od LEFT JOIN blotter t ON t.source = od.source AND t.ticker = od.ticker AND t.entry_time <= created_at AND (t.exit_time IS NULL OR t.exit_time > created_at) GROUP BY order_id, od.side, od.ticker""",
    ),
)
def f4_open_at_order(spark, sf_dir):
    """how many trades are open at an order's time and the margin they use; a sell where none may be sold short is rejected only without any."""
    bars, trades = q._blotter(spark, sf_dir)
    side = F.when(F.col("n") % 3 == 0, "buy").otherwise("sell")
    orders = bars.select(F.concat_ws(":", *KEY, F.col("n").cast("string")).alias("order_id"), *KEY, side.alias("side"), F.col("ts").alias("created_at"))
    got = account.open_as_of(orders, trades).join(instruments(bars).select(*KEY, "can_short"), list(KEY))
    return q.rounded(got.select("order_id", "side", "open_trades", "used_margin", fills.rejected(F.col("side"), F.col("can_short"), F.col("open_trades") > 0).alias("rejected")), 4)


# levels, sweeps, stored bars ---------------------------------------------------------------------------

_CHANGES = """ch AS (SELECT trade_id, b.ts AS moved, CASE WHEN (side = 'buy') = (b.close > t.entry_price) AND b.close <> t.entry_price THEN b.close * CASE WHEN side = 'buy' THEN 0.7 ELSE 1.3 END::DOUBLE END AS stop_loss,
 CASE WHEN (side = 'buy') <> (b.close > t.entry_price) AND b.n > t.n + 6 THEN t.entry_price * CASE WHEN side = 'buy' THEN 1.2 ELSE 0.8 END::DOUBLE END AS take_profit FROM tr t JOIN nb b ON b.source = t.source AND b.ticker = t.ticker AND b.n BETWEEN t.n + 1 AND t.n + 12),
ev AS (SELECT trade_id, b.ts, 1 AS k, b.open, b.high, b.low, NULL::DOUBLE AS sl, NULL::DOUBLE AS tp FROM tr t JOIN nb b ON b.source = t.source AND b.ticker = t.ticker AND b.ts > t.entry_time
 UNION ALL SELECT trade_id, moved, 2, NULL, NULL, NULL, stop_loss, take_profit FROM ch WHERE stop_loss IS NOT NULL OR take_profit IS NOT NULL UNION ALL SELECT trade_id, entry_time, 0, NULL, NULL, NULL, stop_loss, take_profit FROM tr),
lv AS (SELECT *, last_value(sl IGNORE NULLS) OVER w AS stop, last_value(tp IGNORE NULLS) OVER w AS target FROM ev WINDOW w AS (PARTITION BY trade_id ORDER BY ts, k ROWS UNBOUNDED PRECEDING)),
hx AS (SELECT trade_id, arg_min({'ts': ts, 'o': open, 's': CASE WHEN side = 'buy' THEN low <= stop ELSE high >= stop END, 'stop': stop, 'target': target}, ts) AS h FROM lv JOIN (SELECT trade_id, side FROM tr) USING (trade_id)
 WHERE k = 1 AND CASE WHEN side = 'buy' THEN low <= stop OR high >= target ELSE high >= stop OR low <= target END GROUP BY 1)"""


@q.job(
    "f8_level_changes",
    o.sql(
        *q.TRADE_BASE[:4], _CHANGES,
        final="""SELECT trade_id, side, h.ts AS exit_time, CASE WHEN h.s THEN 'stop_loss' WHEN h.ts IS NOT NULL THEN 'take_profit' END AS exit_reason, round(h.stop, 6) AS stop_loss, round(h.target, 6) AS take_profit,
 round(CASE WHEN h.s THEN CASE WHEN side = 'buy' THEN least(h.stop, h.o) ELSE greatest(h.stop, h.o) END ELSE CASE WHEN side = 'buy' THEN greatest(h.target, h.o) ELSE least(h.target, h.o) END END, 6) AS exit_price FROM tr LEFT JOIN hx USING (trade_id)""",
    ),
)
def f8_level_changes(spark, sf_dir):
    """F8: levels moved by a table of changes (any number a trade, a null leaves a level as it is), the first touch of each stretch of constant levels."""
    b = q._numbered(spark, sf_dir)
    t = written(q._trades(b), "moved-trades")
    near = b.select(*KEY, F.col("n").alias("w_n"), F.col("ts").alias("at"), F.col("close").alias("w_close"))
    up, won = F.col("side") == "buy", F.when(F.col("side") == "buy", F.col("w_close") > F.col("entry_price")).otherwise(F.col("w_close") < F.col("entry_price"))
    lost = F.when(F.col("side") == "buy", F.col("w_close") <= F.col("entry_price")).otherwise(F.col("w_close") > F.col("entry_price"))
    ch = t.withColumn("w_n", F.explode(F.sequence(F.col("n") + 1, F.col("n") + 12))).join(near, [*KEY, "w_n"]).select(
        "trade_id", "at", F.when(won, F.col("w_close") * F.when(up, F.lit(0.7)).otherwise(F.lit(1.3))).alias("stop_loss"),
        F.when(lost & (F.col("w_n") > F.col("n") + 6), F.col("entry_price") * F.when(up, F.lit(1.2)).otherwise(F.lit(0.8))).alias("take_profit"),
    )
    x = fills.moving_exits(t, written(ch.where("stop_loss is not null or take_profit is not null"), "level-changes"), b)
    return q.rounded(x.select("trade_id", "side", "exit_time", "exit_reason", "stop_loss", "take_profit", "exit_price"))


SETS = [(5, 20), (10, 30), (20, 60), (5, 60)]
_PERIODS = sorted({p for s in SETS for p in s})


@q.job(
    "u8_sweep_curves",
    o.sql(
        o.bars(), o.NUMBERED, *[f"a{p} AS (SELECT source, ticker, n, {p} AS p, CASE WHEN n >= {p} THEN avg(close) OVER ({o.W} ROWS {p - 1} PRECEDING) END AS a FROM nb)" for p in _PERIODS],
        "al AS (" + " UNION ALL ".join(f"SELECT * FROM a{p}" for p in _PERIODS) + ")",
        "ps AS (SELECT b.source, b.ticker || '#' || fp || '/' || sp AS ticker, b.ts, b.close, coalesce(f.a - s.a > 1e-9, false)::INT * 0.0001::DOUBLE AS held FROM nb b JOIN (VALUES " + ", ".join(map(str, SETS)) + ") pm(fp, sp) ON true JOIN al f ON f.p = fp AND f.source = b.source AND f.ticker = b.ticker AND f.n = b.n JOIN al s ON s.p = sp AND s.source = b.source AND s.ticker = b.ticker AND s.n = b.n)",
        "rt AS (SELECT *, lag(held) OVER k * (close / nullif(lag(close) OVER k, 0) - 1) AS r FROM ps WINDOW k AS (PARTITION BY source, ticker ORDER BY ts))",
        "eq AS (SELECT source, ticker, ts, r, exp(sum(ln(greatest(1 + coalesce(r, 0), 1e-300))) OVER (PARTITION BY source, ticker ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS equity FROM rt)", q.METRICS.replace("CASE WHEN prev > 0 THEN equity / prev - 1 END AS ret", "r AS ret"),
        final=f"SELECT source, split_part(ticker, '#', 1) AS ticker, split_part(ticker, '#', 2) AS param_id, {q._out('total_return', 'cagr', 'sharpe', 'sortino', 'max_drawdown')} FROM mt",
    ),
)
def u8_sweep_curves(spark, sf_dir):
    """U8, M1 to M6 per parameter set: a ten-thousandth of the equity long while the fast average is above the slow one; all sets' curves side by side on one row per bar."""
    from wickwork.operators import indicators, metrics

    b = q._numbered(spark, sf_dir)
    b = indicators.averages(b, {f"a{p}": (p, "close") for p in _PERIODS}, KEY)
    held = F.array(*[F.coalesce((F.col(f"a{f}") - F.col(f"a{s}") > 1e-9).cast("double") * 0.0001, F.lit(0.0)) for f, s in SETS])
    return q.rounded(metrics.sweep_metrics(b, held, [f"{f}/{s}" for f, s in SETS], list(KEY)))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A bars table built by three appends: the past, a later stretch, and a correction of part of both; with the bars themselves."""
    from wickwork.sources import ingest, ticks
    from wickwork.sources.scratch import path

    b = written(ticks.base_bars(ticks.order_ticks(spark, sf_dir), q.DAY), "order-bars")
    table = path(spark, "bars-table")
    ingest.append_bars(table, b.where("ts < TIMESTAMP_NTZ '1999-01-01 00:00:00'"), 1)
    ingest.append_bars(table, b.where("ts >= TIMESTAMP_NTZ '1998-11-01 00:00:00'"), 2)
    ingest.append_bars(table, b.where("ts >= TIMESTAMP_NTZ '1998-12-15 00:00:00' and ts < TIMESTAMP_NTZ '1999-02-10 00:00:00'").withColumn("close", F.col("close") + 1), 3)
    return table, b


_CORRECTED = "CASE WHEN ts >= TIMESTAMP '1998-12-15' AND ts < TIMESTAMP '1999-02-10' THEN close + 1 ELSE close END AS close"


@q.job("s1_appended_table", o.sql(o.order_bars(), final=f"SELECT source, ticker, tf_seconds, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM (SELECT * REPLACE ({_CORRECTED.removesuffix(' AS close')} AS close) FROM bars)"))
def s1_appended_table(spark, sf_dir):
    """A bars table appended to and corrected by the months that change; read back whole."""
    table, b = _stored(spark, sf_dir)
    return q.rounded(spark.read.parquet(table).select(*b.columns))


@q.job(
    "s2_pruned_read",
    o.sql(
        o.order_bars(), o.INST, "h AS (SELECT source, ticker, TIMESTAMP '1999-06-01' - to_seconds(floor(1.5 * CASE WHEN close_sec IS NULL THEN 65 * 86400 ELSE 65 * 86400 / greatest((close_sec - open_sec) / 86400.0, 0.05) * 7 / 5 END)::BIGINT) AS start FROM inst)",
        final=f"SELECT b.source, b.ticker, ts, round({_CORRECTED.removesuffix(' AS close')}, 6) AS close, volume FROM bars b JOIN h USING (source, ticker) WHERE ts >= start AND ts <= TIMESTAMP '1999-08-31'",
    ),
)
def s2_pruned_read(spark, sf_dir):
    """A stored table read from each key's own lead-in start on, both ends included; months outside are pruned."""
    from wickwork.functions import timeframe
    from wickwork.sources import ingest

    table, b = _stored(spark, sf_dir)
    inst = instruments(b).withColumn("s", timeframe.lead_in_seconds(F.lit(50), F.lit(q.DAY), F.lit(q.DAY), F.col("open_sec"), F.col("close_sec")))
    starts = written(inst.select(*KEY, F.expr("timestampadd(SECOND, -cast(floor(s) as bigint), TIMESTAMP_NTZ'1999-06-01 00:00:00')").alias("start")), "starts")
    got = ingest.read_from(table, starts, "1999-08-31 00:00:00", spark.read.parquet(table).schema)
    return q.rounded(got.select(*KEY, "ts", "close", "volume"))


@q.job("d3_work_list", o.sql(o.bars(), o.NUMBERED, o.steps([4 * q.HOUR], q.HOUR), q.TRADES, q.CONTEXT, final="SELECT DISTINCT key FROM ky WHERE side = 'buy' AND key NOT IN (SELECT key FROM ky WHERE side = 'sell')"))
def d3_work_list(spark, sf_dir):
    """D3: the distinct keys without a stored decision, which need a call."""
    from wickwork.operators import advisor

    c = written(q._contexts(spark, sf_dir).select("trade_id", "side", "key"), "contexts")
    stored = c.where("side = 'sell'").select("key", F.lit(True).alias("approved"), F.lit("m1").alias("model_id"))
    return advisor.lookup(c, stored)[1]


@q.job("m6_drawdown_series", o.sql(*q.BLOTTER, q.EQUITY, q.METRICS, final="SELECT source, ticker, ts, round(peak, 4) + 0.0 AS peak, round(equity - peak, 4) + 0.0 AS below_peak FROM r1"))
def m6_drawdown_series(spark, sf_dir):
    """M6: the plotted series, equity less its running peak."""
    from wickwork.operators import metrics

    r = metrics.returns(q._equity(spark, sf_dir)[0], list(KEY))
    return q.rounded(r.select(*KEY, "ts", "peak", (F.col("equity") - F.col("peak")).alias("below_peak")), 4)


@q.job(
    "t9_equity_window",
    o.sql(*q.BLOTTER, q.EQUITY, final="SELECT source, ticker, ts, round(equity, 4) AS equity FROM eq JOIN (SELECT source, ticker, ts, n FROM nb) USING (source, ticker, ts) WHERE ts >= TIMESTAMP '2024-01-10' AND n >= 30"),
)
def t9_equity_window(spark, sf_dir):
    """Equity rows of the trading window alone, once the bars seen are as many as the longest lookback needs."""
    from wickwork.operators import signals

    bars, _ = q._blotter(spark, sf_dir)
    rows = q._equity(spark, sf_dir)[0].select(*KEY, "ts", "equity").join(bars.select(*KEY, "ts", "n"), [*KEY, "ts"])
    return q.rounded(signals.trading_window(rows, F.lit("2024-01-10").cast("timestamp_ntz"), {"n": 30}).select(*KEY, "ts", "equity"), 4)


@q.job(
    "x3_stream_indicators",
    o.sql(
        o.bars(), o.NUMBERED, q.LISTS, q.CHANGES, q.RSI, f"h AS (SELECT *, CASE WHEN n >= 15 THEN {o.wilder('up', 14)} END AS u, CASE WHEN n >= 15 THEN {o.wilder('dn', 14)} END AS d FROM g)",
        final=f"""SELECT v.source, v.ticker, v.ts, v.n, CASE WHEN v.n >= 20 THEN round(list_sum(v.v[-20:]) / 20, 6) END AS sma, CASE WHEN v.n >= 20 THEN round({o.ema('v.v', 20)}, 6) END AS ema,
 round(CASE WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + u / d) END, 6) AS rsi FROM v JOIN h USING (source, ticker, ts) WHERE v.ts <= (SELECT max(ts) - INTERVAL 3 HOUR FROM bars)""",
    ),
)
def x3_stream_indicators(spark, sf_dir):
    """SMA, EMA and RSI with keyed state over a stream of hourly bars, a third of which arrive two hours late; every bar that the watermark has passed."""
    from wickwork.sources import ticks
    from wickwork.sources.scratch import path
    from wickwork.streaming import indicators as live

    b = written(ticks.event_bars(spark, sf_dir, q.HOUR), "hours")
    late = F.when(F.pmod(F.xxhash64(*KEY, "ts"), F.lit(3)) == 0, F.expr("ts + INTERVAL '2' HOUR")).otherwise(F.col("ts"))
    b = b.select(*KEY, F.col("ts").cast("timestamp").alias("ts"), "close", F.floor(F.datediff(late, F.lit("2024-01-01").cast("date")) / 12).alias("part"))
    where = path(spark, "stream-in")
    # the bars that arrive in a stretch of days are a folder, in the order of the stretches
    b.repartition("part").sortWithinPartitions(F.xxhash64(*KEY, "ts")).write.partitionBy("part").parquet(where)
    with live.with_rocksdb(spark):
        stream = spark.readStream.schema(b.schema).parquet(where).withWatermark("ts", "3 hours")
        out = q._drained(spark, live.running(stream, 20, 14))
    return q.rounded(out.select(*KEY, F.col("ts").cast("timestamp_ntz").alias("ts"), "n", "sma", "ema", "rsi"))


@q.job(
    "i10_forming_function",
    o.sql(
        o.bars(), o.steps([4 * q.HOUR], q.HOUR),
        "cp AS (SELECT source, ticker, tf_seconds, bar_no + 1 AS nx, max(high) OVER k AS h, min(low) OVER k AS l, avg(close) OVER k AS m, count(*) OVER k AS c FROM closed WINDOW k AS (PARTITION BY source, ticker, tf_seconds ORDER BY bar_no ROWS 8 PRECEDING))",
        final="""SELECT s.source, s.ticker, s.step, CASE WHEN s.bar_no >= 10 THEN round(greatest(h, s.high), 6) END AS top, CASE WHEN s.bar_no >= 10 THEN round(least(l, s.low), 6) END AS bottom, CASE WHEN s.bar_no >= 10 THEN round((m * c + s.close) / (c + 1), 6) END AS middle
 FROM steps s LEFT JOIN cp ON cp.source = s.source AND cp.ticker = s.ticker AND cp.tf_seconds = s.tf_seconds AND cp.nx = s.bar_no""",
    ),
)
def i10_forming_function(spark, sf_dir):
    """A user's pandas function (a channel with its middle) as seen at every hourly step of four-hour bars."""
    import pandas as pd

    from wickwork.operators import indicators, resample

    def channel(bars):
        return pd.DataFrame({"hi": bars["high"].rolling(10).max(), "lo": bars["low"].rolling(10).min(), "mid": bars["close"].rolling(10).mean()})

    steps = written(q._steps(spark, sf_dir, [4 * q.HOUR]), "steps")
    got = indicators.forming_function(steps, resample.bars_of(steps).where("is_closed"), channel, ["top", "bottom", "middle"], 10)
    return q.rounded(got.select(*KEY, "step", "top", "bottom", "middle"))
