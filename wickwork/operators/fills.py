"""Orders, fills, brackets, sizing and costs as columns and joins.

Order of events in a bar: financing, signal closes at the open, stops and targets of trades opened on earlier bars, entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.operators import joins
from wickwork.operators.series import with_following, with_previous, with_running
from wickwork.schema import KEY


def with_next(bars: DataFrame, by=KEY) -> DataFrame:
    """Adds ``next_ts`` and ``next_open``: where a market order or signal close of this bar fills."""
    return with_following(bars, tuple(by), "ts", {"next_ts": "ts", "next_open": "open"})


def touched(kind: Column, side: Column, price: Column) -> Column:
    """Whether a bar (or a cell's extremes) reaches a resting order."""
    down = ((kind == "limit") & (side == "buy")) | ((kind == "stop") & (side == "sell"))
    return F.when(down, F.col("low") <= price).otherwise(F.col("high") >= price)


def resting_price(kind: Column, side: Column, price: Column, open_: Column) -> Column:
    """Limit orders fill at their price or a better open, stop orders at their price or a worse open."""
    low = ((kind == "limit") & (side == "buy")) | ((kind == "stop") & (side == "sell"))
    return F.when(low, F.least(price, open_)).otherwise(F.greatest(price, open_))


def fill_resting(orders: DataFrame, bars: DataFrame, by=KEY) -> DataFrame:
    """Limit and stop orders with ``fill_ts`` and ``fill_price`` of the first later bar, null while they rest.

    ``orders``: order_id, key, type, side, price, created_at, cancelled_at (null: good till cancelled).
    """
    test = touched(F.col("type"), F.col("side"), F.col("price"))
    hit = joins.first_touch(orders, bars, list(by), "order_id", "created_at", "cancelled_at", test, test, ["ts", "open"])
    out = orders.join(hit, "order_id", "left")
    return out.withColumn("fill_ts", F.col("hit_ts")).withColumn("fill_price", F.when(F.col("hit_ts").isNotNull(), resting_price(F.col("type"), F.col("side"), F.col("price"), F.col("hit_open")))).drop("hit_ts", "hit_open")


def rejected(side: Column, can_short: Column, has_open_trade: Column) -> Column:
    """A sell on an instrument that cannot be shorted, without any open trade."""
    return (side == "sell") & ~can_short & ~has_open_trade


def bracket_exits(trades: DataFrame, bars: DataFrame, by=KEY, fine: DataFrame | None = None, secs: int | None = None, until: str | None = None) -> DataFrame:
    """Trades with ``exit_time``, ``exit_price`` and ``exit_reason`` of the first later bar that reaches a level.

    ``trades``: trade_id, key, side (buy or sell), entry_time, stop_loss, take_profit (either may be null); ``until``: a column with the last bar that counts (null: no end). Where a bar
    reaches both, the finer bars decide if given (stop first within one), else the stop counts.
    """
    long = F.col("side") == "buy"
    sl = F.when(long, F.col("low") <= F.col("stop_loss")).otherwise(F.col("high") >= F.col("stop_loss"))
    tp = F.when(long, F.col("high") >= F.col("take_profit")).otherwise(F.col("low") <= F.col("take_profit"))
    either = F.coalesce(sl, F.lit(False)) | F.coalesce(tp, F.lit(False))
    hit = joins.first_touch(trades, bars, list(by), "trade_id", "entry_time", until, either, either, ["ts", "open", "high", "low"])
    out = trades.join(hit, "trade_id", "left")
    at = lambda c: F.col(f"hit_{c}")
    hit_sl = F.coalesce(F.when(long, at("low") <= F.col("stop_loss")).otherwise(at("high") >= F.col("stop_loss")), F.lit(False))
    hit_tp = F.coalesce(F.when(long, at("high") >= F.col("take_profit")).otherwise(at("low") <= F.col("take_profit")), F.lit(False))
    out = out.withColumn("w_sl", hit_sl).withColumn("w_tp", hit_tp)
    reason = F.when(F.col("w_sl"), F.lit("stop_loss")).when(F.col("w_tp"), F.lit("take_profit"))
    if fine is not None:
        clash = out.where("w_sl and w_tp").select("trade_id", *by, "side", "stop_loss", "take_profit", F.col("hit_ts").alias("bar_ts"))
        sub = joins.sub_bars(clash, fine, list(by), "bar_ts", secs, ["high", "low"])
        s_sl = F.when(long, F.col("sub_low") <= F.col("stop_loss")).otherwise(F.col("sub_high") >= F.col("stop_loss"))
        s_tp = F.when(long, F.col("sub_high") >= F.col("take_profit")).otherwise(F.col("sub_low") <= F.col("take_profit"))
        decided = sub.withColumn("w_r", F.when(s_sl, F.lit("stop_loss")).when(s_tp, F.lit("take_profit"))).where("w_r is not null").groupBy("trade_id").agg(F.min_by("w_r", "sub_ts").alias("w_fine"))
        out = out.join(decided, "trade_id", "left")
        reason = F.when(F.col("w_sl") & F.col("w_tp"), F.coalesce("w_fine", F.lit("stop_loss"))).otherwise(reason)
    out = out.withColumn("exit_reason", reason).withColumn("exit_time", at("ts"))
    worst = F.when(long, F.least("stop_loss", "hit_open")).otherwise(F.greatest("stop_loss", "hit_open"))
    best = F.when(long, F.greatest("take_profit", "hit_open")).otherwise(F.least("take_profit", "hit_open"))
    out = out.withColumn("exit_price", F.when(F.col("exit_reason") == "stop_loss", worst).when(F.col("exit_reason") == "take_profit", best))
    return out.drop("w_sl", "w_tp", "w_fine", "hit_ts", "hit_open", "hit_high", "hit_low")


def level_stretches(trades: DataFrame, changes: DataFrame) -> DataFrame:
    """Stretches of constant levels of each trade: trade_id, part_id, ``w_after``, ``w_until`` (null: to the end), stop_loss and take_profit.

    ``changes``: trade_id, at, stop_loss, take_profit. A null leaves that level as it is; a change counts for the bars after ``at``, the last one
    (by ``seq``, if there is such a column) of several at one time; changes before the entry bar are ignored. A trade may have any number of changes.
    """
    seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
    first = trades.select("trade_id", F.col("entry_time").alias("w_after"), F.lit(None).cast("long").alias("w_seq"), "stop_loss", "take_profit", F.col("entry_time").alias("w_entry"))
    later = changes.select("trade_id", F.col("at").alias("w_after"), seq.alias("w_seq"), "stop_loss", "take_profit").join(trades.select("trade_id", F.col("entry_time").alias("w_entry")), "trade_id")
    rows = first.unionByName(later.where("w_after >= w_entry"))
    order = Window.partitionBy("trade_id").orderBy("w_after", F.col("w_seq").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("stop_loss", "take_profit")}).withColumns({"w_until": F.lead("w_after").over(order), "w_no": F.row_number().over(order)})
    rows = rows.where("w_until is null or w_until > w_after")  # of changes at one time the last
    return rows.select("trade_id", F.concat_ws("/", "trade_id", "w_no").alias("part_id"), "w_after", "w_until", "stop_loss", "take_profit")


def moving_exits(trades: DataFrame, changes: DataFrame, bars: DataFrame, by=KEY, fine: DataFrame | None = None, secs: int | None = None) -> DataFrame:
    """Trades whose levels ``changes`` (see ``level_stretches``) move, with exit_time, exit_price, exit_reason and the levels then in force: one first touch per stretch."""
    parts = level_stretches(trades, changes).join(trades.select("trade_id", *by, "side"), "trade_id")
    parts = parts.select(F.col("trade_id").alias("w_trade"), F.col("part_id").alias("trade_id"), *by, "side", F.col("w_after").alias("entry_time"), "w_until", "stop_loss", "take_profit")
    x = bracket_exits(parts, bars, by, fine, secs, "w_until").where("exit_time is not null")
    hit = x.groupBy(F.col("w_trade").alias("trade_id")).agg(F.min_by(F.struct("exit_time", "exit_price", "exit_reason", "stop_loss", "take_profit"), "exit_time").alias("w_x"))
    out = trades.drop("stop_loss", "take_profit").join(hit, "trade_id", "left")
    return out.select(*[c for c in trades.columns if c not in ("stop_loss", "take_profit")], *[F.col(f"w_x.{c}").alias(c) for c in ("exit_time", "exit_price", "exit_reason", "stop_loss", "take_profit")])


def with_signal_close(exits: DataFrame, close_ts: str = "close_ts", close_open: str = "close_open") -> DataFrame:
    """A signal close at a bar's open comes before that bar's levels; it wins ties."""
    first = F.col(close_ts).isNotNull() & (F.col("exit_time").isNull() | (F.col(close_ts) <= F.col("exit_time")))
    return (
        exits.withColumn("exit_price", F.when(first, F.col(close_open)).otherwise(F.col("exit_price")))
        .withColumn("exit_reason", F.when(first, F.lit("signal")).otherwise(F.col("exit_reason")))
        .withColumn("exit_time", F.when(first, F.col(close_ts)).otherwise(F.col("exit_time")))
    )


def signal_closes(trades: DataFrame, bars: DataFrame, leave: Column | None = None, max_hold: int | None = None, by=KEY) -> DataFrame:
    """Adds ``close_ts`` and ``close_open``: the open after the first bar of the trade's life that says ``leave`` or, if earlier, after
    ``max_hold`` bars from the first bar on which the trade was seen open; null where no bar follows.

    ``trades``: key, signal_no, entry_time. ``bars``: key, ts, n, next_ts, next_open and the columns of ``leave``.
    """
    out, ends = trades, []
    if leave is not None:
        # the first bar at or after a time is the last one at or before it on a clock that runs backwards
        back = lambda c: F.expr(f"timestampadd(SECOND, -timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01', {c}), TIMESTAMP_NTZ '1970-01-01')")
        right = bars.where(leave).select(*by, back("ts").alias("w_back"), F.struct("next_ts", "next_open").alias("w_leave"))
        out = joins.asof(out.withColumn("w_from", back("entry_time")), right, list(by), "w_from", "w_back", ["w_leave"]).drop("w_from")
        ends.append("w_leave")
    if max_hold is not None:
        at = bars.select(*by, (F.col("n") - 1 - max_hold).alias("signal_no"), F.struct("next_ts", "next_open").alias("w_held"))
        out = out.join(at, [*by, "signal_no"], "left")
        ends.append("w_held")
    for c in ends:
        out = out.withColumn(c, F.when(F.col(f"{c}.next_ts").isNotNull(), F.col(c)))
    first = F.array_min(F.filter(F.array(*ends), lambda e: e.isNotNull()))
    return out.withColumn("w_end", first).select(*trades.columns, F.col("w_end.next_ts").alias("close_ts"), F.col("w_end.next_open").alias("close_open"))


# sizes ---------------------------------------------------------------------------------------------


def units(x: Column) -> Column:
    return x


def notional_cash(cash: Column, price: Column, contract_size: Column) -> Column:
    per = price * contract_size
    return F.when(per > 0, cash / per).otherwise(F.lit(0.0))


def risk_cash(risk: Column, price: Column, stop: Column, contract_size: Column) -> Column:
    """A missing stop is an error."""
    per = F.abs(price - stop) * contract_size
    return F.when(stop.isNull(), F.raise_error(F.lit("a risk size needs a stop")).cast("double")).when(per > 0, risk / per).otherwise(F.lit(0.0))


def risk_percent(equity: Column, share: Column, price: Column, stop: Column, contract_size: Column) -> Column:
    return risk_cash(equity * share, price, stop, contract_size)


def margin_ok(reference: Column, size: Column, contract_size: Column, leverage: Column, equity: Column, used: Column) -> Column:
    return F.abs(reference * size * contract_size) / F.coalesce(leverage, F.lit(1.0)) <= equity - used + 1e-9


# costs ---------------------------------------------------------------------------------------------


def entry_liquidity(order_type: Column) -> Column:
    return F.when(order_type == "limit", F.lit("maker")).otherwise(F.lit("taker"))


def exit_liquidity(reason: Column) -> Column:
    return F.when(reason == "take_profit", F.lit("maker")).otherwise(F.lit("taker"))


def commission(model: Column, price: Column, size: Column, contract_size: Column, liquidity: Column, rate: Column, maker_rate: Column, taker_rate: Column, per_share: Column, minimum: Column, per_lot: Column) -> Column:
    """``percent``, ``maker_taker`` (negative rates are rebates), ``per_share`` with a minimum (none at size 0), ``per_lot``."""
    notional = F.abs(price * size * contract_size)
    return (
        F.when(model == "percent", notional * rate)
        .when(model == "maker_taker", notional * F.when(liquidity == "maker", maker_rate).otherwise(taker_rate))
        .when(model == "per_share", F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.abs(size) * per_share, minimum)))
        .when(model == "per_lot", F.abs(size) * per_lot)
        .otherwise(F.lit(0.0))
    )


def spread_price(price: Column, side: Column, basis: Column, points: Column, liquidity: Column) -> Column:
    """Takers pay the spread: all of it when buying on bid prices, else half on each side."""
    buy = side == "buy"
    shift = F.when(basis == "bid", F.when(buy, points).otherwise(F.lit(0.0))).otherwise(F.when(buy, points / 2).otherwise(-points / 2))
    return F.when(liquidity == "taker", price + shift).otherwise(price)


def slipped_price(price: Column, side: Column, ticks: Column, tick_size: Column, percent: Column, liquidity: Column) -> Column:
    by = ticks * tick_size + percent * price
    return F.when(liquidity == "taker", F.when(side == "buy", price + by).otherwise(price - by)).otherwise(price)


def default_costs(instruments: DataFrame) -> DataFrame:
    """Default cost columns per asset class; fixed values."""
    kind = F.col("asset_class")
    crypto, perp, cfd = kind == "crypto", kind == "crypto_perp", kind == "cfd"
    pick = lambda c, p, s, f: F.when(crypto, F.lit(c)).when(perp, F.lit(p)).when(cfd, F.lit(f)).otherwise(F.lit(s))
    return instruments.withColumns(
        {
            "commission_model": pick("maker_taker", "maker_taker", "none", "none"), "maker_rate": pick(0.001, 0.0002, 0.0, 0.0), "taker_rate": pick(0.001, 0.0005, 0.0, 0.0),
            "spread_points": F.when(cfd, 2 * F.col("tick_size")).otherwise(F.lit(0.0)), "slip_ticks": pick(0.0, 0.0, 1.0, 1.0), "slip_percent": pick(0.0002, 0.0002, 0.0, 0.0), "annual_rate": pick(0.0, 0.0, 0.0, 0.05),
        }
    )


def financing(trades: DataFrame, bars: DataFrame, by=KEY) -> DataFrame:
    """``trade_id`` and the carry paid: one day's rate on the previous close at each bar that begins a new local date after the entry, up to the exit.

    ``bars`` with ``local_date``; ``trades`` with size, contract_size, annual_rate, entry_time, exit_time (null: open).
    """
    days = with_previous(bars.select(*by, "ts", "close", "local_date"), tuple(by), "ts", {"prev_close": "close", "w_date": "local_date"}).where("local_date <> w_date")
    # exact running sums up to the exit less those up to the entry: two as-of joins instead of a range join, and no error that grows with the history
    days = with_running(days, tuple(by), ["ts"], {"paid": F.abs("prev_close").cast("decimal(38,9)")})
    days = days.select(*by, F.col("ts").alias("day_ts"), F.col("paid"))
    life = trades.select("trade_id", *by, "size", "contract_size", "annual_rate", "entry_time", F.coalesce("exit_time", F.expr("TIMESTAMP_NTZ'9999-12-31 00:00:00'")).alias("w_end"))
    life = joins.asof(life, days, list(by), "entry_time", "day_ts", ["paid"], prefix="entry_")
    life = joins.asof(life, days, list(by), "w_end", "day_ts", ["paid"], prefix="exit_")
    zero = F.lit(0).cast("decimal(38,9)")
    days_paid = (F.coalesce("exit_paid", zero) - F.coalesce("entry_paid", zero)).cast("double")
    return life.select("trade_id", (days_paid * F.abs(F.col("size") * F.col("contract_size")) * F.col("annual_rate") / 365).alias("financing"))


def blotter(trades: DataFrame) -> DataFrame:
    """Adds ``gross_pnl``, ``costs`` and ``net_pnl`` from cost-adjusted prices, commissions and financing."""
    sign = F.when(F.col("side") == "buy", F.lit(1.0)).otherwise(F.lit(-1.0))
    out = trades.withColumn("gross_pnl", (F.col("exit_price") - F.col("entry_price")) * sign * F.col("size") * F.col("contract_size"))
    out = out.withColumn("costs", F.col("entry_commission") + F.col("exit_commission") + F.coalesce("financing", F.lit(0.0)))
    return out.withColumn("net_pnl", F.col("gross_pnl") - F.col("costs"))


def equity_curve(trades: DataFrame, bars: DataFrame, start_cash: float, by=KEY) -> DataFrame:
    """Equity at each bar's close, and the net position: running sums of the trades' events as of each bar.

    ``trades``: key, side, size, contract_size, entry_time, entry_price, entry_commission, and exit_time, gross_pnl, exit_commission
    (null while open).
    """
    sign = F.when(F.col("side") == "buy", F.lit(1.0)).otherwise(F.lit(-1.0))
    q = sign * F.col("size") * F.col("contract_size")
    opened = trades.select(*by, F.col("entry_time").alias("ts"), (-F.col("entry_commission")).alias("d_cash"), q.alias("d_a"), (q * F.col("entry_price")).alias("d_b"), (sign * F.col("size")).alias("d_pos"))
    ended = trades.where("exit_time is not null").select(*by, F.col("exit_time").alias("ts"), (F.col("gross_pnl") - F.col("exit_commission")).alias("d_cash"), (-q).alias("d_a"), (-q * F.col("entry_price")).alias("d_b"), (-sign * F.col("size")).alias("d_pos"))
    moves = opened.unionByName(ended).withColumn("close", F.lit(None).cast("double")).withColumn("w_o", F.lit(0))
    zero = F.lit(0.0)
    rows = bars.select(*by, "ts", zero.alias("d_cash"), zero.alias("d_a"), zero.alias("d_b"), zero.alias("d_pos"), "close", F.lit(1).alias("w_o")).unionByName(moves)
    rows = with_running(rows, tuple(by), ["ts", "w_o"], {"s_cash": F.col("d_cash"), "s_a": F.col("d_a"), "s_b": F.col("d_b"), "position": F.col("d_pos")})
    out = rows.withColumn("equity", F.lit(start_cash) + F.col("s_cash") + F.col("close") * F.col("s_a") - F.col("s_b"))
    return out.where("w_o = 1").select(*by, "ts", "equity", "position")
