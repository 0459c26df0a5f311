"""A running account per key: sizes from the equity of the moment, margin, rejections.

An account depends on its own past, so its events are folded in order: an order at its bar's close, a fill, an exit. Bars without any of these take no part. What an order needs to know of
the account is a handful of sums over open trades (size times contract, times entry price, times margin, times carry), so an event costs the same however many trades are open.
Events are dealt by key and sorted within the partitions, and go through the fold as a stream of batches with the account carried from one to the
next: a task holds one batch and the sizes of orders that are not closed yet, never a whole account.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.operators import joins
from wickwork.operators.series import with_running
from wickwork.schema import KEY

EXIT, FILL, ORDER = 1, 2, 3
_DOUBLES = ("sign", "price", "fixed", "share", "margin", "fee", "minimum", "contract_size", "entry_margin", "rate", "paid")
#: Columns of an order besides the key; see ``decide``.
ORDER_COLUMNS = (
    "order_id", "signal_no", "side", "close", "size_fixed", "size_share", "unit_margin", "can_short", "fill_no", "entry_price", "entry_fee", "exit_no", "exit_price", "exit_fee", "fee_minimum",
    "exit_rest", "contract_size", "leverage", "annual_rate", "paid_signal", "paid_fill", "paid_exit",
)


def carried(bars: DataFrame, by=KEY) -> DataFrame:
    """Key, n and ``paid``: the running sum of previous closes at bars that begin a new local date, which is what a day's carry is charged on.

    ``bars``: key, ts, n, close, prev_close, new_day.
    """
    day = F.when(F.col("new_day"), F.abs("prev_close")).otherwise(F.lit(0.0)).cast("decimal(38,9)")  # exact, so that differences are
    return with_running(bars, tuple(by), ["ts"], {"paid": day}).select(*by, "n", F.col("paid").cast("double").alias("paid"))


def _events(orders: DataFrame, by: list[str]) -> DataFrame:
    c = F.col
    sign = F.when(c("side") == "buy", F.lit(1.0)).otherwise(F.lit(-1.0))
    none = F.lit(None).cast("double")

    def event(no: str, phase: int, price: str, paid: str, fee: Column = none, rest: Column = F.lit(0)) -> Column:
        entry_margin = F.abs(c("entry_price") * c("contract_size")) / F.coalesce("leverage", F.lit(1.0))
        values = (sign, c(price), c("size_fixed"), c("size_share"), c("unit_margin"), fee, c("fee_minimum"), c("contract_size"), entry_margin, c("annual_rate") / 365, c(paid))
        return F.when(
            c(no).isNotNull() & c(price).isNotNull(),
            F.struct(c(no).cast("long").alias("no"), F.lit(phase).alias("phase"), c("order_id").alias("order_id"), c("can_short").alias("can_short"), rest.cast("long").alias("rest"), *[v.cast("double").alias(n) for n, v in zip(_DOUBLES, values, strict=True)]),
        )

    each = F.array(
        event("signal_no", ORDER, "close", "paid_signal"), event("fill_no", FILL, "entry_price", "paid_fill", c("entry_fee")), event("exit_no", EXIT, "exit_price", "paid_exit", c("exit_fee"), F.coalesce("exit_rest", F.lit(0)))
    )
    return orders.select(*by, F.explode(F.array_compact(each)).alias("e")).select(*by, "e.*")


class _Account:
    def __init__(self, cash: float, flat_only: bool):
        self.cash, self.flat_only = cash, flat_only
        self.sizes: dict[str, float] = {}  # accepted orders until their exit
        self.filled: dict[str, tuple[float, float]] = {}  # entry price and carry paid before
        self.ready = -1
        self.clear()

    def clear(self) -> None:
        self.held = self.worth = self.used = self.carry = self.carry_before = 0.0

    def equity(self, close: float, paid: float) -> float:
        return self.cash + close * self.held - self.worth - (paid * self.carry - self.carry_before)

    def order(self, e: dict) -> tuple:
        equity, used, n = self.equity(e["price"], e["paid"]), self.used, len(self.filled)
        if (self.flat_only and n) or e["no"] < self.ready:
            return equity, used, n, 0.0, "held" if n else "resting"
        size = abs(e["fixed"] + e["share"] * equity)
        if e["sign"] < 0 and not e["can_short"] and not n:
            return equity, used, n, size, "short"
        if size * e["margin"] > equity - used + 1e-9:
            return equity, used, n, size, "margin"
        self.sizes[e["order_id"]] = size
        return equity, used, n, size, "accepted"

    @staticmethod
    def fee(size: float, e: dict) -> float:
        paid = size * (e["fee"] or 0.0)
        return paid if e["minimum"] is None or not size else max(paid, e["minimum"])

    def fill(self, e: dict) -> None:
        size = self.sizes.get(e["order_id"])
        if size is None:
            return
        self.cash -= self.fee(size, e)
        self.filled[e["order_id"]] = e["price"], e["paid"]
        self._move(size, e, e["price"], e["paid"], 1)

    def exit(self, e: dict) -> None:
        if e["order_id"] not in self.filled:
            return
        size, (entry, before) = self.sizes.pop(e["order_id"]), self.filled.pop(e["order_id"])
        self.cash += (e["price"] - entry) * e["sign"] * size * e["contract_size"] - self.fee(size, e) - size * e["contract_size"] * e["rate"] * (e["paid"] - before)
        self._move(size, e, entry, before, -1)
        if not self.filled:  # nothing open: no rounding is carried on
            self.clear()
        if e["rest"]:
            self.ready = e["no"] + e["rest"]

    def _move(self, size: float, e: dict, entry: float, before: float, way: int) -> None:
        q = way * e["sign"] * size * e["contract_size"]
        self.held += q
        self.worth += q * entry
        self.used += way * size * e["entry_margin"]
        self.carry += way * size * e["contract_size"] * e["rate"]
        self.carry_before += way * size * e["contract_size"] * e["rate"] * before


def decide(orders: DataFrame, cash: float, flat_only: bool = False, by=KEY) -> DataFrame:
    """Per order: key, order_id, ``equity``, ``used_margin`` and ``open_trades`` at its bar's close, ``size`` and ``status``.

    ``orders``: key and ORDER_COLUMNS. The size is ``size_fixed + size_share * equity`` (a share of the equity over the risk of a unit, for one); ``unit_margin`` is
    a unit's margin at the order's price. ``fill_no`` and ``exit_no``: bars of the fill and exit that an accepted order finds (null: none), with
    prices after costs; fees are per unit, ``fee_minimum`` the least fee (null: none); ``paid_*``: of ``carried``, at the three bars; ``exit_rest``: bars without orders after the exit.

    Within a bar exits come first, then fills, then orders, each in the order of order_id. ``status``: ``accepted``; ``short`` (a sell where none may be sold short, without any
    open trade); ``margin`` (more than the equity not in use); with ``flat_only`` ``held`` while a trade is open; ``resting`` after an exit. Rejected orders neither fill nor exit.
    A fill without a price, an exit without a fill and nulls in both take no part.
    """
    by = list(by)
    events = _events(orders, by)
    kinds = [f"{c} {orders.schema[c].dataType.simpleString()}" for c in by]
    dealt = events.repartition(*by).sortWithinPartitions(*by, "no", "phase", "order_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, account = None, None
        for batch in batches:
            out: list[tuple] = []
            for e in batch.to_pylist():
                k = tuple(e[c] for c in by)
                if k != key or account is None:
                    key, account = k, _Account(cash, flat_only)
                if e["phase"] == ORDER:
                    out.append((*k, e["order_id"], *account.order(e)))
                elif e["phase"] == FILL:
                    account.fill(e)
                else:
                    account.exit(e)
            columns = list(zip(*out, strict=True)) if out else [()] * (len(by) + 6)
            types = [*(batch.schema.field(c).type for c in by), batch.schema.field("order_id").type, pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=[*by, "order_id", "equity", "used_margin", "open_trades", "size", "status"])

    kind = orders.schema["order_id"].dataType.simpleString()
    return dealt.mapInArrow(run, ", ".join([*kinds, f"order_id {kind}", "equity double", "used_margin double", "open_trades long", "size double", "status string"]))


def open_as_of(orders: DataFrame, trades: DataFrame, at: str = "created_at", by=KEY) -> DataFrame:
    """``orders`` with ``open_trades`` and ``used_margin``: the trades entered and not yet closed when an order's bar ends.

    A count of entries less one of exits as of a time: running sums over the trades' ends, not a join of orders with the intervals that hold them.
    ``trades``: key, entry_time, exit_time (null: open), entry_price, size, contract_size, leverage. Exits and entries of the order's own bar count.
    """
    margin = F.abs(F.col("entry_price") * F.col("size") * F.col("contract_size")) / F.coalesce("leverage", F.lit(1.0))
    one = F.lit(1).cast("long")
    ends = trades.select(*by, F.col("entry_time").alias("w_end"), one.alias("w_n"), margin.alias("w_m"))
    ends = ends.unionByName(trades.where("exit_time is not null").select(*by, F.col("exit_time").alias("w_end"), (-one).alias("w_n"), (-margin).alias("w_m")))
    # one row per time; margins in millionths, so that they come back to zero
    ends = ends.groupBy(*by, "w_end").agg(F.sum("w_n").alias("w_n"), F.sum(F.round(F.col("w_m") * 1_000_000).cast("decimal(38,0)")).alias("w_m"))
    sums = with_running(ends, tuple(by), ["w_end"], {"open_trades": F.col("w_n"), "w_margin": F.col("w_m")})
    got = joins.asof(orders, sums, list(by), at, "w_end", ["open_trades", "w_margin"])
    return got.withColumns({"open_trades": F.coalesce("open_trades", F.lit(0).cast("long")), "used_margin": F.coalesce((F.col("w_margin") / 1_000_000).cast("double"), F.lit(0.0))}).drop("w_margin")
