"""Key columns, and the instrument dimension that queries derive from the symbols of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("source", "ticker")


def instruments(keys: DataFrame) -> DataFrame:
    """One row per key of a table of keys, with session, tick and cost columns, by a fixed rule on the ticker's length.

    Length mod 3: 0 is a round-the-clock spot pair, 1 a stock (09:30-16:00 New York, Monday to Friday), 2 a contract
    with a trading day from 17:00 New York.
    """
    kind = F.length("ticker") % 3
    pick = lambda *v: F.when(kind == 0, F.lit(v[0])).when(kind == 1, F.lit(v[1])).otherwise(F.lit(v[2]))
    stock = kind == 1
    return keys.select(*KEY).distinct().select(
        *KEY, pick("crypto", "stock", "cfd").alias("asset_class"), pick("USDT", "USD", "USD").alias("quote_currency"), pick(0.01, 0.01, 0.001).alias("tick_size"),
        pick("last", "last", "bid").alias("price_basis"), (kind == 2).alias("can_short"), pick(1.0, 1.0, 100.0).alias("contract_size"), pick(1.0, 1.0, 30.0).alias("leverage"),
        pick("UTC", "America/New_York", "America/New_York").alias("tz"), F.when(stock, F.lit(34200)).alias("open_sec"), F.when(stock, F.lit(57600)).alias("close_sec"),
        F.when(stock, F.array(*[F.lit(i) for i in range(5)])).otherwise(F.array(*[F.lit(i) for i in range(7)])).alias("weekdays"), F.when(kind == 2, F.lit(61200)).alias("day_anchor_sec"),
    )
