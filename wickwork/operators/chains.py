"""Paths through pointers: from the first row of a series to the row it points at, and on from there, without a walk row by row.

The rows of a series are numbered from 0 and point forwards. Blocks of ``BLOCK`` consecutive rows double their pointers in an array until all of them leave the block; the rows
by which the path enters blocks are found by doubling these exits between blocks, in as many rounds as the number of blocks has bits; and each entered block doubles the part of the
path inside it. So a series spreads over as many tasks as it has blocks, and no step depends on the length of the path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.sources.scratch import written

BLOCK = 1024


def _doubled(pointers: Column, base: Column) -> Column:
    """Each pointer that stays inside replaced by the pointer of the row it leads to."""
    return F.transform(pointers, lambda x: F.when(_inside(x, base, pointers), F.get(pointers, (x - base).cast("int"))).otherwise(x))


def _inside(x: Column, base: Column, pointers: Column) -> Column:
    return F.coalesce(x - base < F.size(pointers), F.lit(False))


def on_path(rows: DataFrame, by: list[str], rank: str, to: str, block: int | None = None) -> DataFrame:
    """The rows that the path from rank 0 reaches.

    ``rank``: 0, 1, 2 ... within ``by``; ``to``: a larger rank, null or beyond the last one at the end of the path.
    """
    size = block or BLOCK
    rounds = F.array(*[F.lit(k) for k in range(max(1, math.ceil(math.log2(size))))])
    base = F.col("w_block") * size
    p = rows.select(*by, F.col(rank).cast("long").alias("w_at"), F.col(to).cast("long").alias("w_to")).withColumn("w_block", F.floor(F.col("w_at") / size))
    p = p.groupBy(*by, "w_block").agg(F.array_sort(F.collect_list(F.struct("w_at", "w_to"))).alias("w_p"))
    p = p.withColumn("w_p", F.col("w_p.w_to"))
    blocks = written(p.withColumn("w_exits", F.aggregate(rounds, F.col("w_p"), lambda j, _: _doubled(j, base))), "path-blocks")
    entries = blocks.where("w_block = 0").select(*by, F.lit(0).cast("long").alias("w_at"))
    last = blocks.agg(F.max("w_block")).first()[0] or 0
    if last:
        exits = blocks.select(*by, base.alias("w_base"), F.posexplode("w_exits").alias("w_i", "w_to")).select(*by, (F.col("w_base") + F.col("w_i")).alias("w_at"), "w_to")
        # only rows that some block leads to can be entries
        targets = exits.where("w_to is not null").select(*by, F.col("w_to").alias("w_at")).distinct().unionByName(entries)
        jumps = written(exits.join(targets, [*by, "w_at"], "left_semi"), "path-jumps")
        entries = written(entries, "path-entries")
        for k in range(math.ceil(math.log2(last + 1))):
            far = entries.join(jumps, [*by, "w_at"]).where("w_to is not null").select(*by, F.col("w_to").alias("w_at"))
            entries = written(entries.unionByName(far), "path-entries")
            if 2 ** (k + 1) < last + 1:
                on = jumps.select(*by, F.col("w_at").alias("w_to"), F.col("w_to").alias("w_far"))
                jumps = written(jumps.join(on, [*by, "w_to"], "left").select(*by, "w_at", F.col("w_far").alias("w_to")), "path-jumps")
        entries = entries.distinct()
    entered = entries.withColumn("w_block", F.floor(F.col("w_at") / size)).join(blocks.drop("w_exits"), [*by, "w_block"])

    def reach(state: Column, _: Column) -> Column:
        seen, j = state["seen"], state["j"]
        more = F.filter(F.transform(seen, lambda x: F.get(j, (x - base).cast("int"))), lambda x: _inside(x, base, j))
        return F.struct(F.concat(seen, more).alias("seen"), _doubled(j, base).alias("j"))

    start = F.struct(F.array("w_at").alias("seen"), F.col("w_p").alias("j"))
    hit = entered.select(*by, F.explode(F.aggregate(rounds, start, reach)["seen"]).alias(rank))
    return rows.join(hit, [*by, rank], "left_semi")
