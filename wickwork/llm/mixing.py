"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target number of words (``targets``); its rows all have the rate
``target / source size`` (at most ``cap``). A row is taken ``floor(rate)`` times, and once more
with the fractional probability that the cube method settles: it moves all fractional
probabilities of a block along directions that keep the block's total words and total
documents unchanged, until at most as many rows as constraints stay fractional.

Blocks hold at most ``BLOCK`` rows of one source (a large source has many), so that a source of
any size is spread; what stays fractional moves on to the next level, whose blocks gather the rest
of many blocks, and at the last level, one block per source, the few rows left are rounded so that
the source's words come closest to their target. A level leaves at most two rows per block, so that
the number of levels is the logarithm of the number of rows.

Reruns agree: the order in a block and the directions come from hashes of the ids, not from a
random state.

Defined results: null texts have size 0; a null source is a source of its own (last); rows of size 0
are taken with 0 words; null ids and repeated rows are separate rows, told apart by a hash of the
whole row and its number among equal rows; sources of total size 0 have target 0; an empty table
gives an empty result; clashing names of other columns do not matter.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from itertools import islice, product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import HOT_PARTS, before_each, hot_join, numbered_equals, written

#: Rows of a block, blocks whose rest meets at the next level, most sources that are broadcast.
BLOCK = 2048
BROADCAST_SOURCES = 50_000
FAN_IN = 512
WEIGHTS = (5, 2, 1)
EPS = 1e-9


def n_words(text: str):
    """Number of maximal runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, rows, target): ``share`` of all words by weight, at most ``cap`` times each source.

    The excess of sources at their cap is shared anew by weight until none is above: the targets are
    ``min(cap * size, level * weight)`` for the level at which they add up. Sources are ordered by name and by ratio in ranges, however many.
    """
    by = sizes.groupBy("w_source").agg(F.sum("w_size").alias("w_total"), F.count(F.lit(1)).alias("w_rows"))
    by = before_each(by, [F.col("w_source").asc_nulls_last()], {"w_place": F.lit(1)}, "mix-sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("w_weight", F.element_at(cycle, (F.pmod(F.col("w_place"), F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("w_full", F.col("w_total") * F.lit(float(cap))).withColumn("w_ratio", F.col("w_full") / F.col("w_weight"))
    ratio = [F.col("w_ratio"), F.col("w_source").asc_nulls_last()]
    by = written(before_each(by, ratio, {"w_before": F.col("w_full"), "w_lighter": F.col("w_weight")}, "mix-ratios"), "mix-levels")
    all_ = by.agg(F.sum("w_total").alias("goal"), F.sum("w_weight").alias("weight")).first()
    if not all_["weight"]:
        return by.select("w_source", "w_total", "w_rows", F.lit(0.0).alias("w_target"))
    # the level if all sources before this one (by ratio) are at their cap; the first that fits holds
    level = (F.lit(all_["goal"] * float(share)) - F.col("w_before")) / (F.lit(all_["weight"]) - F.col("w_lighter"))
    held = by.where(level <= F.col("w_ratio")).agg(F.min(F.struct(F.col("w_ratio"), (-level).alias("l"))).alias("x")).first()["x"]  # of equal ratios the first, whose level is highest
    target = F.least(F.col("w_full"), F.lit(-held["l"]) * F.col("w_weight")) if held else F.col("w_full")
    return by.select("w_source", "w_total", "w_rows", target.alias("w_target"))


def flight(p: list[float], size: list[float], draw: Callable[[], float]) -> list[float]:
    """Flight phase of the cube method over one block: sum(p) and sum(p * size) stay, at most two entries stay fractional."""
    p = list(p)
    rest = iter([i for i in range(len(p)) if EPS < p[i] < 1 - EPS])
    live = list(islice(rest, 3))
    while len(live) == 3:
        x, y, z = (size[i] for i in live)
        u = (z - y, x - z, y - x)  # null space of the two constraints
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(live, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(live, u, strict=True) if d)
        step = up if draw() * (up + down) < down else -down  # keeps each expectation
        for i, d in zip(live, u, strict=True):
            q = p[i] + step * d
            p[i] = 0.0 if q < EPS else 1.0 if q > 1 - EPS else q
        live = [i for i in live if 0 < p[i] < 1]
        live += islice(rest, 3 - len(live))
    return p


def landing(p: list[float], size: list[float]) -> list[float]:
    """Rounds the last fractional rows so that their words come closest to what they stand for."""
    live = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    p = [0.0 if x <= EPS else 1.0 if x >= 1 - EPS else x for x in p]
    if live:
        words, rows = sum(p[i] * size[i] for i in live), sum(p[i] for i in live)
        best = min(product((0.0, 1.0), repeat=len(live)), key=lambda c: (abs(sum(v * size[i] for v, i in zip(c, live, strict=True)) - words), abs(sum(c) - rows), c))
        for v, i in zip(best, live, strict=True):
            p[i] = v
    return p


def _settle(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values(["w_key", "w_no"], kind="stable").reset_index(drop=True)
    size = block["w_size"].astype(float).tolist()
    p = flight(block["w_p"].tolist(), size, random.Random(int(block["w_key"].iloc[0])).random)
    return block.assign(w_p=landing(p, size) if block["w_blocks"].iloc[0] == 1 else p)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per row: id, ``size``, ``source_size``, ``target`` and ``taken``; also ``copies`` and ``w_key``, a hash of id, text and source."""
    key = F.xxhash64(id_col, text_col, source_col)
    ids = docs.select(F.col(id_col).alias("w_id"), F.col(source_col).cast("string").alias("w_source"), n_words(text_col).alias("w_size"), key.alias("w_key"))
    small = written(numbered_equals(ids, "w_key", "mix-ids"), "mix-rows")
    goal = written(targets(small, weights, share, cap), "mix-targets").withColumnRenamed("w_source", "w_goal_source")
    if goal.count() <= BROADCAST_SOURCES:
        rows = small.join(F.broadcast(goal), F.col("w_source").eqNullSafe(F.col("w_goal_source"))).drop("w_goal_source")
    else:
        named = lambda c: F.concat(F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(c, F.lit("")))
        rows = hot_join(small.withColumn("w_name", named("w_source")), goal.select(named("w_goal_source").alias("w_name"), "w_total", "w_rows", "w_target"), ["w_name"], spread=F.xxhash64("w_key", "w_no")).drop("w_name")
    rate = F.when(F.col("w_total") > 0, F.col("w_target") / F.col("w_total")).otherwise(F.lit(0.0))
    rate = F.when(F.abs(rate - F.round(rate)) < EPS, F.round(rate)).otherwise(rate)  # else rounding errors were drawn on
    state = rows.withColumn("w_base", F.floor(rate)).withColumn("w_p", rate - F.floor(rate)).withColumn("w_blocks", F.greatest(F.lit(1).cast("long"), F.floor(F.col("w_rows") / BLOCK)))
    fractional, level = f"w_p > {EPS} and w_p < 1 - {EPS}", 0
    settled = []
    while True:
        block = F.pmod(F.xxhash64("w_key", "w_no", F.lit(level)), F.col("w_blocks"))
        dealt = state.withColumn("w_block", block)
        done = written(dealt.groupBy("w_source", "w_block").applyInPandas(_settle, dealt.schema).drop("w_block"), f"mix-{level}")
        settled.append(done.where(f"not ({fractional})"))
        if not done.where(fractional).take(1):
            break
        state = done.where(fractional).withColumn("w_blocks", F.greatest(F.lit(1).cast("long"), F.floor(F.col("w_blocks") / FAN_IN)))
        level += 1
    fate = reduce(DataFrame.unionByName, settled)
    copies = (F.col("w_base") + F.round("w_p")).cast("long")
    return fate.select(
        F.col("w_id").alias(id_col), F.col("w_size").alias("size"), F.col("w_total").cast("long").alias("source_size"), F.col("w_target").alias("target"),
        (copies * F.col("w_size")).alias("taken"), copies.alias("copies"), "w_key",
    )


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    fate = written(mix(docs, id_col, text_col, source_col, **how).groupBy("w_key").agg(F.sum("copies").alias("w_sum"), F.count(F.lit(1)).alias("w_same")).where("w_sum > 0"), "mix-fate")
    rows = docs.select(F.struct("*").alias("w_row"), F.xxhash64(id_col, text_col, source_col).alias("w_key"))
    several = fate.where("w_same > 1")
    n_several = several.count()
    one = rows.join(fate.where("w_same = 1") if n_several else fate, "w_key").select("w_row", F.col("w_sum").alias("w_copies"))
    if not n_several:
        return _copied(one)
    # equal rows share their copies: few rows, or few texts many times over
    keys = several.select("w_key")
    many = rows.join(F.broadcast(keys) if n_several <= HOT_PARTS else keys, "w_key", "left_semi")
    many = hot_join(numbered_equals(many, "w_key", "mix-equals", F.xxhash64(F.to_json("w_row"))), several, ["w_key"], spread=F.col("w_no"))
    many = many.select("w_row", (F.floor(F.col("w_sum") / F.col("w_same")) + (F.col("w_no") <= F.col("w_sum") % F.col("w_same")).cast("long")).alias("w_copies"))
    return _copied(one.unionByName(many))


def _copied(rows: DataFrame) -> DataFrame:
    return rows.withColumn("w_copy", F.explode(F.array_repeat(F.lit(1), F.col("w_copies").cast("int")))).select("w_row.*")
