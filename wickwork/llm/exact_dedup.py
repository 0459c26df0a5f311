"""Exact dedup by content sort, in DataFrame functions alone.

Rows are range-partitioned by sampled splitters over a key of their normalised text (its
first bytes, then a 64-bit hash that separates texts with a common opening), sorted within the
partitions by Spark's external sort down to the whole normalised text, and neighbours with the
same full text form a group (the window operator compares each row's full text with the one
before). The splitters hold keys of fixed size, never whole texts.

Hot groups: a first, map-side combined count by hash and id finds texts with more copies than
``max(MIN_HOT, rows / HOT_PARTS)`` (so at most HOT_PARTS hashes, a proven bound for the
broadcast). Their rows get a salt by id, so that a group spreads over several sorted runs; the group's
smallest id and size come from an aggregation by full text that is combined in each task first.
Where one id (or null) alone has that many rows of a text, no hash of the row tells them apart: such
groups are combined into one row per text, id and input partition, with its number of rows, before the
sort; that table is written, salted by id and partition, and its rows are repeated at the end.

Defined results: a null text counts as empty; null ids come after all others; of fully repeated
rows exactly one is kept; an empty table gives an empty result; other columns are carried
untouched whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.common import written

HOT_PARTS = 65536
MIN_HOT = 256
PREFIX = 24


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and text_sha256.

    With ``carry`` also the row itself as ``w_row``; of rows with one text and one id in a hot group the input partition's first by hash then stands for all.
    """
    norm = normalised("w_text")
    rows = docs.select(F.col(id_col).alias("w_id"), F.col(text_col).alias("w_text"), *([F.struct("*").alias("w_row")] if carry else []))
    keyed = rows.select("*", F.xxhash64(norm).alias("w_hash"), F.substring(norm, 1, PREFIX).alias("w_prefix"))
    limit = max(MIN_HOT, docs.count() // HOT_PARTS)
    hot = keyed.groupBy("w_hash", "w_id").agg(F.count(F.lit(1)).alias("w_c")).groupBy("w_hash").agg(F.sum("w_c").alias("w_n"), F.max("w_c").alias("w_most")).where(F.col("w_n") > limit)
    hot = written(hot.select("w_hash", (F.col("w_n") / limit + 1).cast("int").alias("w_salts"), (F.col("w_most") > limit).alias("w_repeats")), "dedup-hot")
    repeats = bool(hot.where("w_repeats").take(1))
    keyed = keyed.join(F.broadcast(hot), "w_hash", "left").withColumn("w_part", F.lit(0)).withColumn("w_times", F.lit(1).cast("long"))

    def heads(of: DataFrame, text, least: list) -> DataFrame:
        """Whole hot groups: one row per text and task before the shuffle."""
        whole = of.groupBy("w_hash", text.alias("w_norm")).agg(*least, F.sum("w_times").alias("w_all_n"))
        return whole.withColumn("text_sha256", F.sha2(F.col("w_norm").cast("binary"), 256)).drop("w_norm")

    if repeats:
        same = keyed.where("w_repeats").withColumn("w_part", F.spark_partition_id()).withColumn("w_text", norm)
        row = [F.min_by("w_row", F.xxhash64(F.to_json("w_row"))).alias("w_row")] if carry else []
        same = same.groupBy("w_hash", "w_prefix", "w_salts", "w_repeats", "w_text", "w_id", "w_part").agg(F.sum("w_times").alias("w_times"), *row)
        same = written(same, "dedup-repeats")
        keyed = keyed.where(~F.coalesce("w_repeats", F.lit(False)))
    whole = heads(keyed.where("w_salts is not null"), norm, [F.min("w_id").alias("w_all_keep"), F.min("w_part").alias("w_all_part")])
    if repeats:
        least = F.min(F.struct(F.col("w_id").isNull().alias("none"), F.col("w_id").alias("id"), F.col("w_part").alias("part"))).alias("w_least")
        again = heads(same, F.col("w_text"), [least]).withColumn("w_all_keep", F.col("w_least.id")).withColumn("w_all_part", F.col("w_least.part"))
        whole = whole.unionByName(again.drop("w_least"))
        keyed = keyed.unionByName(same)
    keyed = keyed.withColumn("w_salt", F.coalesce(F.pmod(F.xxhash64("w_id", "w_part"), F.col("w_salts")), F.lit(-1))).drop("w_salts", "w_repeats")
    if carry:  # the text is in the row already
        keyed = keyed.drop("w_text")
        norm = F.regexp_replace(F.coalesce(F.col("w_row")[text_col], F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    dealt = keyed.repartitionByRange("w_prefix", "w_hash", "w_salt").withColumn("w_norm", norm)
    order = Window.partitionBy("w_prefix", "w_hash", "w_salt", "w_norm").orderBy(F.col("w_id").asc_nulls_last(), "w_part")
    run = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (
        dealt.withColumn("w_rank", F.row_number().over(order))
        .withColumn("w_n", F.count(F.lit(1)).over(run))
        .withColumn("w_keep", F.min("w_id").over(run))
        .withColumn("text_sha256", F.sha2(F.col("w_norm").cast("binary"), 256))
    )
    plain = runs.drop("w_norm", "w_prefix", "w_text").join(F.broadcast(whole), ["w_hash", "text_sha256"], "left")
    keep = F.when(F.col("w_all_n").isNull(), F.col("w_keep")).otherwise(F.col("w_all_keep"))
    stays = (F.col("w_rank") == 1) & keep.eqNullSafe(F.col("w_id")) & (F.col("w_part") == F.coalesce("w_all_part", F.lit(0)))
    out = plain.withColumn("w_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("w_times")))) if repeats else plain.withColumn("w_no", F.lit(1))
    return out.select(
        F.col("w_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("w_all_n", "w_n").cast("long").alias("group_size"),
        (stays & (F.col("w_no") == 1)).alias("kept"),
        "text_sha256",
        *(["w_row"] if carry else []),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return grouped(docs, id_col, text_col, carry=True).where("kept").select("w_row.*")


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
