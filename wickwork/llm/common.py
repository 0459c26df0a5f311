"""Shared helpers: scratch tables in the shared folder, Arrow byte views."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of whole texts that a function handles at a time.
TEXT_ROWS = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: what a function makes of one at a time is bounded. (Spark bounds its batches by bytes.)"""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.startswith("local["):  # one machine, as in tests
        base = _local()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/wickwork-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null rows are empty."""
    arr = batch.column(column)
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def held_out(doc_id: str = "doc_id"):
    """True for the rows that no model may learn from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_sample(rows: DataFrame, n: int, hash_col: str, total: int, keep=None) -> list:
    """The ``n`` rows (or all) of smallest hash among those that ``keep`` accepts.

    Only a share of the rows by hash is looked at, widened until it holds enough, so that what tasks send to the
    driver is bounded by ``n`` and not by the number of tasks.
    """
    share = min(1.0, 4 * n / max(1, total))
    while True:
        near = rows.where(F.pmod(F.col(hash_col), F.lit(1 << 30)) <= int(share * (1 << 30)))
        near = near if keep is None else near.where(keep)
        got = near.orderBy(F.pmod(F.col(hash_col), F.lit(1 << 30)), *rows.columns).limit(n).collect()
        if len(got) >= n or share >= 1:
            return got
        share = min(1.0, 16 * share)


#: Keys with so many rows, and at least this share of all (so at most HOT_PARTS keys), get salts.
MIN_HOT, HOT_PARTS = 4096, 65536


def hot_keys(counts: DataFrame, key: list[str]) -> DataFrame | None:
    """Of ``counts`` (key, w_rows) the keys that hold many of all rows, with their number of salts; HOT_PARTS at most, None if there are none."""
    top = counts.agg(F.sum("w_rows").alias("total"), F.max("w_rows").alias("most")).first()
    limit = max(MIN_HOT, (top["total"] or 0) // HOT_PARTS)
    if (top["most"] or 0) <= limit:
        return None
    return written(counts.where(F.col("w_rows") > limit).select(*key, F.ceil(F.col("w_rows") / limit).cast("int").alias("w_salts")), "hot-keys")


def hot_join(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner", hot: DataFrame | None = None, known: bool = False, spread: Column | None = None) -> DataFrame:
    """``left.join(right, key, how)`` where a few keys may hold a large part of ``left``, and ``right`` has few rows a key.

    The rows of a hot key are dealt over salts, and its right rows copied to each of them. The hot keys (``hot``, if ``known``; else counted,
    in each task first) are HOT_PARTS at most, a proven bound for their broadcast. Salts come from ``spread``, which
    tells the rows of a key apart, or from the rows' places, which only a written ``left`` keeps if a task runs again.
    """
    if not known:
        hot = hot_keys(left.groupBy(*key).agg(F.count(F.lit(1)).alias("w_rows")), key)
    if hot is None:
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    rows = left.join(hot, key, "left").withColumn("w_salt", F.pmod(F.monotonically_increasing_id() if spread is None else spread, F.coalesce("w_salts", F.lit(1))).cast("int")).drop("w_salts")
    copies = right.join(hot, key, "left").withColumn("w_salt", F.explode(F.sequence(F.lit(0), F.coalesce("w_salts", F.lit(1)) - 1))).drop("w_salts")
    return rows.join(copies, [*key, "w_salt"], how).drop("w_salt")


def before_each(df: DataFrame, order: list, sums: dict, name: str) -> DataFrame:
    """Adds, under each name of ``sums``, the sum of that column over all rows before in the order ``order`` (columns, without ties).

    The rows are range-partitioned and written, each range adds up on its own, and the ranges' totals (one row per range) go to those behind.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("w_range", F.spark_partition_id()), name)
    inside = Window.partitionBy("w_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = {n: F.lit(0).cast(dealt.select(c.alias(n)).schema[n].dataType) for n, c in sums.items()}
    totals = dealt.groupBy("w_range").agg(*[F.sum(c).alias(f"w_{n}") for n, c in sums.items()])
    ranges = Window.partitionBy(F.lit(0)).orderBy("w_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("w_range", *[F.coalesce(F.sum(f"w_{n}").over(ranges), zero[n]).alias(f"w_{n}") for n in sums])
    out = dealt.withColumns({n: F.coalesce(F.sum(c).over(inside), zero[n]) for n, c in sums.items()}).join(F.broadcast(totals), "w_range")  # one row per range
    return out.withColumns({n: F.col(n) + F.col(f"w_{n}") for n in sums}).drop("w_range", *[f"w_{n}" for n in sums])


def numbered_equals(df: DataFrame, key: str, name: str, tie: Column | None = None) -> DataFrame:
    """Numbers rows of equal ``key`` from 1 as ``w_no``, by ``tie`` where they differ; a key with very many rows is spread.

    Rows are numbered within the partitions they were read in, behind those of the partitions before.
    """
    dealt = written(df.withColumn("w_part", F.spark_partition_id()), name)
    counts = dealt.groupBy(key, "w_part").agg(F.count(F.lit(1)).alias("w_c"))
    many = counts.groupBy(key).agg(F.count(F.lit(1)).alias("w_parts")).where("w_parts > 1").select(key)
    before = Window.partitionBy(key).orderBy("w_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    shift = counts.join(many, key, "left_semi").select(key, "w_part", F.coalesce(F.sum("w_c").over(before), F.lit(0)).alias("w_shift"))
    own = F.row_number().over(Window.partitionBy(key, "w_part").orderBy(F.col(key) if tie is None else tie))
    out = dealt.withColumn("w_no", own).join(shift, [key, "w_part"], "left")
    return out.withColumn("w_no", (F.col("w_no") + F.coalesce("w_shift", F.lit(0))).cast("int")).drop("w_part", "w_shift")
