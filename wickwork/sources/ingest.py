"""Ingest: decode provider payloads, clean, adjust, upsert, and plan what is missing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickwork.operators import series
from wickwork.schema import KEY
from wickwork.sources.scratch import written

BAR_KEY = (*KEY, "tf_seconds", "ts")


def whole_seconds(ts: str = "ts") -> Column:
    return F.date_trunc("SECOND", F.col(ts)).cast("timestamp_ntz")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables by (key, timeframe, ts), the new rows winning; of several new rows the one with the largest ``seq``."""
    both = old.withColumn("w_gen", F.lit(0)).unionByName(new.withColumn("w_gen", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*BAR_KEY).orderBy(F.col("w_gen").desc(), F.col("seq").desc_nulls_last())
    return both.withColumn("w_rn", F.row_number().over(w)).where("w_rn = 1").drop("w_rn", "w_gen")


def write_bars(bars: DataFrame, path: str) -> None:
    """Partitioned by source, ticker and month: a later run replaces only the months it touches."""
    out = bars.withColumn("month", F.date_format("ts", "yyyy-MM")).repartition("source", "ticker", "month").sortWithinPartitions("ts")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "ticker", "month").parquet(path)


def merge_table(path: str, new: DataFrame, key: list[str], newest: list[str], partitions: list[str]) -> None:
    """Merges rows into a Parquet table by ``key``: the one that is largest by ``newest`` stays, and only the partitions that ``new`` touches are read and written.

    The old side is read through a join with the touched partitions, so that files of others are pruned; the merged rows are written beside the table before
    they replace these partitions, each of which becomes one file. The same rows merged twice change nothing. A table that is not there yet is begun.
    """
    spark = new.sparkSession
    order = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in newest])
    rows = new
    if _there(spark, path):
        new = written(new, "merge-new")
        old = spark.read.schema(new.schema).option("basePath", path).parquet(path)
        rows = new.unionByName(old.join(new.select(*partitions).distinct(), partitions, "left_semi"))
    merged = written(rows.withColumn("w_rn", F.row_number().over(order)).where("w_rn = 1").drop("w_rn"), "merge")
    merged.repartition(*partitions).sortWithinPartitions(*key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


MONTH = ["source", "ticker", "month"]


def with_month(bars: DataFrame) -> DataFrame:
    return bars.withColumn("month", F.date_format("ts", "yyyy-MM"))


def append_bars(path: str, new: DataFrame, gen: int) -> None:
    """Upserts ``new`` (key, tf_seconds, ts and values; generation ``gen``) into the bars table at ``path``; later generations win, months without new bars keep their files."""
    merge_table(path, with_month(new).withColumn("gen", F.lit(gen).cast("long")), list(BAR_KEY), ["gen"], MONTH)


def read_from(path: str, starts: DataFrame, end: str, schema) -> DataFrame:
    """Bars of the table at ``path`` from each key's own ``start`` (key, start) to ``end``, both included.

    The months that keys need are few rows; joined on the partition columns they prune the scan while it is planned and run.
    """
    spark = starts.sparkSession
    last = F.lit(end).cast("timestamp_ntz")
    months = F.sequence(F.trunc(F.col("start").cast("date"), "month"), F.trunc(last.cast("date"), "month"), F.expr("interval 1 month"))
    wanted = starts.where(F.col("start") <= last).select(*KEY, "start", F.explode(months).alias("w_m")).select(*KEY, "start", F.date_format("w_m", "yyyy-MM").alias("month"))
    return spark.read.schema(schema).parquet(path).join(wanted, MONTH).where((F.col("ts") >= F.col("start")) & (F.col("ts") <= last)).drop("start", "month", "gen")


def in_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    """``start <= ts <= end``, both included; literal bounds reach the Parquet scan."""
    return bars.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))


def coverage_gaps(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """(key, tf_seconds, gap_start, gap_end): what lies before the first and after the last bar held; all of it if none is. Holes inside are not reported."""
    have = bars.groupBy(*KEY, "tf_seconds").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    r = requests.join(have, [*KEY, "tf_seconds"], "left")
    gap = lambda ok, a, b: F.when(ok, F.struct(a.alias("gap_start"), b.alias("gap_end")))
    s, e, lo, hi = F.col("start"), F.col("end"), F.col("lo"), F.col("hi")
    gaps = F.array_compact(F.array(gap(lo.isNull(), s, e), gap(s < lo, s, F.least(lo, e)), gap(e > hi, F.greatest(hi, s), e)))
    return r.select(*KEY, "tf_seconds", F.explode(gaps).alias("g")).select(*KEY, "tf_seconds", "g.*")


def backfill_plan(gaps: DataFrame, page: int = 1000) -> DataFrame:
    """Provider requests of at most ``page`` bars that cover the gaps."""
    from wickwork.functions.sessions import at, epoch

    step = F.col("tf_seconds") * page
    p = gaps.withColumn("w_e", F.explode(F.sequence(epoch("gap_start"), epoch("gap_end"), step)))
    p = p.withColumn("w_to", F.least(F.col("w_e") + step - F.col("tf_seconds"), epoch("gap_end")))
    return p.withColumn("page_start", at("w_e")).withColumn("page_end", at("w_to")).select(*KEY, "tf_seconds", "page_start", "page_end")


def decode_klines(raw: DataFrame, col: str = "payload") -> DataFrame:
    """JSON arrays ``[[open_ms, "o", "h", "l", "c", "v", ...], ...]`` to bars, other columns kept."""
    rest = [c for c in raw.columns if c != col]
    k = raw.select(*rest, F.explode(F.from_json(col, "array<array<string>>")).alias("k"))
    num = lambda i: F.get("k", F.lit(i)).cast("double")
    return k.withColumn("w_sec", F.floor(F.get("k", F.lit(0)).cast("long") / 1000)).withColumn("ts", F.expr("timestampadd(SECOND, w_sec, TIMESTAMP_NTZ'1970-01-01 00:00:00')")).select(
        *rest, "ts", num(1).alias("open"), num(2).alias("high"), num(3).alias("low"), num(4).alias("close"), num(5).alias("volume")
    )


def decode_exchange_info(raw: DataFrame, col: str = "payload") -> DataFrame:
    """base, quote and tick size of a symbol's exchange information; 0.01, an empty base and USDT where something is missing."""
    schema = "symbols array<struct<baseAsset:string,quoteAsset:string,filters:array<struct<filterType:string,tickSize:string>>>>"
    s = F.get(F.from_json(col, schema)["symbols"], F.lit(0))
    tick = F.get(F.filter(s["filters"], lambda f: f["filterType"] == "PRICE_FILTER"), F.lit(0))["tickSize"]
    whole = s["baseAsset"].isNotNull() & s["quoteAsset"].isNotNull() & tick.isNotNull()
    pick = lambda c, d: F.when(whole, c).otherwise(F.lit(d))
    return raw.withColumns({"base": pick(s["baseAsset"], ""), "quote": pick(s["quoteAsset"], "USDT"), "tick_size": pick(tick.cast("double"), 0.01)})


def decode_trendbars(raw: DataFrame, offset_minutes: int = 0) -> DataFrame:
    """``low`` and unsigned deltas in 1/100000 to bars; ``minutes`` less the server's offset."""
    rest = [c for c in raw.columns if c not in ("low", "delta_open", "delta_high", "delta_close", "volume", "minutes")]
    price = lambda d: (F.col("low") + F.col(d)) / 100000.0
    raw = raw.withColumn("w_min", F.col("minutes") - offset_minutes)
    return raw.select(
        *rest, F.expr("timestampadd(MINUTE, w_min, TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias("ts"), price("delta_open").alias("open"),
        price("delta_high").alias("high"), (F.col("low") / 100000.0).alias("low"), price("delta_close").alias("close"), F.col("volume").cast("double").alias("volume"),
    )


def adjust_splits(bars: DataFrame, split: str = "split") -> DataFrame:
    """Prices divided and volume multiplied by the product of all splits after the row; 0 or null is no split."""
    s = F.coalesce(F.when(F.col(split) != 0, F.col(split)), F.lit(1.0))
    out = series.with_later_product(bars, (*KEY, "tf_seconds"), "ts", s, "w_after")
    return out.withColumns({c: F.col(c) / F.col("w_after") for c in ("open", "high", "low", "close")} | {"volume": F.col("volume") * F.col("w_after")}).drop("w_after", split)


def drop_bad(bars: DataFrame) -> DataFrame:
    """Without rows that miss a price (null or NaN)."""
    return bars.dropna(subset=["open", "high", "low", "close"])


def local_to_utc(bars: DataFrame, tz: str) -> DataFrame:
    return bars.withColumn("ts", F.expr(f"convert_timezone('{tz}', 'UTC', ts)"))


def route_native(request_tf: Column) -> Column:
    """Contracts' bars of up to one hour are the provider's own, longer ones are rebuilt from hourly bars."""
    return F.when(request_tf <= 3600, F.lit("native")).otherwise(F.lit("rebuilt"))


def universes(files: DataFrame) -> DataFrame:
    """(name, source, ticker, pos) of universe files (name, text): a bare list of tickers, or an object with source and tickers."""
    bare = F.from_json("text", "array<string>")
    whole = F.from_json("text", "source string, tickers array<string>")
    is_list = F.ltrim(F.col("text")).startswith("[")
    t = files.select("name", F.when(~is_list, whole["source"]).alias("source"), F.posexplode(F.when(is_list, bare).otherwise(whole["tickers"])).alias("pos", "ticker"))
    return t.select("name", "source", "ticker", "pos")


def read_universes(spark, path: str) -> DataFrame:
    """Universe files of a folder; the stem is the name."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("name"), F.col("value").alias("text"))
    return universes(files)


def run_results(metrics: DataFrame, equity: DataFrame, trades: DataFrame, by: list[str]) -> DataFrame:
    """(run key, result JSON, run_id): metrics, equity curve and trades in time order, and a 16-digit content address."""
    e = equity.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "equity"))), lambda p: F.struct(F.date_format(p["ts"], "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), p["equity"].alias("equity"))).alias("equity_curve"))
    cols = [c for c in trades.columns if c not in by]
    t = trades.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("entry_time", *[c for c in cols if c != "entry_time"]))).alias("trades"))
    m = metrics.select(*by, F.struct(*[c for c in metrics.columns if c not in by]).alias("metrics"))
    r = m.join(e, by, "left").join(t, by, "left").select(*by, F.to_json(F.struct("metrics", "equity_curve", F.coalesce("trades", F.array().cast(t.schema["trades"].dataType)).alias("trades"))).alias("result"))
    return r.withColumn("run_id", F.substring(F.sha2("result", 256), 1, 16))
