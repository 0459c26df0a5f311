"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, full digests and rule precedence.

Each url becomes its (host suffix, path prefix) expressions, for the label counts and path lengths
that occur among the rules (two sets; rules of so many bytes have at most the root of twice that number of different lengths). Expressions meet the rules on the
first 32 bits of a SHA-256; the full digest and the rule's text confirm a match. The longest rule
wins; between equally long ones the longer host, then ``block``.

Rules of up to ``BROADCAST_RULES`` rows (counted) are broadcast; more are joined by shuffle, with
salted copies of the rules so that a hot expression (``com/``) spreads over as many tasks as a shuffle has partitions, ``SALTS`` at most.

Defined results: a null url or one without ``://`` has empty host and path and no rule; a url
without rule gets ``default``; null hosts or paths in rules count as empty, and an empty host fits urls with an empty host; repeated and
contradicting rules collapse by precedence; repeated pages stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 20_000
SALTS = 256
#: Fixed values of the contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "host string, path string, verdict string")


def parts(url):
    """(host, path) columns of a url column."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def _keyed(host, path):
    digest = F.sha2(F.concat_ws("\n", host, path).cast("binary"), 256)
    return digest, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """``keep`` columns of ``pages`` with host, path, rule and verdict, one row per page row."""
    rank = F.struct(F.length("r_rule"), F.length("r_host"), (F.col("r_verdict") == "block").cast("int"), "r_rule", "r_verdict")
    r = rules.select(F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.coalesce("verdict", F.lit(default)).alias("r_verdict")).distinct()
    digest, short = _keyed(F.col("r_host"), F.col("r_path"))
    r = r.withColumn("r_rule", F.concat("r_host", "r_path")).select(digest.alias("r_digest"), short.alias("w_short"), "r_host", "r_path", rank.alias("w_rank"))
    shapes = r.agg(F.collect_set(F.size(F.split("r_host", "\\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths"), F.count(F.lit(1)).alias("n")).first()
    host, path = parts(F.col(url_col))
    p = pages.select(F.struct(*keep).alias("w_keep"), host.alias("w_host"), path.alias("w_path"), F.col(url_col).contains("://").alias("w_url")).withColumn("w_row", F.monotonically_increasing_id())
    # one literal each, however many there are
    labels, lengths = (F.split(F.lit(",".join(map(str, sorted(shapes[c])))), ",").cast("array<int>") if shapes[c] else F.array().cast("array<int>") for c in ("labels", "lengths"))
    p = p.withColumn("w_split", F.split("w_host", "\\."))
    suffixes = F.transform(F.filter(labels, lambda k: k <= F.size("w_split")), lambda k: F.array_join(F.slice("w_split", F.size("w_split") - k + 1, k), "."))
    prefixes = F.transform(F.filter(lengths, lambda k: k <= F.length("w_path")), lambda k: F.substring(F.col("w_path"), F.lit(1), k))
    p = p.withColumn("w_suffixes", suffixes).withColumn("w_prefixes", prefixes)
    pairs = F.flatten(F.transform("w_suffixes", lambda h: F.transform("w_prefixes", lambda q: F.struct(h.alias("h"), q.alias("q")))))
    e = p.select("w_row", "w_keep", "w_host", "w_path", F.explode_outer(F.when(F.col("w_url"), pairs)).alias("w_e"))
    digest, short = _keyed(F.col("w_e.h"), F.col("w_e.q"))
    e = e.withColumn("w_digest", F.when(F.col("w_e").isNotNull(), digest)).withColumn("w_short", F.when(F.col("w_e").isNotNull(), short))
    if shapes["n"] <= BROADCAST_RULES:
        hit = e.join(F.broadcast(r), "w_short", "left")
    else:
        salts = max(1, min(SALTS, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        salted = r.withColumn("w_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hit = e.withColumn("w_salt", F.pmod(F.xxhash64("w_row"), F.lit(salts)).cast("int"))
        hit = hit.withColumn("w_short", F.coalesce("w_short", -1 - F.col("w_row"))).join(salted, ["w_short", "w_salt"], "left")
    sure = (F.col("w_digest") == F.col("r_digest")) & (F.col("w_e.h") == F.col("r_host")) & (F.col("w_e.q") == F.col("r_path")) & ((F.col("r_host") != "") | (F.col("w_host") == ""))
    best = hit.groupBy("w_row").agg(F.first("w_keep").alias("w_keep"), F.first("w_host").alias("host"), F.first("w_path").alias("path"), F.max(F.when(sure, F.col("w_rank"))).alias("w_best"))
    return best.select("w_keep.*", "host", "path", F.col("w_best.r_rule").alias("rule"), F.coalesce(F.col("w_best.r_verdict"), F.lit(default)).alias("verdict"))


ORACLE_SQL = r"""
WITH r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
s AS (SELECT page_id, url, row_number() OVER () AS n,
             CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT n, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
"""
