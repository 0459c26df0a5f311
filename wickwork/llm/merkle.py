"""Merkle manifest of a table: checkpoint and recompute.

Every row is a leaf, the leaves of a group (here: a language) form a binary tree in the order of their ids, and the groups' roots
form one more tree. Of a tree only every ``STRIDE``-th level is written. Proofs go from the top down: the rows of a written level meet in
aligned subtrees of ``2 ** STRIDE`` nodes at most, each subtree's missing interior nodes are hashed again from these rows, their
siblings are handed to the rows below, and the interior nodes are dropped. No subtree holds more rows than that, however many rows a group has.

Leaves are numbered by a range partitioning over (group, id, digest), counts per (range, group) and a running number inside each; texts
are hashed where they are read and never shuffled. All steps are DataFrame functions.

Defined results: nulls of any column are written as ``-``; null groups and null ids come first; repeated ids are ordered by their digests (fully
equal rows are interchangeable); an empty text is ``0:``; a group of one row is its leaf; an empty table gives an empty result; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.common import written

#: A level is written every so many.
STRIDE = 6
#: The columns that a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that fields cannot run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))


def _counting(n: Column) -> Column:
    """``n`` numbers to fold over, none for 0."""
    return F.slice(F.array(*[F.lit(i) for i in range(STRIDE)]), 1, n)


def _above(nodes: Column) -> Column:
    """One level up: runs of two, the last alone where their number is odd."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1)), lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def _steps(levels: Column, at: Column, steps: Column) -> Column:
    """The way from node ``at`` of ``levels[0]`` upwards: L or R and the sibling at the left or right, ``-`` where there is none."""
    return F.transform(
        _counting(steps),
        lambda k: F.transform(
            F.array(F.floor(at / F.pow(F.lit(2), k)).cast("int")),
            lambda node: F.when(node % 2 == 1, F.concat(F.lit("L"), F.get(F.get(levels, k), node - 1))).otherwise(F.coalesce(F.concat(F.lit("R"), F.get(F.get(levels, k), node + 1)), F.lit("-"))),
        )[0],
    )


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``w_idx``, the number of a row within its ``w_key`` from 0 in the order of ``order``, and ``w_n``, the rows of the key."""
    dealt = written(rows.repartitionByRange("w_key", *order).withColumn("w_range", F.spark_partition_id()), name)
    counts = dealt.groupBy("w_range", "w_key").agg(F.count(F.lit(1)).alias("w_c"))
    of_key = Window.partitionBy("w_key")  # one row per range
    before = F.coalesce(F.sum("w_c").over(of_key.orderBy("w_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("w_range", "w_key", before.alias("w_before"), F.sum("w_c").over(of_key).alias("w_n"))
    inside = F.row_number().over(Window.partitionBy("w_range", "w_key").orderBy(*order)) - 1
    out = dealt.withColumn("w_in", inside).join(counts, ["w_range", "w_key"])
    return out.withColumn("w_idx", (F.col("w_in") + F.col("w_before")).cast("long")).drop("w_in", "w_before", "w_range")


@dataclass
class Forest:
    """The written levels (w_key, w_idx, w_n, w_digest, of the lowest also its other columns), lowest first; and ``roots`` (w_key, w_digest)."""

    levels: list[DataFrame]
    roots: DataFrame


def _subtrees(level: DataFrame) -> DataFrame:
    """A row per aligned subtree: w_key, w_up (its number), w_n, w_steps (levels in it) and w_kids in order."""
    kid = F.struct("w_idx", *[c for c in level.columns if c not in ("w_key", "w_idx", "w_n")])
    groups = level.groupBy("w_key", "w_n", F.shiftright("w_idx", STRIDE).alias("w_up")).agg(F.array_sort(F.collect_list(kid)).alias("w_kids"))
    return groups.withColumn("w_steps", F.least(F.lit(STRIDE), _height(F.col("w_n"))))


def build(leaves: DataFrame, name: str = "merkle") -> Forest:
    """The trees over ``leaves`` (w_key, w_idx, w_n, w_digest, and columns to keep), one per w_key."""
    levels = [written(leaves, f"{name}-0")]
    most = levels[0].agg(F.max("w_n")).first()[0] or 0
    while most > 1:
        up = F.aggregate(_counting(F.col("w_steps")), F.col("w_kids.w_digest"), lambda nodes, _: _above(nodes))
        above = _subtrees(levels[-1].select("w_key", "w_idx", "w_n", "w_digest")).select("w_key", F.col("w_up").alias("w_idx"), (F.shiftright(F.col("w_n") - 1, STRIDE) + 1).alias("w_n"), up[0].alias("w_digest"))
        levels.append(written(above, f"{name}-{STRIDE * len(levels)}"))
        most = (most - 1 >> STRIDE) + 1
    return Forest(levels, levels[-1].select("w_key", "w_digest"))


def proofs(forest: Forest, tops: DataFrame, wanted: DataFrame | None = None, name: str = "merkle") -> DataFrame:
    """The rows of the lowest level with ``w_path``, the steps from the leaf to the end of ``tops``' path.

    ``tops``: w_key, w_path and columns to hand down, one row per key. ``wanted`` (w_key, w_idx): only these leaves; only the subtrees
    on their ways are computed again.
    """
    extra = [c for c in tops.columns if c not in ("w_key", "w_path")]
    down = tops.withColumn("w_up", F.lit(0).cast("long"))
    last = len(forest.levels) - 1
    for k in range(last, 0, -1):
        down = _descend(_subtrees(_asked(forest.levels[k - 1], wanted, k)), down, extra)
        if wanted is not None:
            down = down.join(wanted.select("w_key", F.shiftright("w_idx", STRIDE * (k - 1)).alias("w_idx")).distinct(), ["w_key", "w_idx"], "left_semi")
        if k > 1:
            down = written(down.select("w_key", F.col("w_idx").alias("w_up"), "w_path", *extra), f"{name}-proofs")
    if last:
        return down
    low = forest.levels[0] if wanted is None else forest.levels[0].join(wanted, ["w_key", "w_idx"], "left_semi")
    return low.drop("w_n").join(down.drop("w_up"), "w_key")


def _asked(level: DataFrame, wanted: DataFrame | None, k: int) -> DataFrame:
    """The rows of the subtrees that hold wanted leaves."""
    if wanted is None:
        return level
    ups = wanted.select("w_key", F.shiftright("w_idx", STRIDE * k).alias("w_up")).distinct()
    return level.withColumn("w_up", F.shiftright("w_idx", STRIDE)).join(ups, ["w_key", "w_up"], "left_semi").drop("w_up")


def _descend(groups: DataFrame, down: DataFrame, extra: list[str]) -> DataFrame:
    levels = F.aggregate(_counting(F.col("w_steps")), F.array(F.col("w_kids.w_digest")), lambda got, _: F.concat(got, F.array(_above(F.element_at(got, -1)))))
    met = groups.withColumn("w_levels", levels).join(down, ["w_key", "w_up"])
    met = met.select("w_key", "w_levels", "w_steps", "w_path", *extra, F.explode("w_kids").alias("w_kid"))
    at = F.pmod(F.col("w_kid.w_idx"), F.lit(2**STRIDE)).cast("int")
    return met.select("w_key", "w_kid.*", F.concat(_steps(F.col("w_levels"), at, F.col("w_steps")), "w_path").alias("w_path"), *extra)


def siblings(path: Column) -> Column:
    return F.transform(F.filter(path, lambda s: s != "-"), lambda s: F.substring(s, 2, 64))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    other = lambda s: F.substring(s, 2, 64)
    side = lambda s: F.substring(s, 1, 1)
    return F.aggregate(path, leaf, lambda node, s: digest(F.when(side(s) == "L", F.concat(other(s), node)).when(side(s) == "R", F.concat(node, other(s))).otherwise(node)))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, tamper: Column | None = None, n_col: str = "n_chars", wanted: DataFrame | None = None) -> DataFrame:
    """Per row: the id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` and ``w_path``.

    ``tamper``: where it holds, the leaf to verify is that of a row whose ``n_col`` is one larger. ``wanted``: ids whose proofs are
    asked for (all if None).
    """
    leaf = digest(*[field(F.col(c)) for c in fields])
    other = digest(*[field(F.col(c) + 1 if c == n_col else F.col(c)) for c in fields])
    changed = F.lit(None).cast("string") if tamper is None else F.when(tamper, other)
    key = F.coalesce(F.concat(F.lit("v"), F.col(group_col).cast("string")), F.lit("n"))  # null first
    rows = docs.select(key.alias("w_key"), F.col(id_col).alias("w_id"), leaf.alias("w_digest"), changed.alias("w_changed"))
    forest = build(numbered(rows, [F.col("w_id").asc_nulls_first(), "w_digest"], "merkle-leaves"), "merkle")
    groups = forest.roots.select(F.lit("").alias("w_key"), F.col("w_key").alias("w_group"), "w_digest")
    top = build(numbered(groups, ["w_group"], "merkle-groups"), "merkle-top")
    root = top.roots.select("w_key", F.array().cast("array<string>").alias("w_path"), F.col("w_digest").alias("root"))
    tops = proofs(top, root, name="merkle-top").select(F.col("w_group").alias("w_key"), "w_path", F.col("w_digest").alias("subroot"), "root")
    asked = None
    if wanted is not None:
        asked = written(forest.levels[0].join(wanted.select(F.col(id_col).alias("w_id")).distinct(), "w_id", "left_semi").select("w_key", "w_idx"), "merkle-wanted")
    got = proofs(forest, written(tops, "merkle-tops"), asked)
    got = got.withColumn("folded_root", folded(F.coalesce("w_changed", "w_digest"), F.col("w_path")))
    return got.select(
        F.col("w_id").alias(id_col), F.col("w_digest").alias("leaf"), "subroot", "root", digest(F.array_join(siblings(F.col("w_path")), "")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "w_path",
    )


def tampered(id_col: str = "doc_id") -> Column:
    """The rows of the query that are verified against a changed leaf."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS)
_CHANGED = " || ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)


def _tree_sql(name: str, leaves: str) -> str:
    """Levels of trees over ``leaves`` (key, idx, h), their ends and the walk of each leaf with the siblings seen and the node from ``start``."""
    return f"""{name} AS (SELECT key, 0 AS k, idx, h, count(*) OVER (PARTITION BY key) AS n FROM {leaves}
 UNION ALL SELECT key, k + 1, idx // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
 FROM (SELECT *, lead(h) OVER (PARTITION BY key ORDER BY idx) AS nxt FROM {name} WHERE n > 1) WHERE idx % 2 = 0),
{name}_n AS (SELECT DISTINCT key, k, n FROM {name}),
{name}_walk AS (SELECT rid, key, 0 AS k, idx, '' AS sibs, start AS node FROM {leaves}
 UNION ALL SELECT w.rid, w.key, w.k + 1, w.idx // 2, w.sibs || coalesce(t.h, ''), sha256(CASE WHEN w.idx % 2 = 1 THEN t.h || w.node ELSE w.node || coalesce(t.h, '') END)
 FROM {name}_walk w JOIN {name}_n s ON s.key = w.key AND s.k = w.k AND s.n > 1 LEFT JOIN {name} t ON t.key = w.key AND t.k = w.k AND t.idx = xor(w.idx, 1)),
{name}_end AS (SELECT w.rid, w.key, w.sibs, w.node FROM {name}_walk w JOIN {name}_n s ON s.key = w.key AND s.k = w.k AND s.n = 1)"""


#: The crc32 of the id is folded bit by bit, since this SQL has no function for it.
ORACLE_SQL = f"""
WITH RECURSIVE hashed AS (SELECT doc_id, coalesce('v' || lang, 'n') AS key, sha256({_LEAF}) AS h, sha256({_CHANGED}) AS changed,
 xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
 lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) AS crc FROM documents),
docs AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, CASE WHEN crc % 7 = 0 THEN changed ELSE h END AS start FROM hashed),
{_tree_sql("tree", "docs")},
tops AS (SELECT key AS grp, '' AS key, row_number() OVER (ORDER BY key) - 1 AS idx, row_number() OVER (ORDER BY key) AS rid, h, h AS start FROM tree WHERE n = 1),
{_tree_sql("top", "tops")},
over AS (SELECT g.grp, g.h AS subroot, e.sibs, r.h AS root, g.idx FROM tops g JOIN top_end e USING (rid), (SELECT h FROM top WHERE n = 1) r),
upper AS (SELECT e.rid, '' AS key, 0 AS k, o.idx, e.node, e.sibs || o.sibs AS sibs, o.subroot, o.root FROM tree_end e JOIN over o ON o.grp = e.key
 UNION ALL SELECT w.rid, w.key, w.k + 1, w.idx // 2, sha256(CASE WHEN w.idx % 2 = 1 THEN t.h || w.node ELSE w.node || coalesce(t.h, '') END), w.sibs, w.subroot, w.root
 FROM upper w JOIN top_n s ON s.k = w.k AND s.n > 1 LEFT JOIN top t ON t.k = w.k AND t.idx = xor(w.idx, 1))
SELECT d.doc_id, d.h AS leaf, u.subroot, u.root, sha256(u.sibs) AS proof_sha256, u.node AS folded_root, u.node = u.root AS verified
FROM upper u JOIN top_n s ON s.k = u.k AND s.n = 1 JOIN docs d USING (rid)
"""
