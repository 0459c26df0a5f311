import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from wickwork.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, w_key string, leaf int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = None if r[4] is None else r[4] + more
    return sha(*map(field, (r[0], r[3], r[2], n, r[1])))


def ways(nodes):
    """Root, and per leaf the siblings from below with their sides."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            if (i ^ 1) < len(nodes):
                p.append(("L" if i % 2 else "R") + nodes[i ^ 1])
            else:
                p.append("-")
        nodes, at = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], paths


def fold(node, path):
    for s in path:
        node = sha(s[1:], node) if s[0] == "L" else sha(node, s[1:]) if s[0] == "R" else sha(node)
    return node


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = [], []
    for g in langs:
        mine = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *ways([leaf(r) for r in mine])))
    root, tops = ways([t[1] for t in trees])
    for (mine, subroot, paths), top in zip(trees, tops, strict=True):
        for r, p in zip(mine, paths, strict=True):
            path = p + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            end = fold(leaf(r, int(bad)), path)
            out.append((r[0], leaf(r), subroot, root, sha(*(s[1:] for s in path if s != "-")), end, end == root))
    return sorted(out, key=str)


def rows():
    out = [(i, f"text {i % 90}\n" * (i % 4), ("en", "de", None)[i % 3] if i % 50 else "öst", "s" if i % 11 else None, i % 7 if i % 5 else None, "k", i) for i in range(400)]
    out += [(None, None, "en", None, None, None, 1), (None, None, None, None, None, None, 1), (7, "again", "en", "s", 3, "k", 1), (7, "again", "en", "s", 3, "k", 1), (7, "x" * 100_000, "en", "s", 3, "k", 1)]
    return out + [(9000 + i, "", f"only {i}", "s", 0, "k", 2) for i in range(70)]  # many groups of one row


@pytest.mark.parametrize("stride", [1, 3, 6])
def test_matches_brute_force(spark, monkeypatch, stride):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = merkle.manifest(df, tamper=merkle.tampered()).drop("w_path")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == brute(rows())
    assert {r[6] for r in got} == {True, False}


def test_some_proofs_only(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    wanted = spark.createDataFrame([(7,), (333,), (9001,), (123456,)], "doc_id long")
    got = merkle.manifest(df, wanted=wanted).drop("w_path").collect()
    plain = {(r["doc_id"], r["leaf"]): r for r in merkle.manifest(df).drop("w_path").collect()}
    assert sorted(r["doc_id"] for r in got) == [7, 7, 7, 7, 333, 9001]
    assert all(r == plain[r["doc_id"], r["leaf"]] and r["verified"] for r in got)


def test_small_tables(spark):
    df = spark.createDataFrame(rows()[:1], SCHEMA)
    (one,) = merkle.manifest(df).drop("w_path").collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == sha() and one["verified"]
    assert merkle.manifest(df.where("false")).count() == 0


def test_levels_between_are_not_written(spark):
    leaves = spark.range(200).select(F.lit("v").alias("w_key"), F.col("id").alias("w_idx"), F.lit(200).cast("long").alias("w_n"), F.sha2(F.col("id").cast("string"), 256).alias("w_digest"))
    forest = merkle.build(leaves)
    assert [level.count() for level in forest.levels] == [200, 4, 1]


def test_sql(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = con.sql(merkle.ORACLE_SQL).fetchall()
    # the hash of a null id is null there as well: its leaf stays
    assert sorted(map(tuple, got), key=str) == brute(rows())
