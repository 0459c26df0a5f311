import hashlib
import re

import pytest
import xxhash

from wickwork.llm import fingerprint as fp


def xx(text, k):
    """The 64-bit hash of a text and an integer, as the session computes it."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return xxhash.xxh64_intdigest(int(k).to_bytes(4, "little", signed=True), h)


def vector(text):
    n, wide, counts = 0, [0] * fp.WIDE, [0] * (2 * fp.SEEDS * fp.BITS)
    for p in (text or "").split("\n"):
        if not p:
            continue
        wide = [(w + xx(p, k)) % 2**32 for k, w in enumerate(wide)]
        for u in re.findall(fp._STRETCHES, p):
            n += 1
            for s in range(fp.SEEDS):
                h = xx(u, s)
                for t in range(fp.BITS):
                    i = 2 * (s * fp.BITS + t)
                    counts[i] += h >> t & 1
                    counts[i + 1] += h >> (t + 31) & 1
    return n, wide, counts


def as_text(v):
    n, wide, c = v
    packed = [c[i] | c[i + 1] << 31 for i in range(0, len(c), 2)]
    return "".join(f"{x:016x}" for x in (n, *wide, *packed))


def likeness(a, b):
    if as_text(a) == as_text(b):
        return 1.0
    signs = lambda v: [2 * c - v[0] for c in v[2]]
    x, y = signs(a), signs(b)
    size = sum(i * i for i in x) + sum(j * j for j in y)
    return min(1.0, max(0.0, 2 * sum(i * j for i, j in zip(x, y, strict=True)) / size)) if size else 0.0


def brute(rows):
    key = lambda r: hashlib.sha256(f"{'-' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, key(r)))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        q = len(text) // 4
        new = text[: len(text) - q] + after[:q]
        own, other, nxt = vector(text), vector(new), vector(after)
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), as_text(own), as_text(other), round(likeness(own, other), 9), round(likeness(own, nxt), 9)))
    return sorted(out, key=str)


def got(df):
    return sorted(((*r[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fp.fingerprints(df).collect()), key=str)


def rows():
    out = [(i, "\n".join(f"Line {i} {j}, with words enough. And a second sentence! été {'x' * (j % 9)}" for j in range(i % 13))) for i in range(120)]
    out += [(200, None), (201, ""), (202, "\n\n"), (203, " "), (204, "abc"), (205, "no line end " * 3000), (206, "x" * 50_000), (207, "a.\n" * 2000), (208, "y\n"), (209, "\ny")]
    return out + [(None, "null id"), (None, "null id"), (None, "another"), (5, "same id"), (5, None)]


@pytest.mark.parametrize("copies", [4096, 3])
def test_matches_brute_force(spark, monkeypatch, copies):
    monkeypatch.setattr(fp, "COPIES", copies)
    table = rows() + [(300, "a copy\nof two lines here")] * 11
    df = spark.createDataFrame([(*r, "k", i) for i, r in enumerate(table)], "doc_id long, text string, w_key string, n_chars int").repartition(6)
    assert got(df) == brute(table)


def test_without_repeated_rows(spark):
    table = [r for i, r in enumerate(rows()) if r not in rows()[:i]]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert got(df) == brute(table)
    plan = fp.fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_small_tables(spark):
    one = [(1, "only one document here")]
    assert got(spark.createDataFrame(one, "doc_id long, text string")) == brute(one)
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_homomorphic(spark):
    """Order does not matter; paragraphs can be inserted and deleted without the rest."""
    a, b = "first paragraph\nsecond one, a bit longer than that. Is it?\nthird", "more\nfirst paragraph"
    names = {"a": a, "b": b, "both": a + "\n" + b, "turned": "\n".join(reversed(a.split("\n")))}
    df = spark.createDataFrame(list(names.items()), "name string, text string")
    sums = fp.summed(df, ["name"], fp.signed(fp.paragraphs(df["text"]), 1))
    v = {r["name"]: r["w_sum"] for r in sums.collect()}
    both = spark.createDataFrame([(v["a"], v["b"], v["both"])], "a array<long>, b array<long>, both array<long>")
    r = both.select(fp.plus("a", "b").alias("p"), fp.minus("both", "b").alias("m"), fp.plus("both", fp._array(*[0] * fp.NUMBERS)).alias("both"), fp.plus("a", fp._array(*[0] * fp.NUMBERS)).alias("a")).first()
    assert r["p"] == r["both"] and r["m"] == r["a"] and v["turned"] == v["a"] and v["a"] != v["both"]


def test_likeness_follows_the_shared_part(spark):
    lines = [f"This is sentence number {i} of a document with words of its own {i * 7}." for i in range(60)]
    other = [f"Something else altogether stands in line {i} of the other text {i * 3}." for i in range(60)]
    table = [(0, "\n".join(lines)), (1, "\n".join(lines[:45] + other[:15])), (2, "\n".join(other))]
    near = {r["doc_id"]: r["near_next"] for r in fp.fingerprints(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert 0.5 < near[0] < 0.95 and near[1] < 0.5 and near[2] < 0.3
