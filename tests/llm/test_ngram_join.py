import random
import re

import numpy as np
import pytest

from wickwork.llm import common, components, ngram_join, words


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    ids = [r[0] for r in rows]
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is None or ids[b] is None:
                continue
            both = len(sets[a] & sets[b])
            if ids[a] == ids[b] or both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    low = {}
    for x, i in enumerate(ids):
        if i is not None:
            low[root(x)] = min(low.get(root(x), i), i)
    return sorted((i if i is not None else -1, len(s), low[root(x)] if i is not None else -1) for x, (i, s) in enumerate(zip(ids, sets, strict=True)))


def table(seed, n):
    rng = random.Random(seed)
    words_ = [f"w{i}" for i in range(300)]
    common = [rng.choice(words_) for _ in range(60)]
    rows = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and rows:
            t = list(rng.choice(rows)[1].split())
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words_).upper()
        else:
            t = [rng.choice(words_) for _ in range(rng.choice([1, 2, 3, 9, 12, 30, 60, 120]))]
            if kind > 0.8:
                t += common
        rows.append((len(rows), rng.choice([" ", "\n", "\x0b "]).join(t)))
    return rows


@pytest.mark.parametrize("k,percent,frequent,block", [(3, 90, 1000, 512), (3, 90, 3, 4), (5, 80, 5, 8)])
def test_matches_brute_force(spark, monkeypatch, k, percent, frequent, block):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    monkeypatch.setattr(ngram_join, "SMALL", 24 if block > 100 else 3)
    rows = table(k * percent + frequent, 350)
    rows += [(9000, None), (9001, ""), (9002, " \n"), (None, rows[3][1]), (None, None), (9003, "été x\xa0y"), (9004, "ÉTÉ x\xa0y"), (9005, "one two"), (9006, "ONE  two"), (5, rows[5][1]), (9005, "quite another text than the one before it")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n int").repartition(5)
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in ngram_join.linked(df, k=k, percent=percent).collect())
    assert got == brute(rows, k, percent)
    assert ngram_join.linked(df.limit(0), k=k, percent=percent).count() == 0
    kept = ngram_join.one_of_each(df.dropDuplicates(["doc_id"]).where("doc_id is not null"), k=k, percent=percent)
    assert kept.columns == df.columns


def test_prefixes_are_sufficient():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for _ in range(400):
            n = int(rng.integers(4, 120))
            base = rng.integers(0, 2**63, n, dtype=np.uint64)
            base = np.unique(base)
            drop, extra = rng.integers(0, n // 8 + 2), rng.integers(0, n // 8 + 2)
            other = np.unique(np.r_[rng.permutation(base)[drop:], rng.integers(0, 2**63, extra, dtype=np.uint64)])
            both = len(np.intersect1d(base, other))
            if 100 * both < percent * (len(base) + len(other) - both) or np.array_equal(base, other):
                continue
            weight = lambda s: (s % np.uint64(5)).astype(float)
            for frequent in (0, 2, 4):
                a, b = (ngram_join.signatures(s, weight(s), percent, frequent, ngram_join.classes(percent)) for s in (base, other))
                assert len(np.intersect1d(a, b)), (percent, n, frequent)


def test_long_text_in_slices(monkeypatch):
    text = (" ".join(f"Word{i % 977}é" for i in range(4000)) + "  ").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = [x for *_, x, _ in words.hashes(data, offsets)][0]
    monkeypatch.setattr(words, "SLICE", 500)
    assert np.array_equal(whole, [x for *_, x, _ in words.hashes(data, offsets)][0]) and len(whole) == 4000


def test_packed_sums():
    rng = np.random.default_rng(2)
    for sums in (np.zeros(50, np.int64), np.arange(50), np.where(np.arange(5000) % 701 == 3, 70_000, 0), rng.integers(0, 300, 64)):
        assert (ngram_join._unpacked(ngram_join._packed(sums)) == sums).all()


def test_hot_keys(spark, monkeypatch):
    """One bucket, one leader and one label of nearly all nodes, at small limits."""
    monkeypatch.setattr(common, "MIN_HOT", 16)
    links = spark.createDataFrame([(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert got == {k: 0 for k in range(400)} | {k: 1000 for k in range(1000, 1041)}
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[:59], f"x{i}"])) for i in range(120)] + [(500, "other text of four")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.linked(df).collect()}
    assert got == {i: 0 for i in range(120)} | {500: 500}


def test_one_of_each_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "x", 5), (2, text + " more", "y", 6), (3, "something else", "z", 7)], "doc_id long, text string, w_gone string, component_id int")
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3]
