import random
from collections import defaultdict

import pytest

from wickwork.llm import common, mixing


def level_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    got, open_ = {}, set(names)
    left = share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= cap * sizes[s]]
        if not over:
            return got | {s: left * w[s] / total for s in open_}
        for s in over:
            got[s] = cap * sizes[s]
        open_ -= set(over)
        left -= sum(got[s] for s in over)
    return got


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))), rng.choice(["a", "a", "a", "a", "a", "b", "c", "d", None, ""])) for i in range(6000)]
    rows += [(None, "x y", "b"), (None, "x y", "b"), (7, None, "a"), (7, None, "a"), (8, "one\x0btwo", "zero")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").repartition(3)


def test_mix(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    monkeypatch.setattr(mixing, "FAN_IN", 8)
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").split())
    want = level_targets(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["size"]): r for r in got}
    taken = defaultdict(int)
    for r in rows:
        g = by[r["doc_id"], len((r["text"] or "").split())]
        assert g["source_size"] == sizes[r["source"]] and abs(g["target"] - want[r["source"]]) < 1e-6 * max(1, g["target"])
    target = {r["target"]: 0 for r in got}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        target[r["target"]] += r["taken"]
    for t, x in target.items():
        assert abs(t - x) <= 45, (t, x)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.take(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(1)
    p, size = [rng.random() for _ in range(500)], [float(rng.randint(0, 300)) for _ in range(500)]
    q = mixing.flight(p, size, rng.random)
    assert sum(0 < x < 1 for x in q) <= 2
    assert abs(sum(p) - sum(q)) < 1e-6 and abs(sum(a * b for a, b in zip(p, size, strict=True)) - sum(a * b for a, b in zip(q, size, strict=True))) < 1e-4


def test_one_hot_row_and_many_sources(spark, monkeypatch):
    """Equal rows in one partition or many, and sources by the thousand, at small limits."""
    monkeypatch.setattr(common, "MIN_HOT", 16)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    rng = random.Random(8)
    rows = [(1, "same words here", "hot")] * 500 + [(i, " ".join(["w"] * rng.randint(1, 9)), f"s{rng.randint(0, 300)}" if i % 50 else None) for i in range(2, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = level_targets(sizes)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by = {r["source_size"]: r for r in got if r["doc_id"] == 1}
    assert list(by) == [1500]
    source = dict((r[0], r[2]) for r in rows)
    assert all(abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 and r["taken"] <= 2 * r["size"] for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 9 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()))
    mixed = mixing.take(df)
    assert mixed.where("doc_id = 1").count() == taken["hot"] // 3 and mixed.count() == sum(r["copies"] for r in got)


def test_numbers_of_equals(spark):
    df = spark.createDataFrame([(k % 7 if k % 3 else 0,) for k in range(1000)], "w_key long").repartition(6)
    got = defaultdict(list)
    for r in common.numbered_equals(df, "w_key", "n").collect():
        got[r["w_key"]].append(r["w_no"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values()) and sum(map(len, got.values())) == 1000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "MIN_HOT", 8)
    left = common.written(spark.createDataFrame([(k % 5 if k % 2 else 0, k) for k in range(300)], "a long, x long"), "left")
    right = spark.createDataFrame([(k, -k) for k in (0, 1, 2, 9)], "a long, y long")
    assert sorted(map(str, common.hot_join(left, right, ["a"], how).select("a", "x", "y").collect())) == sorted(map(str, left.join(right, ["a"], how).select("a", "x", "y").collect()))


def test_equals_are_numbered_by_their_other_columns(spark):
    """Rows with equal id, text and source but other columns: the same ones stay, however a task orders them."""
    rows = [(1, "a b c", "s", k) for k in range(9)] + [(k, "w w", "s", 0) for k in range(2, 40)]
    first = spark.createDataFrame(rows, "doc_id long, text string, source string, other int").coalesce(1)
    second = spark.createDataFrame(rows[::-1], first.schema).coalesce(1)
    assert sorted(map(tuple, mixing.take(first).collect())) == sorted(map(tuple, mixing.take(second).collect()))
