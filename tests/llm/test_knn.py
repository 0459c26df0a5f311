import fractions
import math
import random

import pytest

from wickwork.llm import knn


def whole(x):
    return math.floor(fractions.Fraction(x) * 256)


def brute(rows, k, asked):
    """Of each query row its k best other rows, as a sorted list: repeated ids give repeated results."""
    ok = [(n, i, [whole(x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for m, q, a in ok:
        if asked(q):
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for n, i, b in ok if n != m and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def fiftieth(i):
    return i % 50 == 0


@pytest.mark.parametrize("dim,n,spread", [(8, 1500, 0.05), (3, 400, 0.0), (16, 300, 0.5)])
def test_matches_brute_force(spark, monkeypatch, dim, n, spread):
    monkeypatch.setattr(knn, "BLOCK", 32)
    rng = random.Random(dim)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(None, [0.5] * dim), (n, None), (n + 1, [None] * dim), (n + 2, [float("nan")] * dim), (n + 3, [float("inf")] * dim), (50_000, [0.1] * dim), (100_000, [0.5]), (100_001, [0.25]), (150_000, []), (150_001, [])]
    rows += [(50, [rng.gauss(0, 1) for _ in range(dim)]), (50, [0.25] * dim), (50, [0.25] * dim), (7, [1.0] * dim), (7, [1.0] * dim)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    assert sorted(tuple(r) for r in knn.top_k(df, 5, pivots=12).collect()) == brute(rows, 5, fiftieth)


def test_cells_are_left_out(spark, monkeypatch):
    """Tight clusters: most cells are not sent to most groups, and of a cell only some rows."""
    monkeypatch.setattr(knn, "GROUPS", 8)
    rng = random.Random(1)
    centres = [[10.0 * (i == j) for j in range(12)] for i in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.02) for c in centres[i % 12]]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q, v = knn.pairs_to_solve(df, 5, "vec_id", "embedding", pivots=100)
    assert v.count() < 1200 * 8 / 4 and q.count() < 24 * 100 / 4
    assert sorted(tuple(r) for r in knn.top_k(df, pivots=100).collect()) == brute(rows, 5, fiftieth)


def test_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(knn, "LENGTHS", 3)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice([2, 2, 2, 3, 3, *range(1, 40)]))]) for i in range(400)] + [(400 + i, [1.0] * (300 + i)) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in knn.top_k(df).collect()) == brute(rows, 5, fiftieth)


def test_empty_and_large_values(spark):
    rows = [(0, [1e7, 1.0]), (1, [1e7, 2.0]), (2, [1e7, 2.0]), (50, [3e6, -1.5]), (3, [0.5, -0.25]), (100, [-1e6, 1e-3]), (4, [1e16, 1.0]), (150, [0.0, 3e14]), (200, [1e-300, 0.0])]
    rows = [r for r in rows if r[0] != 4] + [(4, [0.0, 1.0]), (5, [0.0, 9007199254740993.0 / 64])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = [r for r in rows if r[0] not in (150, 5)]
    assert sorted(tuple(r) for r in knn.top_k(df.where("vec_id not in (150, 5)")).collect()) == brute(small, 5, fiftieth)
    huge = [(0, [1.0, 1e14]), (1, [2.0, 1e-5]), (2, [1e16, 0.0])]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in knn.top_k(df.where("vec_id <> 2")).collect()) == brute(huge[:2], 5, fiftieth)
    with pytest.raises(Exception, match="does not fit 64 bits"):
        knn.top_k(spark.createDataFrame([(0, [1e16, 1.0]), (1, [1e16, 2.0])], "vec_id long, embedding array<double>")).collect()
    wide = [(3, [1e16, 1.0]), (1, [0.01, 2.0]), (2, [-0.02, 2.0]), (50, [0.0078125, 1.0])]
    assert sorted(tuple(r) for r in knn.top_k(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), 1).collect()) == brute(wide, 1, fiftieth)
    assert knn.top_k(df.limit(0)).count() == 0
