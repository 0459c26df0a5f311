"""Exact top-k search by inner product: a Voronoi kNN join.

Components are quantised to integers (``floor(256 * x)``, x as double) and scores are exact integers.
Data go to the cell of their nearest pivot, queries to the group of theirs (pivots: a bounded sample of
the data whose number grows with it, up to ``PIVOTS``; the first ``GROUPS`` of them group the queries). Summaries of the
cells (rows, radius, largest norm, and the distances of the ``k`` + 1 rows nearest to the pivot s) bound the scores
of a query q from below and above:

    q.s - |q| d <= q.v <= min(q.s + |q| |v - s|, |q| |v|)     for a row v at most d from s

From below, the summaries give each query a score that at least k rows reach (its floor); a cell whose score
from above stays under it is not visited by that query. A cell's rows are replicated only to the groups with such
queries, and of them only rows that, by their own distance and norm, may reach the group's lowest floor.
What meets is solved locally; partial results, k per query and block, are merged.

Hot cells: what a group sends to a cell and the cell's rows are cut into blocks of ``BLOCK`` rows by a hash of the row's
number, so no task gets a whole cell, also where many rows are equal. The ``LENGTHS`` most frequent vector lengths have pivots; vectors of other lengths, and
such with components beyond ``WIDE``, are compared with all of their length, in blocks as well.

Defined results: vectors that are null, or hold null or non-finite components, take no part; vectors meet only
vectors of their own length; empty vectors score 0; equal scores go to the smaller id; rows with a null id
are no queries and take no part. A row is a candidate of every query row but itself: a repeated id is several candidates and
several queries, each with its own result rows. Fewer than k candidates give fewer rows; an empty table gives an empty
result. Components of any size are computed exactly; a best score that does not fit 64 bits is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.common import written

#: Most pivots of a length, rows a pivot, groups of queries, rows of a block, lengths with pivots, largest component with bounds.
PIVOTS, PER_PIVOT, GROUPS, BLOCK, LENGTHS, WIDE = 512, 1024, 16, 2048, 64, 2.0**40
DEALT = "uid long, id long, v array<double>, dim int, cell int, far double, norm double"


def vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v array<double>, dim) of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("v"), F.size(vec_col).alias("dim"))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of doubles, not yet quantised."""
    return np.concatenate([np.asarray(v, np.float64) for v in column]).reshape(len(column), dim) if len(column) and dim else np.zeros((len(column), dim))


def _quantised(m: np.ndarray) -> np.ndarray:
    return np.floor(m * 256)


def _nearest(m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest pivot, and its distance from above."""
    cell = (-2 * m @ p.T + (p * p).sum(1)).argmin(1)
    return cell, np.sqrt(((m - p[cell]) ** 2).sum(1)) * (1 + 1e-12)


def assign(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds each row's cell (-1: without pivot), distance to its pivot and norm, from above."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                m = _matrix(part["v"], dim)
                cell, far, norm = np.full(len(part), -1), np.full(len(part), np.inf), np.full(len(part), np.inf)
                tame = (np.abs(m) < WIDE).all(1)
                if dim in pivots and tame.any():
                    q = _quantised(m[tame])
                    cell[tame], far[tame] = _nearest(q, pivots[dim])
                    norm[tame] = np.sqrt((q * q).sum(1)) * (1 + 1e-12)
                yield part.assign(cell=cell, far=far, norm=norm)

    return rows.select("uid", "id", "v", "dim").mapInPandas(run, DEALT)


def visits(asked: DataFrame, pivots: dict[int, np.ndarray], cells: dict[int, tuple], k: int, groups: int) -> DataFrame:
    """Queries with their group and the cells they visit: (uid, v, dim, g, cells, dots, low, size).

    ``cells`` per length: cell numbers, radii, largest norms, and the distances of the nearest rows (cell number's place, distance).
    ``dots``: q.s of the visited cells; ``low``: the query's floor less rounding; ``size``: its norm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                q = _quantised(_matrix(part["v"], dim))
                p = pivots[dim]
                no, radius, norm, place, near = cells[dim]
                dots, size = q @ p[no].T, np.sqrt((q * q).sum(1)) * (1 + 1e-12)
                floors = dots[:, place] - size[:, None] * near
                # k + 1 rows: one of them may be the query itself
                low = np.partition(floors, floors.shape[1] - k - 1, axis=1)[:, floors.shape[1] - k - 1] if floors.shape[1] > k else np.full(len(q), -np.inf)
                low = low - 1e-9 * size * max(float(norm.max()), float(np.sqrt((p * p).sum(1)).max())) - 1e-9
                above = np.minimum(dots + size[:, None] * radius, size[:, None] * norm)
                goes = above >= low[:, None]
                g = _nearest(q, p[:groups])[0]
                yield pd.DataFrame({
                    "uid": part["uid"].to_numpy(), "v": part["v"].to_numpy(), "dim": np.full(len(part), dim), "g": g, "cells": [no[x] for x in goes], "dots": [d[x] for d, x in zip(dots, goes, strict=True)], "low": low, "size": size, "id": part["id"].to_numpy(),
                })

    return asked.select("uid", "id", "v", "dim").mapInPandas(run, "uid long, v array<double>, dim int, g int, cells array<int>, dots array<double>, low double, size double, id long")


def _whole(x: float) -> int:
    return int(x) * 256 if abs(x) >= 2.0**53 else math.floor(256 * x)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of quantised vectors: by floating point where all sums fit in 53 bits, in 64-bit integers, else in Python's."""
    if q.size == 0 or v.size == 0:
        return np.zeros((len(q), len(v)), np.int64)
    top = 256.0 * float(np.abs(q).max()) * 256.0 * float(np.abs(v).max()) * q.shape[1] if np.abs(q).max() < 2.0**500 and np.abs(v).max() < 2.0**500 else np.inf
    if top < 2.0**52:
        return (_quantised(q) @ _quantised(v).T).astype(np.int64)
    if top < 2.0**62:
        return _quantised(q).astype(np.int64) @ _quantised(v).astype(np.int64).T
    return np.vectorize(_whole, otypes=[object])(q) @ np.vectorize(_whole, otypes=[object])(v).T


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best rows, in order."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[place < k]


def _found(s: np.ndarray, own: np.ndarray, vi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of each row's k best, own ones left out."""
    if s.dtype == object:
        best = [(r, x) for r, row in enumerate(s) for x in sorted((-v, vi[c], c) for c, v in enumerate(row) if not own[r, c])[:k]]
        if any(abs(x[0]) >= 2**63 for _, x in best):
            raise OverflowError("a best score does not fit 64 bits")
        return np.array([r for r, _ in best], int), np.array([x[2] for _, x in best], int), np.array([-x[0] for _, x in best], np.int64)
    # all that reach the k-th score, so that ties can be settled by id
    ranked = np.where(own, np.iinfo(np.int64).min, s)
    floor = np.partition(ranked, s.shape[1] - min(k, s.shape[1]), axis=1)[:, s.shape[1] - min(k, s.shape[1])]
    r, c = np.nonzero((ranked >= floor[:, None]) & ~own)
    pick = _best(r, vi[c], s[r, c], k)
    return r[pick], c[pick], s[r, c][pick]


def solve(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of a data block for each query of a query block."""
    out: dict[str, list] = {"uid": [], "query_id": [], "vec_id": [], "score": []}
    if len(left) and len(right):
        dim = len(left["v"].iloc[0])
        q, v = _matrix(left["v"], dim), _matrix(right["v"], dim)
        qu, qi, vu, vi = left["uid"].to_numpy(), left["id"].to_numpy(), right["uid"].to_numpy(), right["id"].to_numpy()
        for a in range(0, len(q), 512):
            r, c, score = _found(_exact(q[a : a + 512], v), qu[a : a + 512, None] == vu[None, :], vi, k)
            for name, x in (("uid", qu[a + r]), ("query_id", qi[a + r]), ("vec_id", vi[c]), ("score", score)):
                out[name].append(x)
    return pd.DataFrame({n: np.concatenate(x) if x else np.zeros(0, np.int64) for n, x in out.items()})


def top_k(rows: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", is_query=None, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best other rows. ``is_query``: a column over ``id``; ``pivots``: instead of a number by rows."""
    q, v = pairs_to_solve(rows, k, id_col, vec_col, is_query, pivots)
    key = ["dim", "g", "cell", "q_block", "v_block"]
    found = q.groupBy(*key).cogroup(v.groupBy(*key)).applyInPandas(lambda a, b: solve(a, b, k), "uid long, query_id long, vec_id long, score long")
    last = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pairs_to_solve(rows: DataFrame, k: int, id_col: str, vec_col: str, is_query=None, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries and data, dealt to the (length, group, cell, blocks) where they must meet."""
    is_query = F.pmod(F.col("id"), F.lit(50)) == 0 if is_query is None else is_query
    data = written(vectors(rows, id_col, vec_col).withColumn("uid", F.monotonically_increasing_id()), "knn-vectors")
    often = data.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(LENGTHS).collect()
    wanted = {r["dim"]: pivots or min(PIVOTS, max(GROUPS, r["count"] // PER_PIVOT)) for r in often if r["dim"]}
    # pivots: per length, the rows of smallest hash among a share of the rows
    tame = F.forall("v", lambda c: F.abs(c) < WIDE)
    near = [data.where((F.col("dim") == r["dim"]) & tame & (F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) <= min(1.0, 8 * wanted[r["dim"]] / r["count"]) * (1 << 30))) for r in often if r["dim"]]
    centre = {}
    for (dim, n), part in zip(wanted.items(), near, strict=True):
        chosen = part.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(n).collect()
        if chosen:
            centre[dim] = _quantised(_matrix([r["v"] for r in chosen], dim))
    dealt = written(assign(data, centre), "knn-cells")
    held = dealt.where("cell >= 0")
    by_far = F.row_number().over(Window.partitionBy("dim", "cell", "w_part").orderBy("far"))  # parts of a cell first: no task sorts a whole one
    close = held.select("dim", "cell", "far", F.pmod("uid", F.lit(256)).alias("w_part")).withColumn("w_n", by_far).where(F.col("w_n") <= k + 1)
    close = close.groupBy("dim", "cell").agg(F.slice(F.array_sort(F.collect_list("far")), 1, k + 1).alias("near"))
    found = held.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.max("norm").alias("norm")).join(close, ["dim", "cell"]).collect()  # at most PIVOTS a length
    cells = {}
    for dim in centre:
        mine = sorted((r for r in found if r["dim"] == dim), key=lambda r: r["cell"])
        if mine:
            place = np.repeat(np.arange(len(mine)), [len(r["near"]) for r in mine])
            cells[dim] = (np.array([r["cell"] for r in mine], np.int32), np.array([r["radius"] for r in mine]), np.array([r["norm"] for r in mine]), place, np.concatenate([r["near"] for r in mine]))

    sizes = dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("v_blocks"))
    asked = dealt.where(is_query)
    going = written(visits(asked.where("cell >= 0"), centre, cells, k, GROUPS), "knn-queries")
    # per group and cell: queries, and what a row must reach to be sent
    met = going.select("dim", "g", "low", "size", F.explode(F.arrays_zip("cells", "dots")).alias("x")).groupBy("dim", "g", F.col("x.cells").alias("cell"))
    met = met.agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("q_blocks"), F.max("x.dots").alias("top"), F.min("low").alias("low"), F.max("size").alias("size"))
    met = F.broadcast(written(met.join(sizes, ["dim", "cell"]), "knn-meet"))  # at most LENGTHS * GROUPS * PIVOTS rows
    mine = going.select("dim", "g", "uid", "id", "v", F.explode("cells").alias("cell")).join(met.select("dim", "g", "cell", "q_blocks", "v_blocks"), ["dim", "g", "cell"])
    # of a cell only the rows that some query of the group may need
    reach = F.least(F.col("top") + F.col("size") * F.col("far"), F.col("size") * F.col("norm"))
    theirs = held.select("dim", "cell", "uid", "id", "v", "far", "norm").join(met, ["dim", "cell"]).where(reach >= F.col("low"))

    # rows without pivot meet all of their length: wide queries (or of rare lengths) every cell, other queries the cell -1
    every = sizes.select("dim", "cell", "v_blocks")
    ask = asked.select("dim", "uid", "id", "v", (F.col("cell") < 0).alias("odd"))
    asks = ask.groupBy("dim", "odd").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("q_blocks"))
    odd = every.join(asks, "dim").where("odd or cell < 0").withColumn("g", F.when(F.col("odd"), -2).otherwise(-1))
    often_dims = F.col("dim").isin([r["dim"] for r in often])
    for some, small in ((often_dims, True), (~often_dims, False)):  # lengths beyond the frequent ones: each holds a small share of all rows
        o = odd.where(some)
        o = F.broadcast(o) if small else o  # at most 2 * LENGTHS * (PIVOTS + 1) rows
        mine = mine.unionByName(ask.where(some).join(o, ["dim", "odd"]).select(*mine.columns))
        theirs = theirs.select("dim", "cell", "uid", "id", "v", "g", "q_blocks", "v_blocks").unionByName(dealt.where(some).select("dim", "cell", "uid", "id", "v").join(o, ["dim", "cell"]).select("dim", "cell", "uid", "id", "v", "g", "q_blocks", "v_blocks"))
    at = F.xxhash64("uid")
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    key = ["dim", "g", "cell", "q_block", "v_block"]
    mine = mine.withColumn("q_block", F.pmod(at, F.col("q_blocks"))).withColumn("v_block", blocks("v_blocks"))
    theirs = theirs.withColumn("v_block", F.pmod(at, F.col("v_blocks"))).withColumn("q_block", blocks("q_blocks"))
    return mine.select(*key, "uid", "id", "v"), theirs.select(*key, "uid", "id", "v")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
