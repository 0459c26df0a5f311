"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (``FEATURES``) come from its bytes and word hashes, many texts at a
time. Trees are grown level by level on binned statistics in numpy; the trained ones are complete
binary trees flattened into arrays (feature, threshold, leaf value), so that a batch of documents
walks all trees by array indexing.

Learning: at most ``SAMPLE`` labelled rows that may be learned from, chosen by a hash of the id and, where ids repeat, of the
text (a documented, bounded sample; the labels table decides which rows have one). Labels, language, source
and id are never inputs of a score. Scoring reads whole texts.

Defined results: null and empty texts are scored like any other (their statistics are 0); with
nothing to learn from every score is 0.5; null labels are not learned from; a document with several
labels is learned from with each; ids may be null (never held out) or repeat; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm import words
from wickwork.llm.common import hash_sample, held_out, sliced, texts

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 64, 0.15, 1.0, 20
FEATURES = (
    "log bytes", "log words", "bytes a word", "upper", "lower", "digits", "space", "line feeds", "full stops and commas", "exclamation and question marks",
    "other signs", "beyond ASCII", "distinct words", "distinct lines", "distinct three-word runs", "distinct eight-word runs", "commonest word",
    "one-letter words", "sign runs", "bytes a line", "capital words", "words with signs inside",
)

_kind = np.zeros(256, np.uint8)  # 0 control, 1 upper, 2 lower, 3 digit, 4 space, 5 line feed, 6 .,;: 7 !? 8 other signs, 9 beyond ASCII
_kind[33:127] = 8
_kind[65:91], _kind[97:123], _kind[48:58], _kind[[32, 9, 13]], _kind[10], _kind[128:] = 1, 2, 3, 4, 5, 9
_kind[[46, 44, 59, 58]], _kind[[33, 63]] = 6, 7


def _distinct(x: np.ndarray) -> float:
    return len(np.unique(x)) / len(x) if len(x) else 0.0


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for i, j, word, bounds in words.hashes(data, offsets):
        for d in range(i, j):
            n = int(offsets[d + 1] - offsets[d])
            if n == 0:
                continue
            text = data[offsets[d] : offsets[d + 1]]
            kinds = _kind[text]
            share = np.bincount(kinds, minlength=10) / n
            w = word[bounds[d - i] : bounds[d - i + 1]]
            m = max(1, len(w))
            sign = (kinds >= 6) & (kinds <= 8)
            line = np.flatnonzero(text == 10)
            ends = np.r_[line, n]
            starts = np.r_[0, line + 1]
            # lines by the words they hold: a sum per line, in words' order
            sums = np.r_[np.uint64(0), np.cumsum(text.astype(np.uint64) * (np.arange(n, dtype=np.uint64) % np.uint64(31) + np.uint64(7)))]
            lines = (sums[ends] - sums[starts]) + (ends - starts).astype(np.uint64) * np.uint64(1 << 40)
            space = (kinds == 4) | (kinds == 5)
            begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
            finish = np.flatnonzero(~space & np.r_[space[1:], True])
            counts = np.unique(w, return_counts=True)[1] if len(w) else np.zeros(1)
            run = sign[1:] & sign[:-1]
            out[d] = (
                np.log1p(n), np.log1p(len(w)), n / m, share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8], share[9],
                len(counts) / m, _distinct(lines), _distinct(_runs(w, 3)), _distinct(_runs(w, 8)), counts.max() / m,
                np.count_nonzero(begins == finish) / m, np.count_nonzero(run) / n, n / len(ends), np.count_nonzero(kinds[begins] == 1) / m if len(begins) else 0.0,
                np.count_nonzero(sign[1:-1] & ~space[:-2] & ~space[2:]) / m,
            )
    return out


def _runs(w: np.ndarray, k: int) -> np.ndarray:
    if len(w) < k:
        return w[:0]
    h = w[: len(w) - k + 1].copy()
    for t in range(1, k):
        h = words.mix(h + w[t : len(w) - k + 1 + t])
    return h


class Trees:
    """Boosted complete trees of fixed depth: node n has children 2n + 1 and 2n + 2; x <= threshold goes left."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = 0.0
        self.feature = np.zeros((0, 2**DEPTH - 1), np.int32)
        self.threshold = np.zeros((0, 2**DEPTH - 1))
        self.value = np.zeros((0, 2**DEPTH))
        if len(y) == 0:
            return
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)])  # bin b: x <= cuts[b]
        f = np.full(len(y), self.base)
        features, thresholds, values = [], [], []
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-f))
            feature, threshold, value, leaf = self._grow(bins, cuts, q - y, q * (1 - q))
            f += value[leaf]
            features.append(feature)
            thresholds.append(threshold)
            values.append(value)
        self.feature, self.threshold, self.value = np.array(features, np.int32), np.array(thresholds), np.array(values)

    @staticmethod
    def _grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray):
        feature, threshold = np.zeros(2**DEPTH - 1, np.int32), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(bins.shape[1], np.int64)  # within the level
        for level in range(DEPTH):
            n = 2**level
            best = [(1e-6, 0, -1)] * n
            for k, b in enumerate(bins):
                if not len(cuts[k]):
                    continue
                cell = node * BINS + b
                sums = [np.bincount(cell, w, n * BINS).reshape(n, BINS).cumsum(1) for w in (g, h, None)]
                gl, hl, cl = sums
                gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(cl < LEAST) | (ct - cl < LEAST)] = 0
                gain[:, len(cuts[k]) :] = 0
                at = gain.argmax(1)
                for i in range(n):
                    if gain[i, at[i]] > best[i][0]:
                        best[i] = (gain[i, at[i]], k, int(at[i]))
            right = np.zeros(len(node), bool)
            for i, (_, k, c) in enumerate(best):
                if c >= 0:
                    feature[n - 1 + i], threshold[n - 1 + i] = k, cuts[k][c]
                    right |= (node == i) & (bins[k] > c)
            node = node * 2 + right
        gs, hs = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
        return feature, threshold, -RATE * gs / (hs + RIDGE), node

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row: all rows walk all trees together."""
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        f = self.base + self.value[tree, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-f))


def _measured(rows: DataFrame, of) -> DataFrame:
    """``rows`` with their last column, a text, replaced by ``of(statistics)``."""
    before = rows.schema.fields[:-1]
    name, kind, make = of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], make(statistics(*texts(batch, "w_text")))], names=[*(f.name for f in before), name])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in before), f"{name} {kind}"]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    chosen = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("w_id"), F.col(label_col).alias("w_label"))
    spark = docs.sparkSession
    found = hash_sample(chosen.select("w_id", "w_label", F.xxhash64("w_id").alias("h")), sample, "h", labels.count())
    chosen = spark.createDataFrame([(r["w_id"], r["w_label"]) for r in found], chosen.schema)
    rows = docs.select(F.col(id_col).alias("w_doc"), F.col(text_col).alias("w_text")).join(F.broadcast(chosen), F.col("w_doc") == F.col("w_id"))
    # ids may repeat: of the labelled rows again a sample by hash, so that the driver gets ``sample`` rows of statistics at most
    rows = rows.select("w_id", "w_label", F.pmod(F.xxhash64("w_id", "w_label", "w_text"), F.lit(1 << 30)).alias("h"), "w_text")
    share, total = 1.0, rows.count()
    if total > sample:
        share = min(1.0, 2 * sample / total)
    as_list = ("x", "array<double>", lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())))
    got = _measured(rows.where(F.col("h") <= share * (1 << 30)), as_list)
    got = got.orderBy("h", "w_id", "w_label").limit(sample).collect() if total > sample else got.collect()
    got.sort(key=lambda r: (r["w_id"], r["w_label"], r["x"]))
    return Trees(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["w_label"] for r in got], float))


def score(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None, threshold: float = 0.7) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` and ``predicted``."""
    model = model or train(docs, labels, id_col, text_col)
    rows = docs.select(docs[id_col].alias("id"), held_out(id_col).alias("held_out"), docs[text_col].alias("w_text"))
    out = _measured(rows, ("score", "double", lambda x: pa.array(model.score(x), pa.float64())))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)
