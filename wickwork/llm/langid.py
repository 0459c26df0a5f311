"""Language identification with string kernels.

The kernel of two texts counts the character n-grams of 1 to 3 letters (a blended spectrum) that
both contain, divided by the root of the product of their own counts. Kernel ridge regression, one
language against the rest, is fitted over Nystroem landmarks: the model of a text is the row of
its kernel values with the landmarks, times a small matrix. Scoring is by batches: presence
rows of many windows of texts times the landmarks' presence matrix, times that matrix.

Texts are folded to letters (lower case; everything else is one blank); frequent letters of the
training sample have codes of their own, other letters share hashed ones. A text is cut into
windows of ``WINDOW`` characters, all of which are scored; a text's score for a language is the mean over
its windows, weighted by their letters.

Learning: at most ``PER_LANGUAGE`` rows of each language, ``SAMPLE`` in all but at least one of every language, chosen by a
hash of id and text among rows that may be learned from (a documented, bounded sample); of each, ``WINDOW`` characters that
begin somewhere in the whole text, folded to letters. Every language with a row to learn from is learned, whatever its
number of rows; repeated rows count once. The model grows with the number of languages alone. Prediction reads whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0; with nothing to learn
from, every text is ``und``; ties go to the language that sorts first; ids may be null (never held out) or
repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.common import HOT_PARTS, held_out, sliced, written

WINDOW, PER_LANGUAGE, SAMPLE = 2048, 400, 8000
#: Times the sample that is looked at per language.
OVER = 4
#: A score that no classifier's yes reaches, and letters that a text must have to be rejected by its score.
CLAIM, LETTERS = 0.5, 200
#: n-grams of the presence vectors, landmarks (at least one of every language), ridge.
FEATURES, LANDMARKS, RIDGE = 4096, 192, 1e-3
CODES = 64  # 0: no letter; 1 to 40: frequent letters; the rest: hashed
FREQUENT = 40


@cache
def letters() -> np.ndarray:
    """Per code point: is it a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@cache
def lowered() -> np.ndarray:
    """Per code point: its lower case, where that is one code point."""
    return np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)], dtype=np.uint32)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Model:
    """Letter codes, n-gram table and matrices; small (a few MB), of a size fixed by the parameters."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        seen = np.zeros(0x110000, np.int64)
        for t in texts:
            p = lowered()[points(t)]
            np.add.at(seen, p[letters()[p]], 1)
        top = [c for c in np.argsort(-seen, kind="stable")[:FREQUENT] if seen[c]]
        everything = np.arange(0x110000, dtype=np.uint64)
        code = np.where(letters(), FREQUENT + 1 + (everything * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(CODES - FREQUENT - 1), np.uint64(0)).astype(np.uint8)
        code[top] = np.arange(1, len(top) + 1)
        self.code = code[lowered()]
        self.table = np.zeros(CODES**3, np.int32)
        counts = np.zeros(CODES**3, np.int64)
        for t in texts:
            counts[np.unique(self.grams(self.code[points(t)]))] += 1
        best = np.argsort(-counts, kind="stable")[:FEATURES]
        best = best[counts[best] > 0]
        self.table[best] = np.arange(1, len(best) + 1)  # 0: not a feature
        self.width = len(best) + 1
        x = self.presence([self.code[points(t)] for t in texts])
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        # landmarks: in turn from each language, in the sample's order
        turn = np.lexsort((np.arange(len(langs)), self._turn(langs)))[: max(LANDMARKS, len(self.langs))]
        self.marks = np.ascontiguousarray(x[turn].T)
        self.mark_norm = np.sqrt(np.maximum(x[turn].sum(1), 1))
        k = self.kernel(x)
        kmm = k[turn]
        value, vector = np.linalg.eigh((kmm + kmm.T) / 2)
        good = value > 1e-6 * value.max()
        half = vector[:, good] / np.sqrt(value[good])
        phi = k @ half
        weight = np.linalg.solve(phi.T @ phi + RIDGE * len(x) * np.eye(phi.shape[1]), phi.T @ y)
        self.matrix = (half @ weight).astype(np.float32)

    @staticmethod
    def _turn(langs: list[str]) -> np.ndarray:
        count: dict[str, int] = {}
        return np.array([count.setdefault(c, 0) + (count.update({c: count[c] + 1}) or 0) for c in langs])

    @staticmethod
    def grams(code: np.ndarray) -> np.ndarray:
        """Codes of the n-grams of 1 to 3; blanks are part of an n-gram, runs of blanks are one."""
        c = np.r_[np.uint8(0), code, np.uint8(0)].astype(np.int32)
        c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
        return np.concatenate([c, c[:-1] * CODES + c[1:], (c[:-2] * CODES + c[1:-1]) * CODES + c[2:]])

    def presence(self, windows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(windows), self.width), np.float32)
        for row, w in zip(x, windows, strict=True):
            row[self.table[self.grams(w)]] = 1
        x[:, 0] = 0
        return x

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.marks) / self.mark_norm / np.sqrt(np.maximum(x.sum(1), 1))[:, None]

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(language number or -1, score) per text."""
        total, weight = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        windows, owner = [], []

        def flush() -> None:
            if windows:
                s = self.kernel(self.presence(windows)).astype(np.float32) @ self.matrix
                n = np.array([np.count_nonzero(w) for w in windows], float)
                np.add.at(total, owner, s * n[:, None])
                np.add.at(weight, owner, n)
                windows.clear()
                owner.clear()

        for i, t in enumerate(texts):
            if t:
                for a in range(0, len(t), WINDOW):
                    w = self.code[points(t[a : a + WINDOW])]
                    if w.any():
                        windows.append(w)
                        owner.append(i)
                        if len(windows) >= 256:
                            flush()
        flush()
        mean = total / np.maximum(weight, 1)[:, None]
        best = mean.argmax(1)
        score = np.clip((mean[np.arange(len(texts)), best] + 1) / 2, 0, 1)
        return np.where(weight > 0, best, -1), np.where(weight > 0, score, 0.0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits on the bounded sample; ``None`` if there is nothing to learn from."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    # the hash takes the text in, so that rows of one id are told apart
    hashed = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40))
    rows = rows.select(hashed.alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    # a share of each language's rows by hash, about OVER times what is needed, and its row of smallest hash: no task gathers a whole language
    shares = rows.groupBy("l").agg(F.count(F.lit(1)).alias("c"), F.min("h").alias("low")).withColumnRenamed("l", "w_l")
    shares = written(shares, "languages")
    shares = F.broadcast(shares) if shares.count() <= HOT_PARTS else shares  # one row per language
    some = F.least(F.lit(1.0), F.lit(float(OVER * PER_LANGUAGE)) / F.col("c")) * float(1 << 40)
    rows = rows.join(shares, F.col("l") == F.col("w_l")).where((F.col("h") <= some) | (F.col("h") == F.col("low")))
    letters_only = F.trim(F.regexp_replace("t", "[^\\p{L}]+", " "))
    rows = rows.select("l", "h", letters_only.alias("t")).withColumn("w_at", F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("t") - WINDOW + 1)).cast("int") + 1)
    rows = rows.select("l", "h", F.expr(f"substring(t, w_at, {WINDOW})").alias("t")).dropDuplicates(["l", "h"])
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("n") <= PER_LANGUAGE)
    ranked = rows.orderBy("n", "h", "l", "t")
    sample = ranked.limit(SAMPLE).collect()
    if len(sample) == SAMPLE and sample[-1]["n"] == 1:  # more languages than rows: the first of each
        sample = rows.where("n = 1").orderBy("h", "l", "t").collect()
    return Model([r["t"] for r in sample], [r["l"] for r in sample]) if sample else None


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """Per row: id, ``held_out``, ``lang_pred`` and ``score``."""
    rows = docs.select(docs[id_col].alias("id"), held_out(id_col).alias("held_out"), docs[text_col].alias("text"))
    return _predict(rows, model or train(docs, id_col, text_col, lang_col)).withColumnRenamed("id", id_col)


def _predict(rows: DataFrame, model: Model | None) -> DataFrame:
    """Replaces the last column, a text, by ``lang_pred`` and ``score``."""
    before = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            t = batch.column(len(before)).to_pylist()
            best, score = model.scores(t) if model else (np.full(len(t), -1), np.zeros(len(t)))
            pred = pa.array([model.langs[b] if b >= 0 else "und" for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pred, pa.array(score, pa.float64())], names=[*(f.name for f in before), "lang_pred", "score"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in before), "lang_pred string, score double"]))


def accepted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", wanted: tuple[str, ...] | None = None, min_score: float = CLAIM, min_letters: int = LETTERS, model: Model | None = None
) -> DataFrame:
    """The rows of ``docs`` whose language is told and wanted.

    Rejected are texts without any letter; texts whose predicted language is not among ``wanted`` (None: all that are learned); and texts of ``min_letters`` letters or more
    that no classifier claims: the best score is ``min_score`` or less, so that even its language speaks rather against it (another language or script, a word said over and over).
    A shorter text is too short to be judged by its score and stays. Where no row can be learned from, the rows with letters stay, unless languages are ``wanted``.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    if model is None:
        return docs.where(docs[text_col].rlike("\\p{L}") & F.lit(wanted is None))
    letters_of = F.length(F.regexp_replace(docs[text_col], "[^\\p{L}]+", ""))
    rows = docs.select(F.struct("*").alias("w_row"), letters_of.alias("w_letters"), docs[text_col].alias("w_text"))
    told = F.col("lang_pred") != "und"
    if wanted is not None:
        told &= F.col("lang_pred").isin(*wanted)
    return _predict(rows, model).where(told & ((F.col("w_letters") < min_letters) | (F.col("score") > min_score))).select("w_row.*")
