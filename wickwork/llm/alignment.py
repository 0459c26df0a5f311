"""Cross-tokenizer alignment with exact-text deduplication.

Texts are shuffled by their full text, each distinct one is encoded by both tokenizers and aligned once, pair counts are weighted by the number of copies, and the
measures go back to the documents by a digest of the text.

Cuts: a single space between two characters that are no white space begins a token in both files (the byte-level pattern takes
it with the word behind it, and no piece of the other file has a space after anything else, which is checked when it is loaded). So the
token groups of a text are those of its words in order, and a worker keeps what it has made of words (``CACHE_WORDS`` at most).

Counts for links: a task gathers about ``BLOCK_BYTES`` of texts into a block and writes one row for it: its texts, the words of each text as numbers within the block, the
distinct pairs of the block's words, and the pairs' weights. Pairs are counted over all blocks; a block asks once for each of its distinct pairs, so that even the commonest
pair has no more rows than there are blocks, and then adds up its texts' measures with numpy. Each block is bounded by its bytes (or holds one longer text).

Defined results: null and empty texts, and texts whose tokens do not give back a space and the text, have no tokens: zeros and an empty
``groups_sha256``, and no part in the counts; repeated texts count as often as they occur; ids may be null or repeat; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import hot_join, written

#: Bytes of texts in a block, of words in one encoder call, words that a worker keeps.
BLOCK_BYTES, CALL_BYTES, CACHE_WORDS = 1 << 21, 1 << 18, 300_000
CUT = re.compile(r" (?=\S)(?<=\S )")
#: Byte-level vocabularies write printable bytes as themselves and the others as 256 + their rank.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}


class Files:
    """Both encoders, with the bytes of every token."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        if a_path is None or b_path is None:
            import public_tokenizers

            a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(_BYTE[c] for c in names.get(i, "") if c in _BYTE) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece with a space inside: texts cannot be cut at spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a space and the text by both files, None where their bytes differ from it."""
        raw = (" " + text).encode()
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        return a, b


class Words:
    """What is known of words (a space before each): numbers of tokens and groups, the groups as text, the linked pairs."""

    def __init__(self, files: Files):
        self.files = files
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.zeros((4, 1024), np.int64)  # tokens of a, of b, groups (-1: the word gives no tokens), first link
        self.pairs, self.n_pairs = np.zeros(4096, np.int64), 0

    def learn(self, words: list[str]) -> None:
        batch, held = [], 0
        for w in words:
            if w[0].isspace() or w[-1].isspace():
                self._learn([w])
                continue
            batch.append(w)
            held += len(w)
            if held >= CALL_BYTES:
                self._learn(batch)
                batch, held = [], 0
        if batch:
            self._learn(batch)

    def _learn(self, words: list[str]) -> None:
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        found = self.files.encode(" ".join(words))
        if found is None:
            if len(words) == 1:
                self._add(words[0], "", 0, 0, -1, self.pairs[:0])
            else:  # one of them gives other bytes
                self._learn(words[: len(words) // 2])
                self._learn(words[len(words) // 2 :])
            return
        a, b = np.array(found[0]), np.array(found[1])
        a_end, b_end = np.cumsum(self.files.a_size[a]), np.cumsum(self.files.b_size[b])
        both = np.intersect1d(a_end, b_end)
        at_a, at_b = (np.searchsorted(e, both, "right") for e in (a_end, b_end))
        pairs = a[at_a - 1] * len(self.files.b_bytes) + b[at_b - 1]
        a_text, b_text = list(map(str, found[0])), list(map(str, found[1]))
        groups, i, j = [], 0, 0
        for p, q in zip(at_a.tolist(), at_b.tolist(), strict=True):
            groups.append(f"{a_text[i] if p == i + 1 else ','.join(a_text[i:p])}|{b_text[j] if q == j + 1 else ','.join(b_text[j:q])}")
            i, j = p, q
        n_a, n_b, n_g = (np.searchsorted(e, ends, "right") for e in (a_end, b_end, both))
        before = (0, 0, 0)
        for w, x, y, g in zip(words, n_a.tolist(), n_b.tolist(), n_g.tolist(), strict=True):
            self._add(w, ";".join(groups[before[2] : g]), x - before[0], y - before[1], g - before[2], pairs[before[2] : g])
            before = (x, y, g)

    def _add(self, word: str, groups: str, n_a: int, n_b: int, n_groups: int, pairs: np.ndarray) -> None:
        k, n = len(self.groups), self.n_pairs
        if k == self.numbers.shape[1]:
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)], 1)
        while n + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.known[word] = k
        self.groups.append(groups)
        self.numbers[:, k] = n_a, n_b, n_groups, n
        self.pairs[n : n + len(pairs)] = pairs
        self.n_pairs = n + len(pairs)


def _within(sums: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sums of runs that end before ``ends``."""
    total = np.concatenate([[0], np.cumsum(sums, dtype=np.int64)])[np.concatenate([[0], ends])]
    return total[1:] - total[:-1]


TEXT = pa.struct([("sha", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_words", pa.int64()), ("groups_sha256", pa.string())])
BLOCK = "block long, texts array<struct<sha:string,n_a:long,n_b:long,n_groups:long,n_words:long,groups_sha256:string>>, words binary, links binary, pair_of binary, pairs array<long>, weights array<long>"


def block(words: Words, number: int, shas: list[str], texts: list[str], copies: list[int]) -> pa.RecordBatch:
    """The row of a block of distinct texts."""
    split = [CUT.split(t) for t in texts]
    if len(words.known) > CACHE_WORDS:
        words.clear()
    words.learn(list(set().union(*split).difference(words.known)))
    n_words = np.array(list(map(len, split)))
    ids = np.fromiter(map(words.known.__getitem__, chain.from_iterable(split)), np.int64, n_words.sum())
    ends = np.cumsum(n_words)
    n_a, n_b, n_groups, first = words.numbers
    good = _within(n_groups[ids] < 0, ends) == 0
    used = np.flatnonzero(np.bincount(ids, minlength=len(words.groups)))
    place = np.zeros(len(words.groups), np.uint32)
    place[used] = np.arange(len(used), dtype=np.uint32)
    links = np.maximum(n_groups[used], 0)
    starts = np.repeat(first[used] - np.concatenate([[0], np.cumsum(links)[:-1]]), links)
    pairs, pair_of = np.unique(words.pairs[starts + np.arange(links.sum())], return_inverse=True)
    # 64-bit sums of weights, not floats
    order = np.argsort(ids, kind="stable")
    weight = np.repeat(np.where(good, np.array(copies, np.int64), 0), n_words)[order]
    per_word = _within(weight, np.cumsum(np.bincount(ids, minlength=len(words.groups))[used]))
    weights = np.zeros(len(pairs), np.int64)
    np.add.at(weights, pair_of, np.repeat(per_word, links))
    shown, at = [], 0
    for n, ok in zip(n_words.tolist(), good.tolist(), strict=True):
        shown.append(hashlib.sha256(";".join([words.groups[i] for i in ids[at : at + n].tolist()]).encode()).hexdigest() if ok else "")
        at += n
    sums = [np.where(good, _within(x[ids], ends), 0) for x in (n_a, n_b, n_groups)]
    of_text = pa.StructArray.from_arrays([pa.array(shas, pa.string()), *[pa.array(s) for s in sums], pa.array(np.where(good, n_words, -n_words)), pa.array(shown, pa.string())], fields=list(TEXT))
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    raw = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    columns = [pa.array([number], pa.int64()), one(of_text), raw(place[ids], np.uint32), raw(links, np.uint32), raw(pair_of, np.uint32), one(pa.array(pairs, pa.int64())), one(pa.array(weights, pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["block", "texts", "words", "links", "pair_of", "pairs", "weights"])


def blocks(distinct: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``distinct`` (sha, text, copies) as rows of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = Words(Files(a_path, b_path)), TaskContext.get().partitionId() << 32
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for kept, v in zip(held, row, strict=True):
                    kept.append(v)
                size += len(row[1])
                if size >= BLOCK_BYTES:
                    yield block(words, number, *held)
                    held, size, number = ([], [], []), 0, number + 1
        if held[0]:
            yield block(words, number, *held)

    return distinct.select("sha", "text", "copies").mapInArrow(run, BLOCK)


def _measured(rows: DataFrame) -> DataFrame:
    """Per text of the blocks its measures; ``found``: count and best of the block's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                texts, words, links, pair_of = (batch.column(c)[k] for c in range(4))
                found = batch.column(4)[k].values
                at = found.field(0).to_numpy(zero_copy_only=False)
                n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                n[at], best[at] = found.field(1).to_numpy(zero_copy_only=False), found.field(2).to_numpy(zero_copy_only=False)
                words, links, pair_of = (np.frombuffer(x.as_py(), np.uint32) for x in (words, links, pair_of))
                t = texts.values
                n_words = t.field("n_words").to_numpy()
                ends, link_ends = np.cumsum(np.abs(n_words)), np.cumsum(links, dtype=np.int64)
                sums = [np.where(n_words > 0, _within(_within(x[pair_of], link_ends)[words], ends), 0) for x in (best, n)]
                columns = [t.field(c) for c in ("sha", "n_a", "n_b", "n_groups")] + [t.field("n_groups"), *map(pa.array, sums), t.field("groups_sha256")]
                yield pa.RecordBatch.from_arrays(columns, names=["sha", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.select("texts", "words", "links", "pair_of", "found").mapInArrow(run, "sha string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(table: DataFrame, b_size: int) -> DataFrame:
    """Of the written blocks: pair (a * b_size + b), n, and whether no other pair of its b is more frequent."""
    pairs = table.select(F.explode(F.arrays_zip("pairs", "weights")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.weights").alias("n")).where("n > 0")
    pairs = written(pairs, "alignment-pairs")
    most = pairs.groupBy((F.col("pair") % b_size).cast("int").alias("b")).agg(F.max("n").alias("most"))
    # one row per id of the smaller vocabulary: a proven bound
    return pairs.withColumn("b", (F.col("pair") % b_size).cast("int")).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per row: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    distinct = docs.select(text.alias("text")).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    table = written(blocks(distinct.select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text", "copies"), a_path, b_path), "alignment-blocks")
    counts = pair_counts(table, Files(a_path, b_path).b.get_piece_size())
    asked = table.select("block", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair", "left")
    # a block's pairs, as many as it has distinct ones
    found = asked.groupBy("block").agg(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("best", F.lit(False)).cast("int").alias("best"))).alias("found"))
    none = F.array().cast("array<struct<at:int,n:long,best:int>>")
    rows = table.select("block", "texts", "words", "links", "pair_of").join(found, "block", "left").withColumn("found", F.coalesce("found", none))
    measures = _measured(rows)
    ids = docs.select(F.col(id_col).alias("w_id"), F.sha2(text.cast("binary"), 256).alias("sha"))
    out = hot_join(ids, measures, ["sha"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return out.select(F.col("w_id").alias(id_col), *[zero(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
