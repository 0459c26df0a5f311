"""N-gram Jaccard join: token-combination prefixes, then verification; links are returned as components.

A document's tokens are its distinct shingles (``k`` words, A-Z lowered). Two documents link when
``100 * intersection >= percent * union``.

* Equal sets are one node, named by their smallest id.
* Tokens have one global order, rarest first, by counts over all documents (a table of fixed size).
  A document of n tokens can lack ``e = n - ceil(percent * n / 100)`` tokens of a partner. Frequent tokens
  fall into a few classes; the prefix is extended until ``rare + sum(max(0, tokens of a class - 1)) > e``. Then
  linked documents share a rare token or two tokens of one class in their prefixes, so rare tokens are indexed
  alone and frequent ones as pairs within their class.
* Candidates are all pairs of an index bucket of up to ``SMALL`` members, and in a larger bucket its members with the
  smallest one. Those that pass the size bound and a lower bound of the symmetric difference (the Hamming distance of
  parity sketches) are verified, and links are contracted to components. Only large buckets that still hold
  several components are compared further: in blocks of ``BLOCK`` members per task, pairs across components that
  pass the same bounds are verified. No link that could join two components is skipped, so components are exact, and
  no large bucket's pairs are all made.
* Verification compares whole sets, computed anew from the whole texts; the texts of nodes in shared buckets
  are gathered once. Groups of a bucket leader are dealt in chunks of ``CHUNK`` partners.

Tokens are 64-bit hashes of shingles, also in verification, which compares sets of hashes and not words; node keys are 128-bit
digests (two sums of mixed hashes) of sets, and sets of equal size and digest are taken as equal without a comparison.

Defined results: null or empty texts, or texts without words, have no shingles and link with nothing (their
component is their own id); rows with a null id link with nothing and have a null component; rows of
one id are one node; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm import words
from wickwork.llm.common import hot_join, hot_keys, sliced, texts, written
from wickwork.llm.components import components

#: log2 of the cells of the count table, count beyond which a token is frequent (also at least 4 x the mean), most classes.
BITS, FREQUENT, CLASSES = 22, 1000, 8
#: Partners verified with one leader in a task, members of a small bucket, of a block of a larger one, 64-bit words of a sketch.
CHUNK, SMALL, BLOCK, SKETCH = 128, 24, 2048, 16


def slack(n, percent: int):
    """Tokens that a partner may lack."""
    return n - -(-percent * n // 100)


def classes(percent: int) -> int:
    """The most classes (up to CLASSES) for which every set that can link with another has a sufficient prefix."""
    n = np.arange(1, 2000)
    can = (100 * n // percent > n) | (slack(n, percent) > 0)
    return int(max(1, min(CLASSES, (n - slack(n, percent) - 1)[can].min())))


def document_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    for i, j, word, bounds in words.hashes(data, offsets):
        for d in range(j - i):
            yield words.shingles(word[bounds[d] : bounds[d + 1]], k)


def token_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Documents per cell of hashed tokens, over all rows: 2**BITS sums, added up in two stages by cell block."""
    blocks, width = 64, 2**BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**BITS, np.int64)
        for batch in sliced(batches):
            sets = list(document_sets(*texts(batch, "t"), k))
            if sets:
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - BITS)).astype(np.int64), minlength=2**BITS)
        part = TaskContext.get().partitionId() % 64
        if total.any():
            for b, r in enumerate(total.reshape(blocks, width)):
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "part": pa.array([part], pa.int32()), "sums": pa.array([_packed(r)], pa.binary())})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for b in rows["sums"]:
            total += _unpacked(b)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "part": rows["part"].iloc[:1], "sums": [_packed(total)]})

    schema = "block int, part int, sums binary"
    sums = docs.mapInArrow(run, schema).groupBy("block", "part").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema).collect()
    out = np.zeros((blocks, width), np.int64)
    for r in sums:
        out[r["block"]] = _unpacked(r["sums"])
    return out.ravel()


def _packed(sums: np.ndarray) -> bytes:
    """Sums in as few bytes each as the largest needs, that number first; where most are 0, the others' places and sums (first number 0)."""
    kind, some = np.min_scalar_type(int(sums.max())), np.flatnonzero(sums)
    if len(some) * (4 + kind.itemsize) < len(sums) * kind.itemsize:
        return bytes([0, kind.itemsize]) + np.r_[len(sums), some].astype(np.uint32).tobytes() + sums[some].astype(kind).tobytes()
    return bytes([kind.itemsize]) + sums.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    if raw[0]:
        return np.frombuffer(raw, np.dtype(f"u{raw[0]}"), offset=1).astype(np.int64)
    n = (len(raw) - 6) // (4 + raw[1])
    places = np.frombuffer(raw[2 : 6 + 4 * n], np.uint32)
    out = np.zeros(places[0], np.int64)
    out[places[1:]] = np.frombuffer(raw[6 + 4 * n :], np.dtype(f"u{raw[1]}"))
    return out


def signatures(tokens: np.ndarray, count: np.ndarray, percent: int, frequent: float, n_classes: int) -> np.ndarray:
    """Index entries of one set: its prefix's rare tokens, and pairs of frequent ones of a class."""
    n = len(tokens)
    e = slack(n, percent)
    if n == 0 or (100 * n // percent == n and e == 0):  # links with equal sets alone
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, count))
    tokens, common = tokens[order], count[order] > frequent
    rare = n - np.count_nonzero(common)
    if rare > e:
        return words.mix(tokens[: e + 1] + np.uint64(1))
    common_tokens = tokens[rare:]  # the order is by count
    kind = (words.mix(common_tokens) % np.uint64(n_classes)).astype(np.int64)
    by = np.argsort(kind, kind="stable")
    first = np.zeros(len(kind), bool)
    first[by[np.r_[True, kind[by][1:] != kind[by][:-1]]]] = True
    enough = int(np.searchsorted(rare + np.cumsum(~first), e + 1)) + 1
    common_tokens, kind = common_tokens[:enough], kind[:enough]
    out = [words.mix(tokens[:rare] + np.uint64(1))]
    for c in np.unique(kind):
        t = np.sort(common_tokens[kind == c])
        i, j = np.triu_indices(len(t), 1)
        out.append(words.mix(words.mix(t[i]) + t[j]))
    return np.concatenate(out)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens per bit: two sets differ in at least as many tokens as their sketches in bits."""
    bit = np.bincount((words.mix(tokens) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bit.astype(np.uint8)).view(np.int64)


def index(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n, k1, k2, sigs, bits) per row; docs: (id, t)."""
    counts = token_counts(docs.select("t"), k)
    frequent, n_classes = max(FREQUENT, 4 * counts.sum() / len(counts)), classes(percent)
    table = docs.sparkSession.sparkContext.broadcast(counts.astype(np.float32))  # 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, k1, k2, sigs, bits = [], [], [], [], []
            for s in document_sets(*texts(batch, "t"), k):
                n.append(len(s))
                k1.append(int(words.mix(s).sum().view(np.int64)) if len(s) else 0)
                k2.append(int(words.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)) if len(s) else 0)
                bits.append(sketch(s))
                sigs.append(np.unique(signatures(s, table.value[(s >> np.uint64(64 - BITS)).astype(np.int64)], percent, frequent, n_classes)).view(np.int64))
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in sigs])].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), lists, pa.array(bits, pa.list_(pa.int64()))], names=["id", "n", "k1", "k2", "sigs", "bits"])

    return docs.select("id", "t").mapInArrow(run, "id long, n long, k1 long, k2 long, sigs array<long>, bits array<long>")


def verify(pairs: DataFrame, held: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that link; ``held``: (id, t) of all their nodes."""
    size = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    dealt = hot_join(pairs, size, ["a"]).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / CHUNK)).alias("chunk"))
    roles = dealt.select(F.col("b").alias("id"), "a", "chunk").union(dealt.select(F.col("a").alias("id"), "a", "chunk").distinct())

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        raw = [t.encode() for t in rows["t"]]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
        a = rows["a"].iloc[0]
        sets = list(zip(rows["id"], document_sets(data, offsets, k), strict=True))
        own = [s for i, s in sets if i == a]
        found = set()
        for b, s in sets:
            if b != a and b not in found:
                for o in own:
                    if 100 * min(len(s), len(o)) >= percent * max(len(s), len(o)):
                        both = len(np.intersect1d(o, s, assume_unique=True))
                        if 100 * both >= percent * (len(o) + len(s) - both):
                            found.add(b)
        return pd.DataFrame({"a": np.full(len(found), a, np.int64), "b": np.array(sorted(found), np.int64)})

    return roles.join(held, "id").groupBy("a", "chunk").applyInPandas(compare, "a long, b long")


def _block_pairs(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs across components of two blocks of a bucket that the bounds leave."""
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]
    left, right = rows[rows["block"] == i], rows[rows["block"] == j]
    bits = [np.stack(list(x["bits"])).view(np.uint64) for x in (left, right)]
    (na, nb), (la, lb), (ia, ib) = ([x[c].to_numpy() for x in (left, right)] for c in ("n", "label", "node"))
    out_a, out_b = [], []
    for r in range(len(left)):
        total = na[r] + nb
        ok = (lb != la[r]) & (100 * np.minimum(na[r], nb) >= percent * np.maximum(na[r], nb))
        if i == j:
            ok &= ib > ia[r]
        ok = np.flatnonzero(ok)
        if len(ok):
            far = np.bitwise_count(bits[1][ok] ^ bits[0][r]).sum(1, dtype=np.int64)
            ok = ok[far * (100 + percent) <= total[ok] * (100 - percent)]
            out_a.append(np.minimum(ib[ok], ia[r]))
            out_b.append(np.maximum(ib[ok], ia[r]))
    z = np.zeros(0, np.int64)
    return pd.DataFrame({"a": np.concatenate([z, *out_a]), "b": np.concatenate([z, *out_b])})


def plausible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link; marks: (node, n, bits)."""
    x = pairs.join(marks.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
    x = x.join(marks.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")
    far = F.expr(" + ".join(f"bit_count(bits_a[{i}] ^ bits_b[{i}])" for i in range(SKETCH)))
    size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return x.where(size & (far * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))).select("a", "b")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``."""
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("t"))
    rows = written(index(plain, k, percent), "ngram-index")
    key = ["n", "k1", "k2"]
    named = rows.where("n > 0 and id is not null").select("id", *key)
    nodes = written(named.groupBy(*key).agg(F.min("id").alias("node")), "ngram-nodes")
    firsts = rows.where("size(sigs) > 0").join(nodes.withColumnRenamed("node", "id"), [*key, "id"], "left_semi").dropDuplicates(["id", *key]).select(F.col("id").alias("node"), "n", "sigs", "bits")
    firsts = written(firsts, "ngram-firsts")
    entries = firsts.select(F.explode("sigs").alias("sig"), "node", "n")
    buckets = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("lead"))
    buckets = written(buckets.where("members > 1"), "ngram-buckets")
    hot = hot_keys(buckets.select("sig", F.col("members").alias("w_rows")), ["sig"])
    members = written(hot_join(entries, buckets, ["sig"], hot=hot, known=True), "ngram-members")
    marks = firsts.select("node", "n", "bits").dropDuplicates(["node"])
    few = members.where(f"members <= {SMALL}").select("sig", "node", "n")
    one, two = few.select("sig", F.col("node").alias("a"), F.col("n").alias("n_a")), few.select("sig", F.col("node").alias("b"), F.col("n").alias("n_b"))
    size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = one.join(two, "sig").where((F.col("a") < F.col("b")) & size).select("a", "b")
    star = members.where(f"members > {SMALL} and node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    pairs = written(plausible(pairs.union(star).distinct(), marks, percent), "ngram-pairs")
    large = members.where(f"members > {SMALL}")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.select("node")).distinct()
    held = written(plain.join(wanted, "id"), "ngram-texts")
    # rows of one id are one node, whatever their sets
    same = named.join(nodes, key).groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
    links = written(verify(pairs, held, k, percent).union(same), "ngram-links")
    labels = components(links)

    # what is left: large buckets in several components
    placed = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("sig", "node", "n", "members", "label")
    state = placed.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.max("members").alias("m"))
    state = state.where("low <> high").groupBy("m", "who").agg(F.min("sig").alias("sig")).select("sig")  # one of the buckets with equal members
    open_ = placed.join(state, "sig", "left_semi").join(marks.select("node", "bits"), "node")
    # A bucket's largest component has blocks of its own, which meet only blocks of other components.
    sizes = open_.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("sig").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("main_c"), F.sum("c").alias("all_c"))
    open_ = open_.join(sizes, "sig").withColumn("main_b", F.ceil(F.col("main_c") / BLOCK)).withColumn("rest_b", F.ceil((F.col("all_c") - F.col("main_c")) / BLOCK))
    in_main, hashed = F.col("label") == F.col("main"), F.xxhash64("node")
    open_ = open_.withColumn("block", F.when(in_main, F.pmod(hashed, F.col("main_b"))).otherwise(F.col("main_b") + F.pmod(hashed, F.greatest("rest_b", F.lit(1)))))
    others = F.when(in_main, F.sequence(F.col("main_b"), F.col("main_b") + F.col("rest_b") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("main_b") + F.col("rest_b") - 1))
    units = open_.withColumn("other", F.explode(others))
    units = units.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "label", "bits")
    more = written(units.groupBy("sig", "i", "j").applyInPandas(lambda u: _block_pairs(u, percent), "a long, b long").distinct(), "ngram-pairs")
    if more.limit(1).count():
        links = written(verify(more, held, k, percent), "ngram-links")
        if links.limit(1).count():
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))
    out = rows.select("id", *key).join(nodes, key, "left").join(labels, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "node", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, and rows without id."""
    gone = linked(docs, id_col, text_col, k, percent).where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("w_gone")).distinct()
    rows = docs.select(F.struct("*").alias("w_row"), F.col(id_col).alias("w_of"))  # other columns may have any name
    return rows.join(gone, F.col("w_of") == F.col("w_gone"), "left_anti").select("w_row.*")
