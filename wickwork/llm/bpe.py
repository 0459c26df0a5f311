"""BPE encoding and decoding with tree concatenation of long unsplit text.

Texts are cut at ASCII white space, where this tokenizer always splits, and pieces are encoded in
batches. A piece beyond ``LEAF`` characters has no such cut: it is normalised, halved again and
again, its leaves are encoded (beyond ``SPREAD`` leaves by ``THREADS`` threads side by side; the encoder
lets go of Python's lock) and the halves are joined bottom-up. At each join a
window around the cut is encoded anew and grows until both sides agree exactly: it begins with
the left side's token at the window's start, and it holds a token of the right side at the same
place. A BPE token sequence is the encoding of its text exactly when each adjacent pair of tokens
is the encoding of that pair's text, so tokens left of, within and right of the window then form the
encoding of the whole; a window that reaches both ends is the whole.

Decoding is the library's ``decode(ids, skip_special_tokens=False)``; the file has no decoder,
so it joins the ids' vocabulary entries with one space.

Defined results: null and empty texts have no tokens (digests of the empty string); ids may be
null or repeat; an empty table gives an empty result; extra columns are carried by ``encode``
only where asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

from wickwork.llm import pieces
from wickwork.llm.common import sliced

#: Characters of a leaf, and tokens of the first window on each side of a join.
LEAF, WINDOW = 512, 8
#: Leaves of a text beyond which threads share its leaves and joins, and their number.
SPREAD, THREADS = 64, 4


class Codec:
    """Encodes pieces to ids; pieces hold no ASCII white space."""

    def __init__(self, path: str | None = None, leaf: int = LEAF):
        from tokenizers.normalizers import Sequence

        self.tok, self.plain, self.leaf = pieces.load(path), pieces.load(path), leaf
        for t in (self.tok, self.plain):
            t.no_truncation()
            t.no_padding()
        self.norm = self.plain.normalizer
        self.plain.normalizer = Sequence([])  # for text that is normalised already
        self.plain.encode_special_tokens = True
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.names: dict[int, str] = {}
        self.batches = pieces.Batches(self.tok)

    def name(self, i: int) -> str:
        if i not in self.names:
            self.names[i] = self.tok.id_to_token(i)
        return self.names[i]

    def size(self, i: int) -> int:
        """UTF-8 bytes of a token's text: its entry has one character per byte, and an end-of-word mark."""
        return len(self.name(i).removesuffix("</w>"))

    def encode(self, batch: list[str]) -> list[list[int]]:
        """Ids of each piece."""
        done = iter(self.batches.ids([p for p in batch if len(p) <= self.leaf]))
        return [next(done) if len(p) <= self.leaf else self.long(p) for p in batch]

    def long(self, piece: str) -> list[int]:
        out: list[int] = []
        for part in self.special.split(piece) if self.special else [piece]:
            if not part:
                continue
            if self.special and self.special.fullmatch(part):
                out.append(self.tok.token_to_id(part))
                continue
            for run in self.norm.normalize_str(part).split(" "):  # other white space is a space now
                if run:
                    out += self.tree(run)
        return out

    def tree(self, run: str) -> list[int]:
        """Ids of normalised text without white space: leaves in one batch, then joins by levels."""
        level = [run]
        while max(map(len, level)) > self.leaf:
            level = [h for s in level for h in ((s[: len(s) // 2], s[len(s) // 2 :]) if len(s) > self.leaf else (s,))]
        if len(level) <= SPREAD:
            return self.joined(level)[1]
        # Halves side by side, down to as many parts as there are threads; then the joins between the parts.
        size = -(-len(level) // THREADS)
        with ThreadPoolExecutor(THREADS) as pool:
            parts = list(pool.map(self.joined, [level[k : k + size] for k in range(0, len(level), size)]))
        return self.rising(parts)[1]

    def joined(self, leaves: list[str]) -> tuple[bytes, list[int]]:
        """Neighbouring leaves as one text and its ids."""
        found = self.plain.encode_batch_fast(leaves, add_special_tokens=False)
        return self.rising([(s.encode(), e.ids) for s, e in zip(leaves, found, strict=True)])

    def rising(self, parts: list[tuple[bytes, list[int]]]) -> tuple[bytes, list[int]]:
        """Joins of neighbours by levels."""
        while len(parts) > 1:
            pairs = [(x[0] + y[0], self.join(*x, *y)) for x, y in zip(parts[::2], parts[1::2])]
            parts = pairs + parts[len(parts) & ~1 :]
        return parts[0]

    def join(self, left: bytes, a: list[int], right: bytes, b: list[int]) -> list[int]:
        text, cut = left + right, len(left)
        w = WINDOW
        while True:
            i, start = max(0, len(a) - w), cut - sum(self.size(t) for t in a[max(0, len(a) - w) :])
            # not inside a character, and not at a quote, which may open a contraction
            while i > 0 and (text[start] & 0xC0 == 0x80 or text[start] == 0x27):
                i -= 1
                start -= self.size(a[i])
            j, end = min(len(b), w), cut + sum(self.size(t) for t in b[:w])
            while j < len(b) and text[end] & 0xC0 == 0x80:
                end += self.size(b[j])
                j += 1
            new = self.plain.encode(text[start:end].decode(), add_special_tokens=False).ids
            if i == 0 and j == len(b):
                return new
            if i == 0 or new[:2] == a[i : i + 2]:
                if j == len(b):
                    return a[:i] + new
                ends, at = {}, cut  # where the right side's tokens begin
                for k in range(j - 1):
                    ends[at] = k
                    at += self.size(b[k])
                at = start
                for k, t in enumerate(new[:-1]):
                    if at >= cut and at in ends and b[ends[at]] == t and k + 2 < len(new) and b[ends[at] + 1] == new[k + 1]:
                        return a[:i] + new[:k] + b[ends[at] :]
                    at += self.size(t)
            w *= 2


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = LEAF, ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, ``keep`` columns, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``ids``, the ids themselves."""
    n_keep = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, leaf)
        entry = {i: t for t, i in codec.tok.get_vocab(with_added_tokens=True).items()}
        name = [entry.get(i, "") for i in range(max(entry) + 1)]
        number = list(map(str, range(len(name))))

        def entries(batch: list[str]) -> list[tuple]:
            return [(len(x), " ".join([number[i] for i in x]), " ".join([name[i] for i in x]), x if ids else None) for x in codec.encode(batch)]

        cache = pieces.PieceCache(entries)
        for batch in sliced(batches):
            found = batch.column(n_keep).to_pylist()
            n, lists = [0] * len(found), [[] for _ in found]
            coded, decoded = [hashlib.sha256() for _ in found], [hashlib.sha256() for _ in found]
            for group in pieces.grouped(found):
                known = cache.load([p for _, p in group])
                for i, p in group:
                    hit = [x for x in map(known.__getitem__, p) if x[0]]
                    if hit:
                        gap = " " if n[i] else ""
                        n[i] += sum([x[0] for x in hit])
                        coded[i].update((gap + " ".join([x[1] for x in hit])).encode())
                        decoded[i].update((gap + " ".join([x[2] for x in hit])).encode())
                        if ids:
                            for x in hit:
                                lists[i] += x[3]
            coded, decoded = [h.hexdigest() for h in coded], [h.hexdigest() for h in decoded]
            columns = [batch.column(k) for k in range(n_keep)] + [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            columns += [pa.array(lists, pa.list_(pa.int32()))] * ids
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    rows = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate((id_col, *keep))], docs[text_col].alias("w_text"))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[:n_keep]] + ["long", "string", "string"] + ["array<int>"] * ids
    names = [id_col, *keep, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    return rows.mapInArrow(run, ", ".join(f"c{k} {t}" for k, t in enumerate(kinds))).toDF(*names)
