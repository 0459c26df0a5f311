"""Whole texts cut at ASCII white space for the word-level BPE file, with a bounded cache of encoded pieces.

White space of any kind separates words for this tokenizer and is dropped; cutting at runs of
space, tab, line feed and carriage return is therefore safe: no merge, contraction, special
token, case mapping or normalisation reaches across such a run.
"""

from __future__ import annotations

import os
import re
from collections import ChainMap
from collections.abc import Callable, Iterator

#: Cached pieces per worker (half), longest piece cached, bytes per encoder batch, characters per segment of a long text,
#: per group of segments and per joined string.
CACHE_PIECES, CACHE_CHARS, BATCH_BYTES, SEGMENT_CHARS, GROUP_CHARS, JOIN_CHARS = 250_000, 48, 1 << 18, 1 << 16, 1 << 20, 1 << 11


#: A run of letters without marks of their own, and closing marks: two words of the pre-tokenizer.
WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]{0,4})")
#: Byte-level vocabularies write bytes without a sign of their own as 256 + their rank; 33 of these come before 0x7F.
BYTE_CHARS = {b: 256 + 33 + k for k, b in enumerate([0x7F, *range(0x80, 0xA1), 0xAD])}


def load(path: str | None = None):
    """The tokenizer of ``path``, by default the word-level BPE file of the public vocabulary package."""
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path)


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """Parts of a long text, cut at the last ASCII white space before each limit (else at the next one)."""
    start, n = 0, len(text)
    while n - start > limit:
        cut = max(text.rfind(c, start + 1, start + limit) for c in " \n\t\r")
        if cut < 0:
            later = [i for c in " \n\t\r" if (i := text.find(c, start + limit)) >= 0]
            if not later:
                break
            cut = min(later)
        yield text[start:cut]
        start = cut
    yield text[start:]


def split(text: str) -> list[str]:
    """The pieces of a text, without empty ones."""
    if "\n" in text:
        text = text.replace("\n", " ")
    if "\t" in text:
        text = text.replace("\t", " ")
    if "\r" in text:
        text = text.replace("\r", " ")
    return [p for p in text.split(" ") if p]


def grouped(texts: list[str | None], limit: int = GROUP_CHARS) -> Iterator[list[tuple[int, list[str]]]]:
    """(text number, pieces) of the texts' segments, in order, in groups of about ``limit`` characters."""
    group, held = [], 0
    for i, text in enumerate(texts):
        for s in segments(text or ""):
            group.append((i, split(s)))
            held += len(s)
            if held >= limit:
                yield group
                group, held = [], 0
    if group:
        yield group


class Batches:
    """Encodes many short pieces with few calls: joined by spaces and a NUL, whose token marks the seams."""

    SEAM = "\x00"

    def __init__(self, tok):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor run side by side as it is
        self.tok = tok
        self.mark = tok.encode(self.SEAM, add_special_tokens=False).ids
        # Whether normaliser and pre-tokenizer leave lower-cased letters and marks as WORD assumes.
        probe, self.direct, self.ends = ["Straßen,", "Élan", "naïveÞ?!", "Words.", "a", "ÿÀ:"], True, {}
        self.direct = self.ids(probe) == [e.ids for e in tok.encode_batch(probe, add_special_tokens=False)]

    def ids(self, batch: list[str]) -> list[list[int]]:
        """Ids of each piece: letters and closing marks by the model alone, all others as one batch."""
        if not self.direct:
            return self._mixed(batch)
        match, tokenize, ends = WORD.fullmatch, self.tok.model.tokenize, self.ends
        out: list = [None] * len(batch)
        rest = []
        for k, p in enumerate(batch):
            if m := match(p):
                word, end = m.groups()
                if not word.isascii():
                    word = word.lower().encode().decode("latin-1").translate(BYTE_CHARS)
                else:
                    word = word.lower()
                out[k] = [t.id for t in tokenize(word)]
                if end:
                    if end not in ends:
                        ends[end] = self.tok.encode(end, add_special_tokens=False).ids
                    out[k] += ends[end]
            else:
                rest.append(k)
        for k, found in zip(rest, self._mixed([batch[k] for k in rest]), strict=True):
            out[k] = found
        return out

    def _mixed(self, batch: list[str]) -> list[list[int]]:
        if not batch:
            return []
        plain = [p for p in batch if self.SEAM not in p] if len(self.mark) == 1 else []
        done = self._joined(plain) if plain else iter(())
        if len(plain) == len(batch):
            return list(done)
        rest = iter(self.tok.encode_batch_fast([p for p in batch if self.SEAM in p or not plain], add_special_tokens=False))
        return [next(done) if plain and self.SEAM not in p else next(rest).ids for p in batch]

    def _joined(self, plain: list[str]) -> Iterator[list[int]]:
        mark, start, texts = self.mark[0], 0, []
        while start < len(plain):
            stop, held = start, 0
            while stop < len(plain) and held < JOIN_CHARS:
                held += len(plain[stop])
                stop += 1
            texts.append(f" {self.SEAM} ".join(plain[start:stop]))
            start = stop
        for e in self.tok.encode_batch_fast(texts, add_special_tokens=False):
            ids, a = e.ids, 0
            try:
                while True:
                    b = ids.index(mark, a)
                    yield ids[a:b]
                    a = b + 1
            except ValueError:
                yield ids[a:]


class PieceCache:
    """Maps pieces to what ``encode`` makes of a batch of them; keeps up to 2 * CACHE_PIECES short pieces, the recent ones."""

    def __init__(self, encode: Callable[[list[str]], list]):
        self.encode, self.known, self.before = encode, {}, {}

    def load(self, lists: list[list[str]]) -> dict:
        """A map that holds every piece of ``lists``; unknown ones are encoded in batches of about BATCH_BYTES."""
        if len(self.known) > CACHE_PIECES:
            self.before, self.known = self.known, {}
        wanted = set().union(*lists).difference(self.known)
        if not wanted:
            return self.known
        new = []
        for p in wanted:
            if p in self.before:
                self.known[p] = self.before[p]
            else:
                new.append(p)
        long, batch, held = {}, [], 0
        for p in sorted(new):
            batch.append(p)
            held += len(p.encode("utf-8", "replace"))
            if held >= BATCH_BYTES:
                self._store(batch, long)
                batch, held = [], 0
        if batch:
            self._store(batch, long)
        return ChainMap(long, self.known) if long else self.known

    def _store(self, batch: list[str], long: dict) -> None:
        for p, v in zip(batch, self.encode(batch), strict=True):
            (self.known if len(p) <= CACHE_CHARS else long)[p] = v
