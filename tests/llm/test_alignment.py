import collections
import hashlib
import random

import pytest

from wickwork.llm import alignment


@pytest.fixture(scope="module")
def files():
    return alignment.Files()


def plain(files, text):
    """Groups and links of a text by whole encodings."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = files.a.encode(" " + text, add_special_tokens=False).ids, files.b.encode(text)
    if b"".join(files.a_bytes[i] for i in a) != raw or b"".join(files.b_bytes[i] for i in b) != raw:
        return None
    ends = []
    for ids, sizes in ((a, files.a_bytes), (b, files.b_bytes)):
        at, out = 0, {}
        for k, i in enumerate(ids):
            at += len(sizes[i])
            out[at] = k
        ends.append(out)
    both = sorted(set(ends[0]) & set(ends[1]))
    groups, i, j = [], 0, 0
    for e in both:
        p, q = ends[0][e] + 1, ends[1][e] + 1
        groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        i, j = p, q
    return len(a), len(b), groups, [(a[ends[0][e]], b[ends[1][e]]) for e in both]


def brute(files, rows):
    made = {t: plain(files, t) for _, t in rows}
    count = collections.Counter(p for _, t in rows if made[t] for p in made[t][3])
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for doc, t in rows:
        if m := made[t]:
            n_best = sum(count[p] == most[p[1]] for p in m[3])
            out.append((doc, m[0], m[1], len(m[2]), len(m[3]), n_best, sum(count[p] for p in m[3]), hashlib.sha256(";".join(m[2]).encode()).hexdigest()))
        else:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
    return sorted(out, key=str)


ALPHABET = ["the", "house", "Thing", "naïve", "日本語", "été", "ß", "x", "7", "1234", ".", ",", "'s", "'ll", "!?", " ", "  ", "\n", "\t", "\r\n", " ", " ", " ", "\x1c", "\x00", "<|endoftext|>", "<s>", "<0x0A>", "<unk>", "😀", "é", "﻿", "​", "ⅷ", "ﬁ"]


def rows(seed=1, n=250):
    r = random.Random(seed)
    out = []
    for i in range(n):
        gap = r.choice([" ", "", " ", "\n"])
        out.append((i, gap.join(r.choice(ALPHABET) for _ in range(r.randint(1, 40)))))
    out += [(900, None), (901, ""), (902, " "), (903, "\n"), (904, "a ▁ b"), (905, "x" * 3000), (906, "no end of words " * 2000), (None, "a null id"), (5, "a repeated id")]
    return out + [(1000 + i, "the same text as others") for i in range(40)]


@pytest.mark.parametrize(("size", "call", "cache"), [(1 << 21, 1 << 18, 300_000), (400, 64, 50)])
def test_matches_whole_encodings(spark, monkeypatch, files, size, call, cache):
    for name, v in (("BLOCK_BYTES", size), ("CALL_BYTES", call), ("CACHE_WORDS", cache)):
        monkeypatch.setattr(alignment, name, v)
    df = spark.createDataFrame([(*r, "k", i) for i, r in enumerate(rows())], "doc_id long, text string, block string, n_a int").repartition(5)
    got = alignment.align(df)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(files, rows())


def test_words_in_small_blocks(files, monkeypatch):
    """Blocks and caches of any size give the measures of whole encodings."""
    monkeypatch.setattr(alignment, "CACHE_WORDS", 30)
    monkeypatch.setattr(alignment, "CALL_BYTES", 20)
    words = alignment.Words(files)
    for k, (_, text) in enumerate(rows(7, 400)):
        if not text:
            continue
        made = plain(files, text)
        t = alignment.block(words, k, ["s"], [text], [3]).to_pylist()[0]
        one = t["texts"][0]
        if made is None:
            assert one["n_words"] < 0 and one["groups_sha256"] == "" and set(t["weights"]) <= {0}
            continue
        assert (one["n_a"], one["n_b"], one["n_groups"]) == (made[0], made[1], len(made[2]))
        assert one["groups_sha256"] == hashlib.sha256(";".join(made[2]).encode()).hexdigest()
        want = collections.Counter(a * files.b.get_piece_size() + b for a, b in made[3])
        assert dict(zip(t["pairs"], t["weights"], strict=True)) == {p: 3 * n for p, n in want.items()}


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
