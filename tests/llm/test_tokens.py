import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wickwork.llm import bpe, pieces, token_count

TOK = pieces.load()
CODECS = {}


def codec_of(leaf):
    if leaf not in CODECS:
        CODECS[leaf] = bpe.Codec(leaf=leaf)
    return CODECS[leaf]


ALPHABET = st.sampled_from(list("abcdeilnorst'smtdABC019!?.,-<|>é́İßΣς中文   \n\t\r\x1c\x85") + ["<|endoftext|>", "<|ENDOFTEXT|>", "\x00", "'s", "'re", "ing", "the"])


def lib(text):
    return TOK.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=80).map("".join))
def test_pieces_match_library(text):
    codec = codec_of(4)
    found = [p for s in pieces.segments(text, 16) for p in pieces.split(s)]
    assert [i for ids in codec.encode(found) for i in ids] == lib(text)
    assert [i for ids in codec.batches.ids(found) for i in ids] == lib(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("aeinrst'sd1!?é中") + ["ation", "the", "!!", "'s"]), min_size=40, max_size=400).map("".join), st.sampled_from([5, 17, 64]))
def test_tree_concatenation(text, leaf):
    assert codec_of(leaf).encode([text])[0] == lib(text)


def test_long_runs():
    import random

    random.seed(3)
    for letters in ("ab", "theinrs", "中文字a"):
        text = "".join(random.choice(letters) for _ in range(20_000))
        assert codec_of(bpe.LEAF).encode([text])[0] == lib(text)


def test_threads_share_long_runs(monkeypatch):
    """More leaves than SPREAD: parts of leaves side by side, in any number, give the library's ids."""
    import random

    random.seed(4)
    codec = bpe.Codec(leaf=16)
    for leaves in (65, 127, 301):
        text = "".join(random.choice(["the", "ing", "a", "é", "中", "!", "7", "'s"]) for _ in range(8 * leaves))
        for threads in (2, 3, 4):
            monkeypatch.setattr(bpe, "THREADS", threads)
            assert codec.encode([text])[0] == lib(text)


CASES = [(1, "Hello  World's <|endoftext|> x"), (2, None), (2, ""), (None, "a" * 5000), (3, "naïve é " * 3000), (3, "naïve é " * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7) for i, t in CASES], "doc_id long, text string, n_tokens int")


def test_encode_and_count(docs):
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in bpe.encode(docs, ids=True).collect())
    want = []
    for i, t in CASES:
        x = lib(t or "")
        want.append((i or -1, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(TOK.decode(x, skip_special_tokens=False).encode()).hexdigest(), tuple(x)))
    assert got == sorted(want)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.count_tokens(docs).collect())
    assert got == sorted((i or -1, len((t or "").encode()), len(lib(t or "")), len(lib(t or "")) > 2048) for i, t in CASES)
    assert bpe.encode(docs.limit(0)).count() == token_count.count_tokens(docs.limit(0)).count() == 0
