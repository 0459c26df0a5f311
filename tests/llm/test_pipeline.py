"""The pipeline against a plain version of each decision, stage by stage and end to end."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from wickwork.llm import langid, pieces

WORDS = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = []
    for i in range(240):
        t = [rng.choice(WORDS) for _ in range(rng.randint(1, 90))]
        rows.append([i, " ".join(t), "en" if i % 2 else "fr", f"src{i % 4}"])
        if i % 6 == 0:
            rows.append([1000 + i, "\n ".join(t), "en", "src0"])
        if i % 5 == 0 and len(t) > 60:
            t[rng.randrange(len(t))] = "other"
            rows.append([2000 + i, " ".join(t), "en", None])
    rows += [[3000, None, "en", "src1"], [3001, "12 34 !", "en", "src1"], [3002, "", None, "src2"]]
    path = str(tmp_path_factory.mktemp("sf"))
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    steps, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        if name != "bpe":
            assert now.dtypes == docs.dtypes, name
            now = corpus_pipeline.written(now, f"test-{name}")
        steps.append(now)
    language, exact, near, mixed, coded = steps
    ids = sorted(rows)
    best, score = langid.train(docs).scores([rows[i]["text"] for i in ids])
    letters = [len(re.findall(r"[^\W\d_]", rows[i]["text"] or "")) for i in ids]
    want = {i for i, b, s, n in zip(ids, best, score, letters, strict=True) if b >= 0 and (n < langid.LETTERS or s > langid.CLAIM)}
    assert {r["doc_id"] for r in language.collect()} == want
    first = {}
    for i in sorted(want):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]["text"]), i)
    want = set(first.values())
    assert {r["doc_id"] for r in exact.collect()} == want
    ids, low = sorted(want), {i: i for i in want}
    sets = {i: shingles(rows[i]["text"]) for i in ids}
    for _ in range(3):
        for a in ids:
            for b in ids:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    want = {i for i in ids if low[i] == i}
    assert want != set(ids) and {r["doc_id"] for r in near.collect()} == want
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert set(taken) <= want and max(taken.values()) <= 2
    sizes, words = Counter(), Counter()
    for i in want:
        sizes[rows[i]["source"]] += len(rows[i]["text"].split())
    for i, c in taken.items():
        words[rows[i]["source"]] += c * len(rows[i]["text"].split())
    assert abs(sum(words.values()) - 1.5 * sum(sizes.values())) < 90 * len(sizes)
    tok, out = pieces.load(), coded.collect()
    assert Counter(r["doc_id"] for r in out) == taken
    for r in out:
        ids = tok.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["source"] == rows[r["doc_id"]]["source"]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in out)
