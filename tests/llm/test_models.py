"""Quality and language: held-out accuracy on small tables, and the defined results."""

import random
import zlib

import numpy as np
import pytest

from wickwork.llm import langid, quality
from wickwork.llm.common import held_out

VOICES = {"aa": ["banana", "papaya", "salsa", "canasta", "mañana"], "ee": ["pepper", "seven", "elefen", "tree", "über"], "ru": ["слово", "текст", "буква", "речь"]}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        lang = rng.choice(list(VOICES))
        words = [rng.choice(VOICES[lang]) + rng.choice("aeiou") for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words) if i % 3 else "!! ".join(words * 3).upper() + "###", lang))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "ee"), (None, "banana papaya", None), (None, "banana papaya", None), (1003, "tree seven " * 30_000, None)]
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, lang string, score int, id string").repartition(3)


def test_language(spark, docs):
    got = [r.asDict() for r in langid.identify(docs).collect()]
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert held and np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.95
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[1000] == by[1001] == by[1002] == "und" and by[1003] == "ee" and by[None] == "aa"
    assert {r["doc_id"] for r in got if r["held_out"]} == {r["doc_id"] for r in docs.where(held_out()).collect()}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == len(got) - 3
    assert langid.identify(docs.limit(0)).count() == 0
    nothing = docs.where("doc_id >= 1000").drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.identify(nothing).collect()} == {"und"}


def test_kernel_is_presence(spark):
    m = langid.Model(["abc abc", "xyz"], ["a", "x"])
    k = m.kernel(m.presence([m.code[langid.points(t)] for t in ("abc", "xyz")]))
    assert abs(k[0, 0] - 1) < 0.25 and k[0, 1] < k[0, 0]


def test_quality(spark, docs):
    labels = docs.selectExpr("doc_id", "case when doc_id < 1000 then cast(doc_id % 3 <> 0 as int) end as quality", "0 as toxic")
    got = [r.asDict() for r in quality.score(docs, labels).collect()]
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 != 0) for r in held]) > 0.95
    assert quality.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}


def test_flat_trees_match_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    t = quality.Trees(x, (x[:, 0] * x[:, 1] > 0).astype(float))

    def walk(row):
        f = t.base
        for k in range(len(t.feature)):
            n = 0
            for _ in range(quality.DEPTH):
                n = 2 * n + 1 + int(row[t.feature[k, n]] > t.threshold[k, n])
            f += t.value[k, n - (2**quality.DEPTH - 1)]
        return 1 / (1 + np.exp(-f))

    assert np.allclose(t.score(x[:50]), [walk(r) for r in x[:50]])


def test_every_language_is_learned(spark):
    """Repeated and null ids, very uneven languages, letters far behind the beginning, more languages than the sample and landmarks."""
    rng = random.Random(5)

    def text(lang, n=30):
        return " ".join(rng.choice(VOICES[lang]) + rng.choice("aeiou") for _ in range(n))

    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(one, text("aa"), "aa") for _ in range(3000)] + [(5000 + 4 * k, text("ee"), "ee") for k in range(3)] + [(None, text("ru"), "ru")] * 40
    rows += [(None, "7 ! " * 2000 + "ţş ţâţ şţâ", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    probe = spark.createDataFrame([(i, text(v), v) for i, v in enumerate(["aa", "ee", "ru"] * 30)] + [(99, "şţâ ţş", "zz")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["aa", "ee", "ru", "zz"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(probe, model=model).collect()}
    want = {r["doc_id"]: r["lang"] for r in probe.collect()}
    assert np.mean([got[i] == want[i] for i in want]) > 0.95 and got[99] == "zz"
    same = spark.createDataFrame([(one, "one text of all", "aa")] * 2000 + [(one, "another text", "bb")], "doc_id long, text string, lang string")
    assert langid.train(same).langs == ["aa", "bb"]


def test_more_languages_than_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    monkeypatch.setattr(langid, "LANDMARKS", 8)
    docs = spark.range(400).selectExpr("id as doc_id", "concat('text', char(97 + id % 40 % 26), ' ', char(97 + id % 40 div 26), 'x') as text", "concat('l', id % 40) as lang")
    model = langid.train(docs)
    assert len(model.langs) == 40 and model.marks.shape[1] == 40


def test_batch_size_of_the_session_stays(spark, docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    langid.identify(docs).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_repeated_ids_send_no_more_rows_than_the_sample(spark, monkeypatch):
    """Rows of statistics that reach the driver are bounded where ids repeat as well."""
    rows = [(i % 3, f"text number {i} " * (1 + i % 9)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "Trees", lambda x, y: seen.append((x.shape, len(y))))
    quality.train(docs, labels, sample=50)
    ((shape, n),) = seen
    assert shape == (n, len(quality.FEATURES)) and 0 < n <= 50


def test_statistics_by_hand():
    """The counted statistics against plain Python on small texts."""
    names = quality.FEATURES
    for text in ["Two words.", "A b\nC d e!\n12 ,, x", "één été", "one one one two", "", "UPPER lower 123"]:
        raw = text.encode()
        got = dict(zip(names, quality.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], strict=True))
        n = len(raw)
        if not n:
            assert not any(got.values())
            continue
        w = text.split()
        share = lambda f: sum(map(f, raw)) / n
        want = {
            "log bytes": np.log1p(n), "log words": np.log1p(len(w)), "bytes a word": n / len(w), "upper": share(lambda b: 65 <= b <= 90), "lower": share(lambda b: 97 <= b <= 122), "digits": share(lambda b: 48 <= b <= 57),
            "space": share(lambda b: b in (32, 9, 13)), "line feeds": share(lambda b: b == 10), "full stops and commas": share(lambda b: b in b".,;:"), "exclamation and question marks": share(lambda b: b in b"!?"),
            "beyond ASCII": share(lambda b: b >= 128), "distinct words": len(set(w)) / len(w), "distinct lines": len(set(text.split("\n"))) / len(text.split("\n")),
            "commonest word": max(w.count(x) for x in w) / len(w), "one-letter words": sum(len(x.encode()) == 1 for x in w) / len(w), "bytes a line": n / len(text.split("\n")), "capital words": sum("A" <= x[0] <= "Z" for x in w) / len(w),
        }
        for name, v in want.items():
            assert got[name] == pytest.approx(v), (text, name)
