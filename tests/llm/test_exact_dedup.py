import hashlib
import re

import pytest

from wickwork.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        ids = [x for x in groups[t] if x is not None]
        out.append((str(i), str(min(ids) if ids else None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out), len(groups)


def table():
    rows = [(i, f"text {i % 40}" + " " * (i % 3) + "end") for i in range(300)]
    rows += [(1000 + i, "the hot  text" if i % 2 else "the\nhot\ttext") for i in range(200)]
    rows += [(5000, None), (5001, ""), (5002, " "), (5003, "\t\n"), (5004, "x" * 200_000), (5005, "x" * 200_000), (5006, "x" * 199_999 + "y")]
    rows += [(None, "text 1 end"), (None, "only null ids"), (None, "only null ids"), (7, "text 7 end"), (7, "text 7 end"), (8, "another text of id 8"), (5007, "é\xa0é"), (5008, "é é")]
    return rows


@pytest.mark.parametrize("hot", [10_000, 16])
def test_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "MIN_HOT", hot)
    rows = table()
    df = spark.createDataFrame([(*r, i, "z") for i, r in enumerate(rows)], "doc_id long, text string, count int, keep_id string").repartition(7)
    got = exact_dedup.grouped(df).collect()
    want, texts = brute(rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == texts and len({r["text_sha256"] for r in kept}) == texts and all(r["keep_id"] == r["doc_id"] for r in kept)
    stay = exact_dedup.drop_copies(df)
    assert stay.columns == df.columns and sorted(str(r["doc_id"]) for r in stay.collect()) == sorted(str(r["doc_id"]) for r in kept)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.grouped(df).count() == exact_dedup.drop_copies(df).count() == 0


def test_hot_group_spreads(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MIN_HOT", 50)
    df = spark.createDataFrame([(i, "same text") for i in range(1000)], "doc_id long, text string").repartition(4)
    r = exact_dedup.grouped(df).collect()
    assert {(x["keep_id"], x["group_size"]) for x in r} == {(0, 1000)} and [x["doc_id"] for x in r if x["kept"]] == [0]


def test_one_id_of_many_rows_spreads(spark, monkeypatch):
    """A third of all rows with one text and one id (or null): rows are combined before the sort, and each comes back once."""
    monkeypatch.setattr(exact_dedup, "MIN_HOT", 50)
    rows = [(1, "same  text", i) for i in range(1000)] + [(None, "null\tids", i) for i in range(700)] + [(9, "null ids", -1), (3, "same text", -2), (0, "other", -3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, w_part int").repartition(6)
    got = exact_dedup.grouped(df).collect()
    want, texts = brute([r[:2] for r in rows])
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert sorted(r["doc_id"] for r in got if r["kept"]) == [0, 1, 9] and texts == 3
    stay = exact_dedup.drop_copies(df)
    assert stay.columns == df.columns and sorted(r["doc_id"] for r in stay.collect()) == [0, 1, 9]
    only = spark.createDataFrame([(None, "a  b")] * 400, "doc_id long, text string").repartition(5)
    got = exact_dedup.grouped(only).collect()
    assert len(got) == 400 and sum(r["kept"] for r in got) == 1 and {(r["keep_id"], r["group_size"]) for r in got} == {(None, 400)}
    assert exact_dedup.drop_copies(only).count() == 1


def test_native(spark):
    plan = exact_dedup.grouped(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
