import random

import pytest

from wickwork.llm import url_filter

RULES = [*url_filter.RULES, ("a.b.c", "", "block"), ("b.c", "", "allow"), ("b.c", "/x", "block"), ("b.c", "/x", "allow"), ("c", None, "block"), (None, "/y", "block"), ("", "/", "block"), ("ü.de", "/ü", "block")]


def brute(url, rules, default="allow"):
    i = (url or "").find("://")
    rest = url[i + 3 :] if i >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for h, p, v in rules:
        h, p = h or "", p or ""
        if i >= 0 and (host == h or (h and host.endswith("." + h))) and path.startswith(p):
            best = max(best or (0, 0, False, "", ""), (len(h + p), len(h), v == "block", h + p, v))
    return host, path, best and best[3], best[4] if best else default


URLS = ["https://www.Example.com/en/1", "http://example.com/en/", "http://example.com/en", "https://m.x.example.net/fr/2?q=/es/", "x://net/es/", "http://net", "http://com/", "http://notcom/en/", "no scheme", "", None, "://", "http://a.b.c", "http://z.a.b.c/x#y", "http://b.c/x/y?z", "http://b.c?x", "http://ü.de/üx", "HTTP://WWW.EXAMPLE.COM/EN/", "http://one://two/en/", "http:///y/1", "file:///x", "http://com./y", "http://example.com\n/en/", "http://.com/", "http://com./", "http://" + "a." * 500 + "com/" + "p" * 5000]


@pytest.mark.parametrize("small", [True, False])
def test_matches_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    rng = random.Random(1)
    urls = URLS + [f"http://{rng.choice(['', 'www.', 'a.'])}{rng.choice(['example.com', 'b.c', 'x.net', 'org'])}{rng.choice(['', '/', '/en/', '/x', '/fr/9', '?/en/'])}" for _ in range(200)]
    rows = [(i // 2, u) for i, u in enumerate(urls + urls[:5])] + [(None, urls[0]), (None, urls[0])]
    pages = spark.createDataFrame([(*r, "h", 3) for r in rows], "page_id long, url string, host string, w_rank int").repartition(3)
    got = sorted(map(str, (tuple(r) for r in url_filter.judge(pages, url_filter.rule_table(spark, RULES)).collect())))
    assert got == sorted(str((i, *brute(u, RULES))) for i, u in rows)


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    none = url_filter.rule_table(spark).limit(0)
    assert [tuple(r) for r in url_filter.judge(pages, none).collect()] == [(1, "a.com", "/", None, "allow")]


@pytest.mark.parametrize("small", [True, False])
def test_many_shapes(spark, monkeypatch, small):
    """Rules of more lengths than any list of them should hold."""
    if not small:
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    rules = [("h.org", "/" + "x" * k, "block" if k % 2 else "allow") for k in range(1, 5000, 3)] + [(".".join("abc"[i % 3] for i in range(k)), "/", "block") for k in range(1, 200)]
    urls = ["http://h.org/" + "x" * k for k in (0, 1, 2, 3, 4, 1000, 4999, 6000)] + ["http://" + ".".join("abc"[i % 3] for i in range(k)) + "/" for k in (1, 2, 5, 150, 220)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(tuple(r) for r in url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect())
    assert got == sorted((i, *brute(u, rules)) for i, u in enumerate(urls))
