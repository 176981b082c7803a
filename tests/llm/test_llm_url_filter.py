import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracerisk.llm.catalog import URL_RULES
from tracerisk.llm.url_filter import filter_urls

RULES = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:n])
    path = rest[n:].split("?")[0].split("#")[0]
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/",
    "https://a.b.net/es/?x#y", "x://net/fr/", "x://net/fr", "x://com", "x://com/", "x://notcom/",
    "x://a..com/", "x://.com/", "x://example.com./en/", "x://exa\nmple.com/en/\n", "a://b://com/",
    "x://É.com/É", "x://www.example.com/en/deep?q=://net/es/", "x://a.com:80/", "x:///en/",
    "x://" + "a." * 60 + "com/" + "p" * 5000,
]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_same_as_brute_force(spark, limit):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, host int")
    extra = [("", "/en/", "block"), ("b.net", "/es/", "allow"), ("com", "/", "block"), ("com", "/", "allow")]
    for rules in (URL_RULES, [*URL_RULES, *extra[:2]]):
        got = filter_urls(pages, spark.createDataFrame(rules, RULES), broadcast_rows=limit)
        rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
        assert rows == {i: brute(u, rules) for i, u in enumerate([*URLS, URLS[4]])}


def test_edges(spark):
    pages = spark.createDataFrame([(1, "x://a.com/"), (1, "x://a.com/"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block"), (None, None, "block"), ("com", "/", "?")], RULES)
    got = sorted(filter_urls(pages, rules).collect(), key=str)
    assert [r.verdict for r in got] == ["block"] * 3
    none = filter_urls(pages, rules.limit(0)).collect()
    assert [(r.rule, r.verdict) for r in none] == [(None, "allow")] * 3
    assert filter_urls(pages.limit(0), rules).collect() == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab./:?#CcoOmM", max_size=20), max_size=40))
def test_any_urls(spark, urls):
    urls = ["x://" + u for u in urls] + urls
    rules = [("com", "/", "allow"), ("a.com", "/b", "block"), ("b", "", "block"), ("a", "/a.b", "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = filter_urls(pages, spark.createDataFrame(rules, RULES)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {
        i: brute(u, rules) for i, u in enumerate(urls)
    }


def test_long_hosts_take_time_in_proportion(spark):
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("a.example.com", "/x/", "block"), ("", "", "block")], "host string, path string, verdict string"
    )
    urls = [(n, "https://" + "b." * n + "a.example.com/x/y") for n in (1, 100_000, 500_000)]
    urls += [(0, "https://" + "b" * 1_000_000 + ".com/" + "p/" * 500_000)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    filter_urls(pages.filter("page_id = 1"), rules).collect()
    start = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict, len(r.host)) for r in filter_urls(pages, rules).collect()}
    assert time.perf_counter() - start < 30
    assert got == {n: ("a.example.com/x/", "block", 2 * n + 13) for n in (1, 100_000, 500_000)} | {0: ("com/", "allow", 1_000_004)}
