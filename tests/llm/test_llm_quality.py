import re
from collections import Counter

from edge import edge_documents, no_documents
from pyspark.sql import functions as F

from tracerisk.llm.quality import host_rates, quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_metrics_same_as_brute_force(spark):
    texts = ["a b c d e f a b c d e g", "x " * 50, "l\nl\n\n \nl\nm", "\u00a0 \u2003a|b", "one two\x0bthree\x1cfour", "\n", " "]
    texts += ["w%d " % (i % 7) * 3 for i in range(4)] + ["1 2 3 4 5 6 7 8 9 1 2 3 4 5 x 5 6 7 8 9"]
    docs = edge_documents(spark).select("doc_id", "text", "source")
    more = spark.createDataFrame([(100 + i, t, "z") for i, t in enumerate(texts)], docs.schema)
    rows = docs.unionByName(more)
    got = quality_rules(rows).collect()
    assert len(got) == rows.count()
    key = lambda m, i: (str(i), m)
    ours = sorted(key((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.doc_id) for r in got)
    assert ours == sorted(key(brute(r.text), r.doc_id) for r in rows.collect())
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_bad_host_takes_its_documents_along(spark):
    good = "this is a document of more than ten words, all of them different"
    rows = [(i, "short", "bad") for i in range(300)] + [(300, good, "bad")]
    rows += [(1000 + i, good, f"h{i % 9}") for i in range(90)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[300].base_failed and not got[300].kept
    assert all(got[1000 + i].kept for i in range(90))


def test_planted_hosts_go_and_others_stay(spark):
    """Hosts out of line in one rule each, far from failing all: their documents go, those of usual hosts stay."""
    good = "this is a document of more than ten words, all of them different and plain"
    kinds = {"short": "only four short words", "repeats": "a b c d e f " * 4, "symbols": good + " ### $$$ ***"}
    rows = []
    for h in range(40):
        kind = list(kinds)[h % 3]
        share = 0.55 if h < 3 else 0.04 + 0.002 * (h % 10)
        for k in range(400):
            text = kinds[kind] if k < 400 * share else good
            rows.append((len(rows), text, f"h{h}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules(docs).collect()
    for r in got:
        n = int(r.host[1:])
        assert r.host_failed == (list(kinds)[n] if n < 3 else None)
        assert r.kept == (n >= 3 and not r.base_failed)
    # A small host that fails by chance is shrunk to the others and stays.
    few = docs.unionByName(spark.createDataFrame([(-1, "short", "tiny"), (-2, good, "tiny")], docs.schema))
    assert {r.doc_id: r.kept for r in quality_rules(few).filter("host = 'tiny'").collect()} == {-1: False, -2: True}


def test_rates_shrink_to_the_mean(spark):
    rows = [("a", True)] + [("b", i < 50) for i in range(100)] + [("c", i < 20) for i in range(100)]
    rates = {r.host: r.rate for r in host_rates(spark.createDataFrame(rows, "host string, bad boolean"), "host", "bad").collect()}
    assert rates["a"] < 1 and rates["c"] < rates["b"] < rates["a"]


def test_empty_table(spark):
    assert quality_rules(no_documents(spark)).collect() == []
    assert quality_rules(edge_documents(spark).withColumn("host", F.lit(1))).count() == 11
