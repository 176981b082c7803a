import random
import re

import numpy as np
import pytest
from compare import connect, differences
from edge import edge_documents, no_documents
from pyspark.sql import functions as F

from tracerisk.llm import catalog, jaccard_join
from tracerisk.llm.oracle import ORACLE_SQL

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(texts, percent=80):
    """(doc_id, number of shingles, component) from all pairs."""
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(a & b)
            if n and 100 * n >= percent * (len(a) + len(b) - n):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    least = {}
    for i, (doc, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(texts, sets)))


def got(spark, texts, **settings):
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    return sorted(tuple(r) for r in jaccard_join.jaccard_components(frame, **settings).collect())


def family(draw, size, most, words=120, vocabulary=5000):
    base = [f"w{draw.randrange(vocabulary)}" for _ in range(draw.randrange(10, words))]
    out = [" ".join(base)]
    for _ in range(size - 1):
        own = list(base)
        for _ in range(draw.randrange(0, most)):
            own[draw.randrange(len(own))] = f"e{draw.randrange(9999)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("rounds", [2, 0])
def test_same_as_brute_force(spark, rounds):
    draw = random.Random(11)
    texts = [t for size, most in ((60, 5), (8, 4), (5, 3), (30, 9), (3, 3)) for t in family(draw, size, most)]
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [" ".join(f"u{draw.randrange(10**6)}" for _ in range(80)) + " " + passage for _ in range(40)]
    texts += [texts[0]] * 40 + ["", None, " \t", "a b", "A  b", "a b c d e", "a b c d e f", "a b c d", texts[1].upper()]
    draw.shuffle(texts)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    found = got(spark, rows, rounds=rounds)
    assert found == brute(rows)
    assert len({c for _, _, c in found}) < len(rows) - 80


def test_links_only_off_the_pivots(spark):
    """All texts are at 0.794 to each other, 100 pairs of them at 0.853."""

    def words(name, n):
        return [f"{name}_{i}" for i in range(n)]

    common = words("t", 358)
    texts = [" ".join(common + words(f"p{k // 2}", 14) + words(f"o{k}", 32)) for k in range(200)]
    assert {c for _, _, c in got(spark, list(enumerate(texts)))} == set(range(0, 200, 2))


@pytest.mark.parametrize("percent", [60, 95])
def test_thresholds(spark, percent):
    draw = random.Random(percent)
    texts = [t for _ in range(12) for t in family(draw, 8, 8, words=60, vocabulary=60)]
    rows = list(enumerate(texts))
    assert got(spark, rows, percent=percent) == brute(rows, percent)


def test_filters_lose_no_link_of_random_sets(spark):
    draw = random.Random(8)
    sets = []
    for _ in range(60):
        base = draw.sample(range(200), draw.randrange(1, 60))
        for _ in range(5):
            some = set(draw.sample(base, draw.randrange(max(1, len(base) - 8), len(base) + 1)))
            sets.append(sorted(some | set(draw.sample(range(400), draw.randrange(3)))))
    rows = [(i, len(s), s, draw.randrange(3) * 1000 + i % 40) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "node long, n long, tokens array<long>, class long")
    pairs, orders = jaccard_join._candidates(frame, 80)
    pairs = spark.createDataFrame(pairs.collect(), "a long, b long")
    linked = jaccard_join._linked(pairs, frame.join(orders, "node"), 80, ["falling", "mixed"])
    found = {tuple(r) for r in linked.collect()}
    want = set()
    for a, m, s, x in rows:
        for b, n, t, y in rows[:a]:
            k = len({*s} & {*t})
            if x != y and 100 * k >= 80 * (m + n - k):
                want.add((b, a))
    assert len(want) > 100 and found == want


def test_survivors_keep_all_that_have_a_partner(spark):
    draw = random.Random(5)
    rows = []
    for _ in range(80):
        base = [draw.randrange(-(2**63), 2**63) for _ in range(draw.randrange(1, 80))]
        for _ in range(3):
            own = draw.sample(base, draw.randrange(max(1, len(base) - 9), len(base) + 1))
            own = sorted(own + [draw.randrange(-(2**63), 2**63) for _ in range(draw.randrange(6))])
            rows.append((len(rows), len(own), own, len(rows)))
    frame = spark.createDataFrame(rows, "node long, n long, tokens array<long>, class long")
    early = frame.withColumn("early", F.filter("tokens", lambda t: t < jaccard_join.EARLY))
    late = jaccard_join._surviving(early, "early", 80, F.lit(0)).withColumnRenamed("missed", "earlier")
    late = late.withColumn("late", F.filter("tokens", lambda t: t >= jaccard_join.LATE))
    kept = {r.node for r in jaccard_join._surviving(late, "late", 80, F.col("earlier")).collect()}
    want = set()
    for a, m, s, _ in rows:
        for b, n, t, _ in rows[:a]:
            k = len({*s} & {*t})
            if 100 * k >= 80 * (m + n - k):
                want |= {a, b}
    assert 60 < len(want) < len(rows) and want <= kept


def test_query_same_as_sql(spark, small):
    found = differences(catalog.op11_jaccard_join(spark, small), connect(small), ORACLE_SQL["op11_jaccard_join"])
    assert found == []


def test_query_same_as_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows = catalog.op11_jaccard_join(spark, small).collect()
    assert sorted(tuple(r) for r in rows) == brute([tuple(d) for d in docs])


def test_edges(spark):
    docs = edge_documents(spark)
    rows = [tuple(r) for r in jaccard_join.jaccard_components(docs).collect()]
    assert len(rows) == 11
    assert [r for r in rows if r[0] == 1] == [(1, 9, 1)] * 2
    assert {r[1:] for r in rows if r[0] in (2, 3, 4)} == {(0, 2), (0, 3), (0, 4)}
    assert sorted((n, c) for i, n, c in rows if i is None) == [(0, None), (6, None)]
    assert jaccard_join.jaccard_components(no_documents(spark)).collect() == []
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert got(spark, [tuple(r) for r in blank.collect()]) == [(1, 0, 1), (2, 0, 2)]


def test_rows_with_one_id(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    assert got(spark, [(5, a), (5, b), (7, b), (7, b), (3, a)]) == [(3, 2, 3), (5, 2, 3), (5, 2, 5), (7, 2, 5), (7, 2, 5)]


def test_sketch_keys_agree_with_the_power_of_the_similarity():
    draw = np.random.default_rng(1)
    agree = []
    for _ in range(300):
        values = draw.permutation(np.unique(draw.integers(-(2**63), 2**63, 250)))
        a, b = np.sort(values[:225]), np.sort(values[25:])
        agree.append((jaccard_join._sketch(a) == jaccard_join._sketch(b)).mean())
    assert np.mean(agree) == pytest.approx(0.8**jaccard_join.MINIMA, abs=0.04)


def test_two_orders_of_one_text_are_alike(spark):
    known = jaccard_join._WordHashes()
    one, none, word, twice = jaccard_join.shingle_sets(["a b c d e f", "", "x", "a b c d e f a b c d e f"], known)
    assert [len(one), len(none), len(word), len(twice)] == [2, 0, 1, 6]
    assert set(one) <= set(twice)
    assert jaccard_join.shingle_sets([], known) == []
