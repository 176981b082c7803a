import random

import numpy as np
import pytest
from edge import edge_documents, no_documents
from pyspark.sql import functions as F

from tracerisk.llm import catalog, graph, near_dedup
from tracerisk.llm.graph import components


def shingle_set(text):
    words = text.split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts):
    """Class of every id, from all pairs."""
    sets = {i: shingle_set(t or "") for i, t in texts}
    plain = dict(texts)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            same = (plain[a] or "") == (plain[b] or "")
            if same or n and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def family(draw, size, most):
    base = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(60, 200))]
    out = [" ".join(base)]
    for _ in range(size - 1):
        words = list(base)
        for _ in range(draw.randrange(0, most)):
            words[draw.randrange(len(words))] = f"e{draw.randrange(9999)}"
        out.append(" ".join(words))
    return out


def test_classes_same_as_brute_force(spark):
    draw = random.Random(11)
    texts = [t for size, most in ((60, 6), (8, 4), (5, 3), (3, 3)) for t in family(draw, size, most)]
    texts += [texts[0]] * 40 + ["", None, "", "a b", "a  b", "a b c d e", "a b c d e f"]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)


def test_repeated_passages_lose_no_links(spark):
    draw = random.Random(4)
    texts = []
    for _ in range(20):
        words = [f"w{draw.randrange(10**6)}" for _ in range(304)]
        texts += [" ".join(words), " ".join(words + words[100:120] * 60)]
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i, _ in rows} == brute(rows)


def test_links_off_the_pivots_of_a_large_bucket(spark):
    """All texts are at 0.794 to each other, 300 pairs at 0.853."""

    def words(name, n):
        return [f"{name}_{i}" for i in range(n)]

    common = words("t", 358)
    texts = [" ".join(common + words(f"p{k // 2}", 14) + words(f"o{k}", 32)) for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {k: k - k % 2 for k in range(600)}


def test_prefix_pairs_hold_all_links(spark):
    draw = random.Random(8)
    sets, classes = [], []
    for k in range(60):
        base = draw.sample(range(200), draw.randrange(1, 60))
        for _ in range(5):
            some = set(draw.sample(base, draw.randrange(max(1, len(base) - 8), len(base) + 1)))
            sets.append(sorted(some | set(draw.sample(range(400), draw.randrange(3)))))
            classes.append(draw.choice([1, 2, 3, 3, 3, 3, k + 10]))
    rows = list(enumerate(sets))
    texts = spark.createDataFrame(list(enumerate(classes)), "node long, class long")
    shingles = spark.createDataFrame(rows, "node long, shingles array<bigint>")
    got = {tuple(sorted(r)) for r in near_dedup._prefix_pairs(texts, shingles, 0.8).collect()}
    want = set()
    for a, s in rows:
        for b, t in rows[:a]:
            n = len({*s} & {*t})
            if classes[a] != classes[b] and n >= 0.8 * (len(s) + len(t) - n) - 1e-9:
                want.add((b, a))
    assert len(want) > 100 and want <= got
    assert all(classes[a] != classes[b] for a, b in got)


def test_query_same_as_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r.class_id for r in catalog.op1_near_dedup(spark, small).collect()}
    assert rows == brute([tuple(d) for d in docs])


def test_signatures_estimate_probability_jaccard():
    draw = np.random.default_rng(2)
    element = draw.integers(1, 2**63, 300, dtype=np.uint64)
    a, b = draw.integers(0, 4, 300).astype(float), draw.integers(0, 4, 300).astype(float)
    exact = sum(
        1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(300) if a[i] > 0 and b[i] > 0
    )
    agree = []
    for k in range(40):
        moved = near_dedup.mix64(element + np.uint64(k))
        text = np.repeat([0, 1], [int((a > 0).sum()), int((b > 0).sum())])
        own = np.concatenate([moved[a > 0], moved[b > 0]])
        weight = np.concatenate([a[a > 0], b[b > 0]])
        s = near_dedup.probminhash(text, own, weight, 2)
        agree.append((s[0] == s[1]).mean())
    assert np.mean(agree) == pytest.approx(exact, abs=0.03)


def brute_rows(rows):
    """Class of every row: links between texts, equal texts, and rows that share an id."""
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(doc, []).append(i)
    classes = brute([(i, t) for i, (_, t) in enumerate(rows)])
    changed = True
    while changed:
        changed = False
        for same in [*ids.values(), *[[i for i in classes if classes[i] == c] for c in set(classes.values())]]:
            least = min(classes[i] for i in same)
            for i in same:
                changed |= classes[i] != least
                classes[i] = least
    of = {c: min(rows[i][0] for i in classes if classes[i] == c) for c in set(classes.values())}
    return sorted((doc, of[classes[i]]) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("near", [False, True])
def test_shared_ids_and_repeated_rows(spark, near):
    """As many rows as go in, one class per id, with and without texts that share a bucket."""
    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(40)) for _ in range(12)]
    rows = [(0, texts[0]), (1, texts[0]), (1, texts[1]), (5, texts[2]), (5, texts[2]), (9, texts[3]), (3, texts[1])]
    rows += [(20 + k, t) for k, t in enumerate(texts[4:])]
    if near:
        rows += [(40, texts[5] + " more"), (2, texts[6] + " more"), (40, texts[9])]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(tuple(r) for r in got) == brute_rows(rows)
    kept = near_dedup.drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in brute_rows(rows)})


def test_repeats_bring_a_weighted_signature(spark):
    words = [f"w{i}" for i in range(30)]
    docs = [(0, 0, b"a", " ".join(words)), (1, 1, b"b", " ".join(words + words[:6] * 20)), (2, 2, b"c", " ")]
    signed = near_dedup._signed(spark.createDataFrame(docs, "row long, doc_id long, digest binary, text string"))
    bands = {r.row: r.bands for r in signed.collect()}
    assert all(len(b) == len(set(b)) for b in bands.values())
    assert len(bands[0]) == near_dedup.BANDS < len(bands[1]) and bands[2] == []


def test_edges(spark):
    docs = edge_documents(spark)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == 11
    classes = {r.doc_id: r.class_id for r in got}
    assert classes[1] == 1 and classes[2] == classes[3] == 2 and classes[4] == 4
    assert [r.class_id for r in got if r.doc_id is None] == [None, None]
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "4", "5", "7", "8", "9", "None", "None"])
    assert near_dedup.near_duplicates(no_documents(spark)).collect() == []


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    links = spark.createDataFrame([*path, *hub, (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert components(links.filter(F.lit(False))).collect() == []


def test_components_end_once_all_are_stars(spark, monkeypatch):
    """Stars need no second round to see that nothing changes: two tables are written, links and least neighbours."""
    written = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: written.append(1) or real(df))
    stars = [(100 * k, 100 * k + i) for k in range(3) for i in range(1, 20)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {100 * k + i: 100 * k for k in range(3) for i in range(20)}
    assert len(written) == 2


@pytest.mark.parametrize("most", [0, 10**6])
def test_components_by_broadcast_or_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", most)
    path = [((7 * i) % 50, (7 * (i + 1)) % 50) for i in range(30)]
    links = spark.createDataFrame([*path, *path, (60, 61), (61, 60), (62, 62), (None, 63)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {n: 0 for p in path for n in p} | {60: 60, 61: 60}
