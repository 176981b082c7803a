import random

import numpy as np
from edge import edge_documents, no_documents
from pyspark.sql import functions as F

from tracerisk.llm import ann, catalog, packing


def brute_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_of_the_query(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    truth = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = {}
    for r in catalog.op3_nearest(spark, small).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(truth)
    hits = sum(len({i for i, _ in truth[q]} & {i for i, _ in got[q].values()}) for q in truth)
    assert hits >= 0.95 * sum(map(len, truth.values()))
    by_id = dict(rows)
    for q, ranked in got.items():
        listed = [ranked[i] for i in sorted(ranked)]
        assert sorted(ranked) == list(range(1, len(ranked) + 1))
        assert listed == sorted(listed, key=lambda x: (-x[1], x[0]))
        for i, s in listed:
            assert abs(s - np.dot(np.array(by_id[q], float), np.array(by_id[i], float))) < 1e-12


def test_a_long_vector_blunts_no_other(spark):
    draw = np.random.default_rng(2)
    unit = draw.normal(size=(2000, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for scale in (1e4, 1e8, 1e30, 1e200):
        rows = [(i, list(map(float, v))) for i, v in enumerate(unit)]
        rows[7] = (7, [x * scale for x in rows[7][1]])
        rows[8] = (8, [x / scale for x in rows[8][1]])
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        truth = brute_nearest(rows, [r for r in rows if r[0] % 100 == 0], 20)
        found = {}
        for r in ann.nearest_neighbours(table, table.filter("vec_id % 100 = 0")).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        hits = sum(len({i for i, _ in truth[q]} & found[q]) for q in truth)
        assert hits >= 0.95 * 20 * len(truth)


def test_lengths_ties_and_odd_vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(i, list(map(float, draw.normal(size=6) * draw.uniform(0.2, 5)))) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    odd = [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 0.0]), (2003, [float("nan")] * 6), (2020, [float("inf")] * 6),
           (None, [1.0] * 6), (2040, []), (2060, [3.0, 1.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    sure = [(i, [float(np.float32(x)) for x in v] + [0.0] * (6 - len(v))) for i, v in [*rows, odd[-1]]]
    truth = brute_nearest(sure, [r for r in sure if r[0] % 20 == 0], 20)
    got = {}
    for r in ann.nearest_neighbours(table, table.filter("vec_id % 20 = 0"), beam=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(truth)
    same = sum(got[q] == [i for i, _ in truth[q]] for q in truth)
    assert same >= 0.95 * len(truth)
    # Few candidates: all of them.
    few = table.filter("vec_id in (0, 20, 5)")
    assert ann.nearest_neighbours(few, few).count() == 6
    assert ann.nearest_neighbours(table.limit(0), table).collect() == []
    assert ann.nearest_neighbours(table, table.limit(0)).collect() == []


def brute_fit(lengths, sources, clusters, capacity):
    bins = []
    out = []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [
            (b["left"], i) for i, b in enumerate(bins)
            if b["left"] >= n and b["left"] > 0 and (s is None or s not in b["s"]) and (c is None or c not in b["c"])
        ]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[i]["left"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
        out.append(i)
    return out


def test_best_fit_same_as_brute_force():
    draw = random.Random(8)
    for _ in range(30):
        n = draw.randrange(1, 150)
        lengths = [draw.randrange(1, 101) for _ in range(n)]
        sources = [draw.choice([None, "a", "b", "c", "d", "e"]) for _ in range(n)]
        clusters = [draw.choice([None, *range(20)]) for _ in range(n)]
        assert packing.best_fit(lengths, sources, clusters, 100) == brute_fit(lengths, sources, clusters, 100)


def check_plan(docs, plan, capacity):
    pieces = plan.collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    wanted = {}
    for d in docs:
        wanted[d.doc_id] = wanted.get(d.doc_id, 0) + len(d.text or "")
    assert total == wanted
    bins = {}
    for p in pieces:
        if p.bin_id is not None:
            bins.setdefault(p.bin_id, []).append(p)
    by_id = {d.doc_id: d for d in docs}
    for own in bins.values():
        assert sum(p.length for p in own) <= capacity
        assert sorted(p.position for p in own) == list(range(len(own)))
        for what in ("source", "text"):
            held = [getattr(by_id[p.doc_id], what) for p in own if p.length < capacity]
            held = [x for x in held if x is not None]
            assert len(held) == len(set(held))


def test_packing_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    check_plan(docs, catalog.op5_packing(spark, small), packing.CAPACITY)


def test_packing_shards_and_edges(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    plan = packing.pack_documents(table, capacity=1000, shard_rows=50)
    check_plan(table.collect(), plan, 1000)
    docs = edge_documents(spark)
    plan = packing.pack_documents(docs)
    check_plan(docs.collect(), plan, packing.CAPACITY)
    assert plan.filter("bin_id is null").count() == 3
    assert packing.pack_documents(no_documents(spark)).collect() == []


def test_packed_texts(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    plan = packing.pack_documents(table, capacity=500)
    texts = packing.packed_texts(table, plan, glue="")
    assert texts.agg(F.sum(F.length("text"))).first()[0] == table.agg(F.sum(F.length("text"))).first()[0]
