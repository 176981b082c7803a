import importlib
import re

from edge import edge_documents, no_documents
from pyspark.sql import functions as F

import corpus_pipeline
from tracerisk.llm import language_id, near_dedup, secret_scan, toxicity


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, got = got, stage(spark, got, small)
        assert got.columns == docs.columns
        rows, kept = before.collect(), got.collect()
        ids = {r.doc_id for r in kept}
        if i == 0:
            told = language_id.predict_language(before, language_id.train_language_model(before)).collect()
            assert ids == {r.doc_id for r in told if r.lang_pred != "und" and not r.ambiguous}
        if i == 1:
            model = toxicity.train_toxicity_model(before, labels)
            assert ids == {r.doc_id for r in toxicity.score_toxicity(before, model).collect() if not r.predicted}
        if i == 2:
            classes = near_dedup.near_duplicates(before).collect()
            assert ids == {r.class_id for r in classes}
        if i == 3:
            assert ids == {r.doc_id for r in rows}
            assert secret_scan.scan_secrets(got).filter(F.size("spans") > 0).count() == 0
            assert all(r.n_chars == len(r.text) for r in kept)
        got = spark.createDataFrame(kept, docs.schema)
    plan = corpus_pipeline.STAGES[-1][1](spark, got, small)
    assert {r.doc_id for r in plan.collect()} == {r.doc_id for r in got.collect()}


def test_odd_documents(spark, small):
    for docs in (edge_documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            assert out.count() <= docs.count() + 200
            if out.columns == docs.columns:
                docs = spark.createDataFrame(out.collect(), docs.schema)


def test_the_corpus_is_written(spark, small, tmp_path):
    corpus_pipeline.write_corpus(spark, small, str(tmp_path / "corpus"))
    documents, plan, sequences = (
        spark.read.parquet(str(tmp_path / "corpus" / n)).collect() for n in ("documents", "plan", "sequences")
    )
    texts = {d.doc_id: d.text for d in documents}
    assert len(texts) == len(documents) > 100
    bins = {}
    for p in plan:
        if p.bin_id is not None:
            bins.setdefault(p.bin_id, []).append((p.position, texts[p.doc_id][p.start : p.start + p.length]))
    assert {s.bin_id: s.text for s in sequences} == {b: "\n".join(t for _, t in sorted(ps)) for b, ps in bins.items()}
    whole = {i: "" for i in texts}
    for p in sorted(plan, key=lambda p: (p.doc_id, p.start)):
        whole[p.doc_id] += texts[p.doc_id][p.start : p.start + p.length]
    assert whole == {i: t or "" for i, t in texts.items()}


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names
    assert {m[0] for n in names if (m := re.match(r"op\d+(?=_)", n))} == {f"op{i}" for i in range(1, 14)}
