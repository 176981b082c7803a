from collections import defaultdict

import numpy as np
import pytest
from edge import no_documents

from tracerisk.llm import catalog, whitening

VECTORS = "vec_id long, embedding array<float>, x string, n string, label int"


def brute(rows):
    """Expected rows by id, from a dense eigenvalue problem; each component's sign is free."""
    width = max((len(v) for _, v in rows if v is not None), default=0)
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None for c in v)]
    kept = [(i, v + [0.0] * (width - len(v))) for i, v in kept if np.isfinite(v).all()]
    whole = [(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v in kept]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = [k for k in values.argsort()[::-1][:4] if values[k] > 1e-9 * values.max()]
    out = defaultdict(list)
    for i, x in whole:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        y = (np.array(x, float) - np.array(sums) / n) @ vectors[:, order] / np.sqrt(values[order])
        out[i].append((n, deviation, y, values[order] / values.sum()))
    return out


def check(got, rows):
    want = brute(rows)
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    assert by.keys() == want.keys()
    k = max(r.component for r in got)
    flat_got = np.array([[{r.component: r.whitened for r in by[i]}[c + 1] for c in range(k)] for i in want])
    flat_want = np.array([want[i][0][2] for i in want])
    sign = np.sign((flat_got * flat_want).sum(axis=0))
    assert np.allclose(flat_got * sign, flat_want, atol=1e-7)
    for i, expected in want.items():
        n, deviation, _, explained = expected[0]
        assert len(by[i]) == k * len(expected)
        for r in by[i]:
            assert (r.n, r.deviation) == (n, deviation)
            assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
            assert r.identity_error < 1e-9


def test_query_same_as_dense_eigenvectors(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(catalog.op13_whitening(spark, small).collect(), [tuple(r) for r in rows])


def test_edges(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(c) for c in draw.normal(size=6)]) for i in range(30)]
    rows += [rows[4], rows[4], (100, rows[7][1]), (101, None), (102, [1.0, None]), (103, [float("nan")] * 6)]
    rows += [(104, [float("inf")] + [0.0] * 5), (105, []), (106, [2.0, -3.0]), (107, [-0.0] * 6)]
    frame = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], VECTORS)
    check(whitening.whiten(frame.repartition(5)).collect(), rows)
    assert whitening.whiten(frame.limit(0)).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).collect() == []
    assert whitening.whiten(no_documents(spark).selectExpr("doc_id AS vec_id", "array(1.0, doc_id) AS embedding")).collect() == []


def test_huge_entries_and_null_ids(spark):
    rows = [(1, [3e38, 0.0]), (None, [0.0, 1.0]), (3, [1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.vec_id for r in got} == {1, None, 3}
    assert all(r.deviation is None for r in got)


def test_more_factors_than_one_task_merges(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    draw = np.random.default_rng(5)
    rows = [(i, [float(c) for c in draw.normal(size=5) * [9, 5, 3, 1, 0.1]]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(9)
    check(whitening.whiten(frame).collect(), rows)


@pytest.mark.parametrize("name", ["random", "equal", "glued", "graded", "deficient", "one column"])
def test_directions_of_hard_spectra(name):
    draw = np.random.default_rng(1)
    turn, _ = np.linalg.qr(draw.standard_normal((40, 40)))
    spread = np.linspace(0.1, 0.9, 34)
    matrix = {
        "random": draw.standard_normal((200, 40)),
        "equal": (turn * np.r_[np.ones(6), spread]) @ turn.T,
        "glued": (turn * np.r_[1 + 1e-12 * np.arange(6), spread]) @ turn.T,
        "graded": draw.standard_normal((200, 40)) * np.logspace(0, -7, 40),
        "deficient": np.outer(np.arange(200.0), draw.standard_normal(40)),
        "one column": np.arange(9.0)[:, None],
    }[name]
    n, d = matrix.shape
    r = np.linalg.qr(matrix, mode="r")
    directions, values, trace = whitening.whitening_directions(r, n, 12)
    exact = np.linalg.svd(r, compute_uv=False) ** 2 / n
    covariance = r.T @ r / n
    assert np.allclose(values, exact[: len(values)], rtol=1e-9)
    assert np.abs(directions.T @ directions - np.eye(len(values))).max() < 1e-13
    assert np.abs(covariance @ directions - directions * values).max() < 1e-13 * exact[0]
    assert trace == pytest.approx(np.trace(covariance), rel=1e-12)
    assert len(values) == min(12, (exact > 1e-20 * exact[0]).sum()) if name != "deficient" else len(values) == 1


def test_small_singular_values_keep_their_accuracy():
    a = np.array([1.0, 1e-3, 1e-7, 1e-11, 1.0])
    b = np.array([0.5, 1e-4, 1e-8, 1e-12])
    values = whitening.dqds(a**2, b**2)
    product = np.prod(a**2)
    assert np.prod(values) == pytest.approx(product, rel=1e-12)
