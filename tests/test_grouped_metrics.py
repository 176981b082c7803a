"""Metrics per group against those of each group alone, with groups over many ranges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracerisk.operators import metrics

BY = ["model", "fold"]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(12)
    out = []
    for model, size in (("a", 4000), ("b", 300), ("c", 9), (None, 50)):
        for _ in range(size):
            label = int(draw.random() < 0.3)
            p = min(max(draw.gauss(0.4 + 0.2 * label, 0.2), 0.0), 1.0)
            p = round(p, 2) if draw.random() < 0.5 else p
            out.append((model, draw.randrange(3), label, p, float(p >= 0.5)))
    # Groups with one label only.
    out += [("one", 0, 1, 0.7, 1.0), ("one", 0, 1, 0.2, 0.0), ("none", 1, 0, 0.2, 0.0)]
    return out


@pytest.fixture(scope="module")
def scored(spark, rows):
    schema = "model string, fold int, label int, probability double, prediction double"
    return spark.createDataFrame(rows, schema).repartition(7)


@pytest.fixture(scope="module")
def scores(spark, scored):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = metrics.score_table(scored, BY)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert table.select("chunk").distinct().count() > 10
    return table


def area(group):
    pos = [p for *_, y, p, _ in group if y]
    neg = [p for *_, y, p, _ in group if not y]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def groups(rows):
    found = {}
    for r in rows:
        found.setdefault(r[:2], []).append(r)
    return found


def test_every_group_as_if_alone(rows, scores):
    got = {tuple(r)[:2]: r for r in metrics.classification_metrics_by(scores, BY).collect()}
    want = groups(rows)
    assert got.keys() == want.keys()
    for key, group in want.items():
        tp = sum(y == 1 and h == 1 for *_, y, _, h in group)
        fp = sum(y == 0 and h == 1 for *_, y, _, h in group)
        fn = sum(y == 1 and h == 0 for *_, y, _, h in group)
        r = got[key]
        assert r["accuracy"] == pytest.approx((len(group) - fp - fn) / len(group))
        assert r["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0)
        assert r["recall"] == pytest.approx(tp / (tp + fn) if tp + fn else 0)
        assert r["roc_auc"] == (None if area(group) is None else pytest.approx(area(group), abs=1e-12))


def test_corners_keep_the_curve(rows, scores):
    whole, corners = {}, {}
    for found, dropped in ((whole, False), (corners, True)):
        for r in metrics.roc_points(scores, BY, drop_intermediate=dropped).collect():
            found.setdefault((r.model, r.fold), []).append((-r.threshold, r.fpr, r.tpr))
    for key, group in groups(rows).items():
        steps = {}
        for *_, y, p, _ in group:
            steps.setdefault(p, [0, 0])[y] += 1
        ordered = sorted(steps, reverse=True)
        keep = [
            p for i, p in enumerate(ordered) if i in (0, len(ordered) - 1) or steps[p] != steps[ordered[i + 1]]
        ]
        assert sorted(corners[key])[1:] == [x for x in sorted(whole[key])[1:] if -x[0] in keep]
        assert sorted(corners[key])[0][0] == -math.inf
        if area(group) is not None:
            curve = [x[1:] for x in sorted(corners[key])]
            under = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
            assert under == pytest.approx(area(group), abs=1e-12)
    assert sum(map(len, corners.values())) < sum(map(len, whole.values()))


def test_without_groups_as_before(scored, rows):
    scores = metrics.score_table(scored)
    assert metrics.roc_auc(scores).first()[0] == pytest.approx(area(rows), abs=1e-12)
    assert metrics.classification_metrics(scores, "m").columns == ["model", *metrics.RATES, "roc_auc"]


def test_no_rows(spark, scored):
    empty = metrics.score_table(scored.filter(F.lit(False)), BY)
    assert metrics.classification_metrics_by(empty, BY).collect() == []
    assert metrics.roc_points(empty, BY, drop_intermediate=True).collect() == []
