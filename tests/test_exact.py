"""Range-based ranks, splits and metrics against brute force."""

import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracerisk.functions import two_sided_p
from tracerisk.operators import metrics, profile, split
from tracerisk.operators.quantiles import exact_quantiles


def test_quantiles(spark):
    rng = random.Random(2)
    data = [(g, rng.choice([1.5, 2.5, rng.random()]) if rng.random() < 0.9 else None, rng.randrange(9))
            for g in (0, 1) for _ in range(701 + g)]
    df = spark.createDataFrame(data, "label int, x double, y int")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    found = {
        (r["label"], r["feature"], r["prob"]): r["value"]
        for r in exact_quantiles(df, ["x", "y"], probs, ["label"]).collect()
    }
    assert len(found) == 24
    for (label, feature, prob), value in found.items():
        column = [r["xy".index(feature) + 1] for r in data if r[0] == label]
        known = [v for v in column if v is not None]
        assert value == pytest.approx(np.quantile(known, prob), abs=1e-12)


def test_describe_of_nulls_and_single_value(spark):
    df = spark.createDataFrame([(None, 4.0)], "a double, b double")
    rows = {r["feature"]: r for r in profile.describe(df, ["a", "b"]).collect()}
    assert rows["a"]["n"] == 0 and rows["a"]["median"] is None
    assert rows["b"]["q1"] == rows["b"]["median"] == rows["b"]["max"] == 4.0
    assert rows["b"]["std"] is None


def test_histogram_matches_numpy(spark):
    rng = random.Random(3)
    values = [rng.expovariate(0.01) for _ in range(2000)] + [500.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = profile.histogram(df, "v", 50, 500).orderBy("bin").collect()
    counts, edges = np.histogram(np.minimum(values, 500), bins=50)
    assert [r["n_rows"] for r in rows] == counts.tolist()
    assert [r["bin_start"] for r in rows] == pytest.approx(edges[:-1].tolist())


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (1.0, 3.0, 1)], "a double, b double, label int")
    rows = {r["feature"]: r[1] for r in profile.feature_label_correlation(df, ["a", "b"]).collect()}
    assert rows["a"] is None and rows["b"] == pytest.approx(1.0)
    assert sum(r["n_rows"] for r in profile.histogram(df, "a", 4).collect()) == 2


def test_correlation_with_nulls(spark):
    """Each pair over its own complete rows."""
    rng = random.Random(6)
    rows = [(*(rng.gauss(0, 1) if rng.random() < 0.8 else None for _ in range(2)),
             rng.gauss(5, 2), 1.0) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    found = {r[:2]: r[2] for r in map(tuple, profile.correlation_matrix(df, "abcd").select(
        "feature", "other", "correlation").collect())}
    assert len(found) == 16
    for (x, y), value in found.items():
        if "d" in (x, y):
            assert value is None
            continue
        both = [(r["abc".index(x)], r["abc".index(y)]) for r in rows]
        both = np.array([p for p in both if None not in p])
        assert value == pytest.approx(np.corrcoef(both.T)[0, 1])


@pytest.fixture(scope="module")
def tasks(spark):
    rows = [(i // 7, i % 7, int(i % 4 == 0)) for i in range(3000)]
    return spark.createDataFrame(rows, "job_id long, task_index int, label int"), rows


def _digest(row):
    return hashlib.md5(f"{row[0]}|{row[1]}|42".encode()).hexdigest()


def test_stratified_split(tasks):
    df, rows = tasks
    wanted = {}
    for label in (0, 1):
        ranked = sorted((r for r in rows if r[2] == label), key=lambda r: (_digest(r), r))
        for i, r in enumerate(ranked):
            wanted[r] = "test" if i < round(0.2 * len(ranked)) else "train"
    found = {tuple(r)[:3]: r["split"] for r in split.stratified_split(df).collect()}
    assert found == wanted


def test_stratified_split_extremes(tasks):
    df, _ = tasks
    assert split.stratified_split(df, 0.0).filter("split = 'test'").count() == 0
    assert split.stratified_split(df, 1.0).filter("split = 'train'").count() == 0


def test_stratified_folds(tasks):
    df, rows = tasks
    folds = split.stratified_folds(df, 5).collect()
    assert len(folds) == len(rows)
    sizes = {}
    for r in folds:
        sizes[r["label"], r["fold"]] = sizes.get((r["label"], r["fold"]), 0) + 1
    for label in (0, 1):
        per_fold = [sizes[label, f] for f in range(5)]
        assert max(per_fold) - min(per_fold) <= 1


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(1500):
        label = int(rng.random() < 0.3)
        p = min(max(rng.gauss(0.4 + 0.2 * label, 0.2), 0.0), 1.0)
        p = round(p, 2) if rng.random() < 0.5 else p
        rows.append((label, p, float(p >= 0.5)))
    df = spark.createDataFrame(rows, "label int, probability double, prediction double")
    return metrics.score_table(df), rows


def test_auc_and_roc(scored):
    scores, rows = scored
    pos = np.array([p for y, p, _ in rows if y])
    neg = np.array([p for y, p, _ in rows if not y])
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    auc = metrics.roc_auc(scores).first()[0]
    assert auc == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    points = sorted(map(tuple, metrics.roc_points(scores).collect()), key=lambda r: -r[0])
    assert points[0] == (math.inf, 0.0, 0.0) and points[-1][1:] == (1.0, 1.0)
    for threshold, fpr, tpr in points[1:]:
        assert fpr == pytest.approx((neg >= threshold).mean())
        assert tpr == pytest.approx((pos >= threshold).mean())


def test_metrics_of_predictions(scored):
    scores, rows = scored
    tp = sum(y == 1 and h == 1 for y, _, h in rows)
    fp = sum(y == 0 and h == 1 for y, _, h in rows)
    fn = sum(y == 1 and h == 0 for y, _, h in rows)
    tn = len(rows) - tp - fp - fn
    assert metrics.confusion_counts(scores).first().asDict() == dict(tn=tn, fp=fp, fn=fn, tp=tp)
    row = metrics.classification_metrics(scores, "m").first()
    assert row["precision"] == pytest.approx(tp / (tp + fp))
    assert row["recall"] == pytest.approx(tp / (tp + fn))
    assert row["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert row["accuracy"] == pytest.approx((tp + tn) / len(rows))
    report = {r["class"]: r for r in metrics.classification_report(scores).collect()}
    assert report["1"]["f1"] == pytest.approx(row["f1"])
    assert report["weighted avg"]["recall"] == pytest.approx(row["accuracy"])
    assert report["macro avg"]["support"] == len(rows)


def test_no_positive_prediction(spark):
    df = spark.createDataFrame([(0, 0.1, 0.0), (1, 0.2, 0.0)], "label int, probability double, prediction double")
    row = metrics.evaluate_model("m", df).first()
    assert (row["precision"], row["recall"], row["f1"], row["roc_auc"]) == (0.0, 0.0, 0.0, 1.0)


# Critical values of the t distribution (table values, two-sided level).
TABLE = [(1, 12.70620, 0.05), (2, 4.302653, 0.05), (3, 3.182446, 0.05), (4, 2.776445, 0.05),
         (5, 4.032143, 0.01), (9, 3.249836, 0.01), (10, 2.228139, 0.05), (30, 2.750, 0.01)]


@pytest.mark.parametrize("dof,t,p", TABLE)
def test_student_p(spark, dof, t, p):
    row = spark.range(1).select(two_sided_p(F.lit(-t), F.lit(dof))).first()
    assert row[0] == pytest.approx(p, rel=2e-4)


def test_paired_ttest(spark):
    best, base = [0.83, 0.84, 0.82, 0.85, 0.83], [0.80, 0.83, 0.80, 0.81, 0.82]
    gaps = [a - b for a, b in zip(best, base)]
    t = statistics.mean(gaps) / (statistics.stdev(gaps) / math.sqrt(5))
    df = spark.createDataFrame(list(zip(range(5), best, base)), "fold int, best double, baseline double")
    row = metrics.run_paired_ttest(df).first()
    theta = math.atan(t / 2)
    p = 1 - math.sin(theta) * (1 + math.cos(theta) ** 2 / 2)
    assert row["t_statistic"] == pytest.approx(t)
    assert row["p_value"] == pytest.approx(p)
    assert row["significant"] == (p < 0.05)


def test_window_numbers_are_whole_beyond_doubles(spark):
    from tracerisk.functions.columns import bucket

    times = [0, 1, -1, 299_999_999, 300_000_000, -300_000_000, -300_000_001, 2**53 + 1, 2**62 + 7]
    rows = spark.createDataFrame([(t,) for t in times], "t long")
    got = {r.t: r.b for r in rows.select("t", bucket(rows["t"], 300).alias("b")).collect()}
    assert got == {t: t // 300_000_000 for t in times}


def test_histogram_leaves_nan_out(spark):
    from tracerisk.operators.profile import histogram

    rows = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,), (10.0,)], "x double")
    got = {r.bin: r.n_rows for r in histogram(rows, "x", 10).collect()}
    assert got == {0: 1, 1: 1, 9: 1} | {i: 0 for i in range(2, 9)}


def test_boxplot_of_many_groups(spark):
    from pyspark.sql import functions as F

    from tracerisk.operators.profile import boxplot_stats

    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("label"), (F.col("id") / 20_000).cast("int").alias("x"))
    got = boxplot_stats(rows, ["x"])
    assert got.count() == 20_000
    assert got.filter("q1 = 0.5 AND median = 1.0 AND q3 = 1.5").count() == 20_000
