"""Trees grown from histograms: those of Spark's fit, without a store per tree."""

import random
from functools import partial

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tracerisk import load_model, predict, save_model, train_boosted_trees, train_random_forest
from tracerisk.operators import experiments, histograms, metrics, models
from tracerisk.operators.split import balanced_weight, class_counts, prepare_data
from tracerisk.operators.trees import tree_nodes
from tracerisk.schema import ALL_FEATURES
from tracerisk.sources import materialize

SETTINGS = {
    train_boosted_trees: {"n_estimators": 5, "max_depth": 4, "max_bins": 32},
    train_random_forest: {"n_estimators": 20, "max_depth": 5, "max_bins": 32},
}


@pytest.fixture(scope="module")
def matrix(spark):
    """Features that tell the label in part; one has three values, one zeros in half of the rows, one is constant."""
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        label = int(rng.random() < 0.3)
        values = [rng.gauss(0.3 * label * (k % 3), 1) for k in range(len(ALL_FEATURES))]
        values[0], values[1], values[2] = float(rng.randrange(3)), max(values[1], 0.0), 7.0
        rows.append((i, 0, 1, *values, label))
    names = ["job_id long", "task_index int", "machine_id long"]
    schema = ", ".join([*names, *[f"{c} double" for c in ALL_FEATURES], "label int"])
    return materialize(spark.createDataFrame(rows, schema))


@pytest.fixture(scope="module")
def parts(matrix):
    return prepare_data(matrix)


def nodes(model):
    return tree_nodes(model).orderBy("tree", "node").collect()


def same(found, expected):
    assert len(found) == len(expected) > 10
    for a, b in zip(found, expected):
        assert (a["tree"], a["node"], a["feature"], a["left"], a["right"], a["rows"]) == (
            b["tree"], b["node"], b["feature"], b["left"], b["right"], b["rows"])
        for c in ("threshold", "weight", "impurity", "gain"):
            assert (a[c] is None) == (b[c] is None)
            assert a[c] is None or a[c] == pytest.approx(b[c], rel=1e-6, abs=1e-8)


def test_boosted_trees_are_those_of_spark(parts, monkeypatch):
    train, test = parts
    # No deeper: in nodes of a few rows several features split alike, and the last bit of a sum decides.
    settings = SETTINGS[train_boosted_trees] | {"max_depth": 3}
    expected = train_boosted_trees(train, **settings)
    monkeypatch.setattr(models, "LEAST_FIT_ROWS", 1)
    # Blocks of which a partition has several.
    monkeypatch.setattr(histograms, "BLOCK_ROWS", 700)
    found = train_boosted_trees(train, **settings)
    same(nodes(found), nodes(expected))
    both = [sorted(predict(m, test).collect()) for m in (found, expected)]
    assert [r["prediction"] for r in both[0]] == [r["prediction"] for r in both[1]]
    assert [r["probability"] for r in both[0]] == pytest.approx([r["probability"] for r in both[1]])
    assert found.stages[-1].treeWeights == expected.stages[-1].treeWeights
    for name in ("maxIter", "maxDepth", "maxBins", "stepSize", "weightCol"):
        assert found.stages[-1].getOrDefault(name) == expected.stages[-1].getOrDefault(name)


def test_a_tree_on_all_rows_and_features_is_that_of_spark(spark, parts):
    train, _ = parts
    counts = class_counts(train)
    weight = balanced_weight(*counts)
    settings = {"featuresCol": "features", "labelCol": "label", "weightCol": "_weight", "numTrees": 1, "maxDepth": 6,
                "maxBins": 32, "featureSubsetStrategy": "all", "seed": 1}
    assembler = VectorAssembler(inputCols=list(ALL_FEATURES), outputCol="features")
    whole = RandomForestClassifier(bootstrap=False, **settings)
    expected = Pipeline(stages=[assembler, whole]).fit(train.withColumn("_weight", weight))
    weights = tuple(sum(counts) / (2.0 * n) for n in counts)
    cuts, n_bins, blocks = histograms._prepared(train, ALL_FEATURES, weight, counts, float(sum(counts)), 32, 1)
    tree, = histograms.grow_forest(blocks, n_bins, weights, 1, 6, len(ALL_FEATURES), None)
    rows = histograms._stored_nodes(tree, 0, cuts, histograms._majority)
    found = histograms._in_pipeline(
        train, ALL_FEATURES, RandomForestClassifier, RandomForestClassificationModel, settings, rows, [1.0])
    same(nodes(found), nodes(expected))


def test_a_forest_draws_rows_and_features(matrix, parts, monkeypatch, tmp_path):
    train, test = parts
    spark_made = train_random_forest(train, **SETTINGS[train_random_forest])
    monkeypatch.setattr(models, "LEAST_FIT_ROWS", 1)
    found = train_random_forest(train, **SETTINGS[train_random_forest])
    areas = [metrics.evaluate_model("m", predict(m, test)).first()["roc_auc"] for m in (found, spark_made)]
    assert areas[0] > 0.6 and areas[0] == pytest.approx(areas[1], abs=0.03)
    roots = [r for r in nodes(found) if r["node"] == 0]
    assert len(roots) == 20 and len({r["rows"] for r in roots}) > 10 and len({r["feature"] for r in roots}) > 2
    n = train.count()
    assert all(abs(r["rows"] - n) < 6 * n**0.5 for r in roots)
    # The same rows give the same forest, also when its trees grow in jobs of one each.
    monkeypatch.setattr(histograms, "JOB_BYTES", 1)
    again = train_random_forest(prepare_data(matrix)[0], **SETTINGS[train_random_forest])
    assert nodes(again) == nodes(found)
    save_model(found, str(tmp_path / "m"))
    assert sorted(predict(load_model(str(tmp_path / "m")), test).collect()) == sorted(predict(found, test).collect())
    assert found.stages[-1].getNumTrees == 20


def test_draws_have_the_poisson_distribution():
    rows, times = histograms._drawn(1, 2, 3, 400_000)
    assert len(np.unique(rows)) == len(rows)
    shares = np.bincount(times.astype(int), minlength=8) / 400_000
    shares[0] = 1 - len(rows) / 400_000
    upto = np.concatenate([[0.0], histograms._DRAWN_UPTO])
    assert shares[:8] == pytest.approx(np.diff(upto)[:8], abs=0.003)
    assert times.max() > 5


@pytest.mark.parametrize("fit", list(SETTINGS))
def test_large_tables_are_not_fitted_with_a_store_per_tree(parts, monkeypatch, fit):
    """Spark's fits keep every tree's draws and nodes for each row, or walk the rows as objects."""
    train, test = parts

    def refuse(**_):
        raise AssertionError("fitted by Spark")

    monkeypatch.setattr(models, "LEAST_FIT_ROWS", 1)
    monkeypatch.setattr(models, "GBTClassifier", refuse)
    monkeypatch.setattr(models, "RandomForestClassifier", refuse)
    model = fit(train, **SETTINGS[fit])
    assert predict(model, test).filter("probability BETWEEN 0 AND 1").count() == test.count()
    left = train.sparkSession.sparkContext._jsc.getPersistentRDDs()
    assert len(left) == 0


@pytest.mark.parametrize("fit", list(SETTINGS))
def test_missing_values_are_refused(parts, monkeypatch, fit):
    monkeypatch.setattr(models, "LEAST_FIT_ROWS", 1)
    train, _ = parts
    holed = train.withColumn(ALL_FEATURES[3], F.when(F.col("job_id") % 100 != 0, F.col(ALL_FEATURES[3])))
    with pytest.raises(Exception, match="null or NaN"):
        fit(holed, **SETTINGS[fit])


def test_one_job_takes_a_bounded_number_of_trees():
    wanted = [[1, 2, 3], [1], [], [1, 2], [1] * 9]
    per_node = histograms.JOB_BYTES // 4
    assert histograms._batches(wanted, per_node) == [[0, 1], [3], [4]]


def test_models_that_share_passes_are_those_fitted_alone(spark, matrix, parts, monkeypatch):
    """Folds and ablations: other rows, other features and other weights in the same passes."""
    monkeypatch.setattr(models, "LEAST_FIT_ROWS", 1)
    train, test = parts
    settings = {"n_estimators": 3, "max_depth": 3, "max_bins": 32}
    calls = [
        partial(train_boosted_trees, train, **settings),
        partial(train_boosted_trees, train, features=experiments.without(ALL_FEATURES, ALL_FEATURES[5]), **settings),
        partial(train_boosted_trees, test, scale_pos_weight=1.5, **settings),
    ]
    made = []
    fit_boosted = histograms.fit_boosted
    monkeypatch.setattr(histograms, "fit_boosted", lambda asked: made.append(len(asked)) or fit_boosted(asked))
    together = experiments.fit_jobs(calls, spark, 2)
    assert made == [3]
    for call, model in zip(calls, together):
        same(nodes(model), nodes(call()))
    fit = partial(train_boosted_trees, **settings)
    made.clear()
    assert experiments.fold_scores(fit, matrix, 2, threads=2).filter("roc_auc > 0.55").count() == 2
    assert experiments.run_ablation_study(train, test, threads=2, **settings).count() == 6
    assert made == [2, 7]
