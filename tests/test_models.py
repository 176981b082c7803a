"""Models on separable data: sane, stable, and better with the telling feature."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tracerisk import (
    get_coefficients,
    get_feature_importance,
    load_model,
    predict,
    prepare_data,
    prepare_tables,
    report_results,
    run_ablation_study,
    run_cross_validation,
    save_model,
    train_boosted_trees,
    train_logistic_regression,
    train_random_forest,
)
from tracerisk.catalog import queries
from tracerisk.operators import experiments, metrics, models, split
from tracerisk.schema import ALL_FEATURES, NOVEL_FEATURES, RAW_FEATURES, TASK_KEY
from tracerisk.sources import materialize

SMALL = {
    "Logistic Regression": {"max_iter": 20},
    "Random Forest": {"n_estimators": 5, "max_depth": 4, "max_bins": 32},
    "Boosted Trees": {"n_estimators": 3, "max_depth": 3, "max_bins": 32},
}
TREES = {"n_estimators": 10, "max_depth": 3, "max_bins": 32}


@pytest.fixture(scope="module")
def matrix(spark):
    rng = random.Random(5)
    rows = []
    for i in range(800):
        label = int(rng.random() < 0.25)
        values = [rng.gauss(0, 1) for _ in ALL_FEATURES]
        values[ALL_FEATURES.index("execution_duration_sec")] += 3 * label
        rows.append((i, 0, 1, *values, label))
    names = ["job_id long", "task_index int", "machine_id long"]
    schema = ", ".join([*names, *[f"{c} double" for c in ALL_FEATURES], "label int"])
    return materialize(spark.createDataFrame(rows, schema))


@pytest.fixture(scope="module")
def parts(matrix):
    return prepare_data(matrix)


@pytest.mark.parametrize("rounds", [1, 3])
def test_fits_read_as_many_even_parts_as_there_are_cores(spark, monkeypatch, rounds):
    """Whatever the session's shuffle partitions: one more than the cores would take a second round."""
    cores = spark.sparkContext.defaultParallelism
    n = cores * split.LEAST_FIT_ROWS * rounds
    monkeypatch.setattr(split, "FIT_ROWS", split.LEAST_FIT_ROWS)
    tasks = spark.range(n).select(
        F.col("id").alias("job_id"), F.lit(0).alias("task_index"), (F.col("id") % 4 == 0).cast("int").alias("label")
    )
    train, test = prepare_data(tasks)
    for part, rows in ((train, n * 4 // 5), (test, n // 5)):
        assert (part.count(), part.distinct().count()) == (rows, rows)
    sizes = [r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect()]
    assert train.rdd.getNumPartitions() == len(sizes) == cores
    assert max(sizes) < 1.1 * min(sizes)
    files = train.select(F.input_file_name()).distinct().count()
    assert files == cores * rounds


def test_small_tables_stay_in_one_part(spark, parts):
    assert parts[0].rdd.getNumPartitions() == 1


def auc(model, test):
    return metrics.evaluate_model("m", predict(model, test)).first()["roc_auc"]


def test_models_score_after_metrics_were_observed(parts):
    """The session then holds what can't be sent to tasks, and a training summary holds the session."""
    train, test = parts
    seen = Observation()
    train.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == train.count()
    for family, fit in experiments.FAMILIES.items():
        assert predict(fit(train, **SMALL[family]), test).filter("probability BETWEEN 0 AND 1").count() == test.count()


def test_scaler_uses_population_deviation(parts):
    train, _ = parts
    scaler = models.standard_scaler(ALL_FEATURES, train.count()).fit(train)
    row = models.scaled_columns(scaler, train, ALL_FEATURES).agg(
        *[F.avg(c) for c in ALL_FEATURES], *[F.stddev_pop(c) for c in ALL_FEATURES]
    ).first()
    assert list(row[:12]) == pytest.approx([0.0] * 12, abs=1e-9)
    assert list(row[12:]) == pytest.approx([1.0] * 12, abs=1e-9)


def test_logistic_regression_minimises_the_penalised_loss(parts):
    """Newton steps on the balanced, L2-penalised loss end at the same coefficients."""
    train, test = parts
    model = train_logistic_regression(train)
    rows = train.select(*ALL_FEATURES, "label").toPandas()
    x = rows[ALL_FEATURES].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    y = rows["label"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    x1 = np.hstack([x, np.ones((len(y), 1))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    beta = np.zeros(x1.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x1 @ beta))
        gradient = x1.T @ (w * (p - y)) + penalty @ beta
        hessian = (x1 * (w * p * (1 - p))[:, None]).T @ x1 + penalty
        beta -= np.linalg.solve(hessian, gradient)
    fitted = model.stages[-1]
    assert fitted.coefficients.toArray() == pytest.approx(beta[:-1], abs=1e-4)
    assert fitted.intercept == pytest.approx(beta[-1], abs=1e-4)
    assert auc(model, test) > 0.9
    top = get_coefficients(model).first()
    assert top["feature"] == "execution_duration_sec" and top["direction"] == "raises risk"


@pytest.mark.parametrize("fit", [train_random_forest, train_boosted_trees])
def test_trees(matrix, parts, fit, tmp_path):
    train, test = parts
    model = fit(train, **TREES)
    assert auc(model, test) > 0.9
    again = fit(prepare_data(matrix)[0], **TREES)
    assert sorted(predict(again, test).collect()) == sorted(predict(model, test).collect())
    importance = get_feature_importance(model)
    assert importance.first()["feature"] == "execution_duration_sec"
    assert sum(r["importance"] for r in importance.collect()) == pytest.approx(1.0)
    raw = fit(train, features=RAW_FEATURES, **TREES)
    assert auc(raw, test) < auc(model, test)

    path = str(tmp_path / "new" / "model")
    save_model(model, path)
    again = predict(load_model(path), test)
    assert sorted(again.collect()) == sorted(predict(model, test).collect())
    assert again.columns == [*TASK_KEY, "label", "prediction", "probability"]


def test_a_forest_keeps_the_node_of_every_row(parts, monkeypatch):
    train, test = parts
    model = train_random_forest(train, **TREES)
    assert model.stages[-1].getCacheNodeIds()

    def walking(**settings):
        return RandomForestClassifier(**(settings | {"cacheNodeIds": False}))

    monkeypatch.setattr(models, "RandomForestClassifier", walking)
    walked = train_random_forest(train, **TREES)
    assert not walked.stages[-1].getCacheNodeIds()
    assert sorted(predict(walked, test).collect()) == sorted(predict(model, test).collect())


def test_ablation(parts):
    study = run_ablation_study(*parts, **TREES)
    rows = study.collect()
    assert {r["removed_feature"] for r in rows} == set(NOVEL_FEATURES)
    assert rows[0]["removed_feature"] == "execution_duration_sec" and rows[0]["f1_drop"] > 0
    marked = experiments.ablation_plot_data(study).first()
    assert marked["high_impact"]


def test_cross_validation(matrix):
    def fit(train):
        return train_boosted_trees(train, **TREES)

    scores = experiments.fold_scores(fit, matrix, 3)
    assert sorted(r["fold"] for r in scores.collect()) == [0, 1, 2]
    summary = {r["metric"]: r for r in experiments.summarize_folds(scores).collect()}
    f1 = [r["f1"] for r in scores.collect()]
    assert summary["f1"]["mean"] == pytest.approx(sum(f1) / 3)
    assert summary["f1"]["std"] == pytest.approx(math.sqrt(np.var(f1)))
    assert set(summary) == set(experiments.METRICS)
    assert run_cross_validation(fit, matrix, 2).count() == 4


def test_improvements(spark):
    rows = [(f, g, f"{f} ({g})", 0.0, 0.0, 0.0, 0.5 + 0.1 * i, 0.6)
            for i, (f, g) in enumerate(experiments.grid())]
    names = "family string, feature_group string, model string, accuracy double, " \
            "precision double, recall double, f1 double, roc_auc double"
    found = {
        (r["from_model"], r["to_model"]): r
        for r in experiments.improvement_summary(spark.createDataFrame(rows, names)).collect()
    }
    assert len(found) == len(experiments.GAINS)
    first = found["Logistic Regression (raw)", "Logistic Regression (all)"]
    assert first["f1_gain"] == pytest.approx(0.1)
    assert first["f1_gain_percent"] == pytest.approx(20.0)


def test_from_files_to_results(spark, small, tmp_path):
    """Trace files to result tables, all stages written and read back."""
    from tracerisk.catalog.queries import raw_e
    from tracerisk.schema import COLUMNS

    raw_e(spark, small).select(*COLUMNS).write.csv(str(tmp_path / "trace"))
    tables = prepare_tables(
        spark, str(tmp_path / "trace"), str(tmp_path / "out"), None, 21_600, 3_600
    )
    assert tables["feature_matrix"].count() == tables["tasks_labelled"].count() > 0
    results = report_results(tables["feature_matrix"], str(tmp_path / "res"), SMALL, n_splits=2)
    assert results["model_results"].count() == 6
    saved = sorted(p.name for p in (tmp_path / "res" / "models").iterdir())
    assert len(saved) == 6
    assert spark.read.option("header", True).csv(str(tmp_path / "res" / "paired_ttest")).count() == 1


def test_queries_fit_only_the_models_they_read(spark, parts, monkeypatch):
    """The query of one family fits that family, not all six models."""
    fitted = []

    def fit_with(key, fit):
        def run(train):
            fitted.append(key)
            return fit(train)

        return run

    small = experiments.grid(SMALL)
    grid = {key: fit_with(key, fit) for key, fit in small.items()}
    monkeypatch.setattr(queries.experiments, "grid", lambda: grid)
    monkeypatch.setattr(queries, "_train_test", lambda *_: parts)
    monkeypatch.setattr(queries, "_SHARED", {})
    named = queries.queries()
    assert named["lr_coefficients"](spark, "t").count() == len(ALL_FEATURES)
    assert fitted == [("Logistic Regression", "all")]
    assert named["confusion_plot"](spark, "t").count() == 8
    assert named["lr_predictions"](spark, "t").count() == parts[1].count()
    others = [("Boosted Trees", "all"), ("Logistic Regression", "raw")]
    assert sorted(fitted) == sorted([("Logistic Regression", "all"), *others])
