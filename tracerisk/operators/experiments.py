"""Model comparison, ablation and cross-validation."""

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracerisk.operators.metrics import (
    classification_metrics_by,
    confusion_matrix,
    roc_points,
    score_table,
)
from tracerisk.operators.models import (
    ask_boosted_trees,
    fit_together,
    predict,
    train_boosted_trees,
    train_logistic_regression,
    train_random_forest,
)
from tracerisk.operators.split import laid_out, stratified_folds
from tracerisk.schema import ALL_FEATURES, NOVEL_FEATURES, RAW_FEATURES
from tracerisk.sources.shared import materialize

Fit = Callable[..., PipelineModel]

FAMILIES: dict[str, Fit] = {
    "Logistic Regression": train_logistic_regression,
    "Random Forest": train_random_forest,
    "Boosted Trees": train_boosted_trees,
}
GROUPS = {"raw": RAW_FEATURES, "all": ALL_FEATURES}
METRICS = ["f1", "roc_auc", "precision", "recall"]

# Pairs of models whose gain is reported: raw to all features, then across families.
GAINS = [
    *[((family, "raw"), (family, "all")) for family in FAMILIES],
    (("Logistic Regression", "raw"), ("Random Forest", "all")),
    (("Logistic Regression", "raw"), ("Boosted Trees", "all")),
    (("Random Forest", "all"), ("Boosted Trees", "all")),
]


def in_parallel(jobs: Iterable[Callable], spark: SparkSession, threads: int) -> list:
    """Run independent fits from a few driver threads, so that they share the cluster."""
    with ThreadPool(threads) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), list(jobs))


def fit_jobs(jobs: Sequence[partial], spark: SparkSession, threads: int) -> list[PipelineModel]:
    """The models of several calls of `train_*`; boosted trees on large tables share their passes over the rows."""
    if all(isinstance(job, partial) and job.func is train_boosted_trees for job in jobs):
        asked = in_parallel([partial(ask_boosted_trees, *job.args, **job.keywords) for job in jobs], spark, threads)
        if fitted := fit_together(asked):
            return fitted
    return in_parallel(jobs, spark, threads)


def scored_groups(scored: Mapping[tuple, DataFrame], by: Sequence[str]) -> DataFrame:
    """Scored frames under one another, `by` naming the parts of their keys."""
    out = None
    for key, frame in scored.items():
        values = key if isinstance(key, tuple) else (key,)
        named = frame.withColumns({c: F.lit(v) for c, v in zip(by, values)})
        out = named if out is None else out.unionByName(named)
    return out


def measured_groups(scored: Mapping[tuple, DataFrame], by: Sequence[str]) -> DataFrame:
    """Metrics of all scored frames, from one score table: the jobs don't grow with the models."""
    scores = score_table(scored_groups(scored, by), by)
    return materialize(classification_metrics_by(scores, by))


def grid(settings: Mapping[str, dict] | None = None) -> dict[tuple[str, str], Fit]:
    """The six fits: every family on raw and on all features."""
    settings = settings or {}
    return {
        (family, group): partial(fit, features=features, **settings.get(family, {}))
        for family, fit in FAMILIES.items()
        for group, features in GROUPS.items()
    }


def fit_all(
    train: DataFrame, settings: Mapping[str, dict] | None = None, threads: int = 2
) -> dict[tuple[str, str], PipelineModel]:
    """The six fitted models by family and feature group."""
    fits = grid(settings)
    jobs = [partial(fit, train) for fit in fits.values()]
    return dict(zip(fits, in_parallel(jobs, train.sparkSession, threads)))


def compare_models(
    train: DataFrame,
    test: DataFrame,
    settings: Mapping[str, dict] | None = None,
    threads: int = 2,
    fitted: Mapping[tuple[str, str], PipelineModel] | None = None,
) -> DataFrame:
    """Metrics of the six models. `settings` passes arguments to the families by name.

    Models by family and feature group may be given instead of fitting them here.
    """
    fitted = fit_all(train, settings, threads) if fitted is None else fitted
    return compared({key: predict(model, test) for key, model in fitted.items()})


def compared(scored: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """Metrics of scored frames by family and feature group."""
    by = ["family", "feature_group"]
    name = F.format_string("%s (%s)", *by).alias("model")
    found = measured_groups(scored, by)
    return found.select(*by, name, *[c for c in found.columns if c not in by])


def improvement_summary(comparison: DataFrame) -> DataFrame:
    """Gains in F1 and ROC-AUC, absolute and in percent, for the pairs in GAINS."""
    pairs = comparison.sparkSession.createDataFrame(
        [(*a, *b) for a, b in GAINS],
        "family string, feature_group string, to_family string, to_group string",
    )
    start = comparison.select(
        "family",
        "feature_group",
        F.col("model").alias("from_model"),
        F.col("f1").alias("f1_from"),
        F.col("roc_auc").alias("auc_from"),
    )
    end = comparison.select(
        F.col("family").alias("to_family"),
        F.col("feature_group").alias("to_group"),
        F.col("model").alias("to_model"),
        F.col("f1").alias("f1_to"),
        F.col("roc_auc").alias("auc_to"),
    )
    joined = pairs.join(start, ["family", "feature_group"]).join(end, ["to_family", "to_group"])
    gains = [
        expr
        for m in ("f1", "auc")
        for expr in (
            F.col(f"{m}_from"),
            F.col(f"{m}_to"),
            (F.col(f"{m}_to") - F.col(f"{m}_from")).alias(f"{m}_gain"),
            F.try_divide(
                (F.col(f"{m}_to") - F.col(f"{m}_from")) * 100, F.col(f"{m}_from")
            ).alias(f"{m}_gain_percent"),
        )
    ]
    return joined.select("from_model", "to_model", *gains)


def without(features: Sequence[str], removed: str) -> list[str]:
    """The feature list less one."""
    return [f for f in features if f != removed]


def run_ablation_study(
    train: DataFrame,
    test: DataFrame,
    novel_features: Sequence[str] = tuple(NOVEL_FEATURES),
    all_features: Sequence[str] = tuple(ALL_FEATURES),
    baseline: tuple[float, float] | None = None,
    threads: int = 2,
    **settings,
) -> DataFrame:
    """F1 and ROC-AUC of boosted trees without each novel feature, largest F1 drop first.

    `baseline` holds F1 and ROC-AUC of the full model; it is fitted here if not given.
    """
    removed = list(novel_features) if baseline else ["", *novel_features]
    jobs = [
        partial(train_boosted_trees, train, features=without(all_features, f), **settings) for f in removed
    ]
    fitted = fit_jobs(jobs, train.sparkSession, threads)
    measured = measured_groups(
        {f: predict(model, test) for f, model in zip(removed, fitted)}, ["removed_feature"]
    )
    if baseline is None:
        full = measured.filter("removed_feature = ''").first()
        baseline = full["f1"], full["roc_auc"]
    return feature_drops(measured.filter("removed_feature != ''"), baseline)


def feature_drops(measured: DataFrame, baseline: tuple[float, float]) -> DataFrame:
    """F1 and ROC-AUC without each feature and how far they lie below the baseline, largest F1 drop first."""
    f1, auc = baseline
    return measured.select(
        "removed_feature",
        "f1",
        (F.lit(float(f1)) - F.col("f1")).alias("f1_drop"),
        F.col("roc_auc").alias("auc"),
        (F.lit(float(auc)) - F.col("roc_auc")).alias("auc_drop"),
    ).orderBy(F.desc("f1_drop"), "removed_feature")


def fold_scores(
    fit: Fit, matrix: DataFrame, n_splits: int = 5, seed: int = 42, threads: int = 2
) -> DataFrame:
    """Metrics per fold, each fold scored by a model fitted to the others."""
    # As before other seeded fits, so that results don't depend on the plan.
    folds = laid_out(stratified_folds(matrix, n_splits, seed), matrix.count())
    inside = F.col("fold")
    jobs = [partial(fit, folds.filter(inside != i).drop("fold")) for i in range(n_splits)]
    fitted = fit_jobs(jobs, matrix.sparkSession, threads)
    scored = {i: predict(model, folds.filter(inside == i)) for i, model in enumerate(fitted)}
    return measured_groups(scored, ["fold"]).select("fold", *METRICS)


def summarize_folds(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of every metric over the folds."""
    return (
        scores.unpivot("fold", METRICS, "metric", "value")
        .groupBy("metric")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    )


def run_cross_validation(
    fit: Fit, matrix: DataFrame, n_splits: int = 5, seed: int = 42, threads: int = 2
) -> DataFrame:
    """Stratified k-fold cross-validation: mean and deviation per metric."""
    return summarize_folds(fold_scores(fit, matrix, n_splits, seed, threads))


def paired_scores(best: DataFrame, baseline: DataFrame, metric: str = "f1") -> DataFrame:
    """Metric of two models side by side, per fold."""
    return best.select("fold", F.col(metric).alias("best")).join(
        baseline.select("fold", F.col(metric).alias("baseline")), "fold"
    )


def roc_plot_data(scored: Mapping[str, DataFrame]) -> DataFrame:
    """ROC points of several models' scored rows, with the model name."""
    return roc_points(score_table(scored_groups(scored, ["model"]), ["model"]), ["model"])


def confusion_plot_data(scored: Mapping[str, DataFrame]) -> DataFrame:
    """Confusion matrices of several models' scored rows, with the model name."""
    return confusion_matrix(score_table(scored_groups(scored, ["model"]), ["model"]), ["model"])


def ablation_plot_data(ablation: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Ablation rows with `high_impact` where F1 drops by more than the threshold."""
    return ablation.withColumn("high_impact", F.col("f1_drop") > threshold)
