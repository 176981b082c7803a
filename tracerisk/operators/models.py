"""Training, scoring and inspection of the three model families."""

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracerisk.operators import histograms
from tracerisk.operators.split import (
    LEAST_FIT_ROWS,
    balanced_weight,
    class_counts,
    positive_scale,
    positive_weight,
)
from tracerisk.schema import ALL_FEATURES, TASK_KEY
from tracerisk.sources.shared import new_path
from tracerisk.sources.tables import load_model, save_model

_WEIGHT = "_weight"


def _assembler(features: Sequence[str], output: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=output)


def standard_scaler(features: Sequence[str], n_rows: int, output: str = "features") -> Pipeline:
    """Centre and divide by the population deviation, as an unfitted pipeline.

    Spark's scaler divides by the sample deviation; the last step corrects that.
    """
    factor = math.sqrt(n_rows / (n_rows - 1)) if n_rows > 1 else 1.0
    return Pipeline(
        stages=[
            _assembler(features, "raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="centred", withMean=True),
            ElementwiseProduct(
                inputCol="centred", outputCol=output, scalingVec=Vectors.dense([factor] * len(features))
            ),
        ]
    )


def scaled_columns(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Columns scaled by a fitted `standard_scaler`, under their own names."""
    scaled = model.transform(df).withColumn("_v", vector_to_array("features"))
    columns = {c: F.col("_v")[i] for i, c in enumerate(features)}
    return scaled.withColumns(columns).select(*df.columns)


def scale_columns(train: DataFrame, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Columns of `df` less the mean over the population deviation of `train`, from one aggregate.

    A column without deviation becomes 0, as in `standard_scaler`.
    """
    moments = [x for c in features for x in (F.avg(c), F.stddev_pop(c))]
    found = train.agg(*[m.alias(f"m{i}") for i, m in enumerate(moments)]).first()
    scaled = {}
    for i, c in enumerate(features):
        mean, deviation = found[2 * i], found[2 * i + 1]
        scaled[c] = (F.col(c) - mean) / deviation if deviation else F.lit(0.0)
    return df.withColumns(scaled)


def _without_summary(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The same model without its training summary, by way of the shared folder.

    The summary of a binary classifier holds the session, which goes with the model into the tasks that
    score; once any metrics of the session were observed, it can't be sent there.
    """
    path = new_path(spark)
    save_model(model, path)
    return load_model(path)


def train_logistic_regression(
    train: DataFrame, features: Sequence[str] = tuple(ALL_FEATURES), max_iter: int = 1000
) -> PipelineModel:
    """Logistic regression with balanced classes on scaled features.

    The loss is the weighted mean, so regParam 1 / (sum of weights) stands for an
    L2 penalty of strength 1 on the weighted sum; balanced weights sum to n.
    """
    negatives, positives = class_counts(train)
    n = negatives + positives
    classifier = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol=_WEIGHT,
        maxIter=max_iter,
        regParam=1.0 / n,
        elasticNetParam=0.0,
        standardization=False,
    )
    stages = [*standard_scaler(features, n).getStages(), classifier]
    weighted = train.withColumn(_WEIGHT, balanced_weight(negatives, positives))
    return _without_summary(Pipeline(stages=stages).fit(weighted), train.sparkSession)


def _by_histograms(train: DataFrame, counts: tuple[int, int], max_bins: int) -> bool:
    """Whether a tree model is grown by `histograms`: on many rows a core, of both labels, and bins of one byte."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    return sum(counts) >= cores * LEAST_FIT_ROWS and min(counts) > 0 and max_bins <= 256


def train_random_forest(
    train: DataFrame,
    features: Sequence[str] = tuple(ALL_FEATURES),
    n_estimators: int = 100,
    max_depth: int = 10,
    seed: int = 42,
    max_bins: int = 256,
) -> PipelineModel:
    """Random forest with balanced classes; a large table's is grown by `histograms`, with other random draws."""
    counts = class_counts(train)
    weight = balanced_weight(*counts)
    settings = {
        "featuresCol": "features",
        "labelCol": "label",
        "weightCol": _WEIGHT,
        "numTrees": n_estimators,
        "maxDepth": max_depth,
        "maxBins": max_bins,
        "featureSubsetStrategy": "sqrt",
        "seed": seed,
        # A row keeps its node of every tree; else each pass walks it down all trees from their roots.
        "cacheNodeIds": True,
    }
    if _by_histograms(train, counts, max_bins):
        weights = tuple(sum(counts) / (2.0 * n) for n in counts)
        return histograms.fit_forest(train, features, weight, counts, weights, settings)
    stages = [_assembler(features, "features"), RandomForestClassifier(**settings)]
    return _without_summary(Pipeline(stages=stages).fit(train.withColumn(_WEIGHT, weight)), train.sparkSession)


def ask_boosted_trees(
    train: DataFrame,
    features: Sequence[str] = tuple(ALL_FEATURES),
    n_estimators: int = 100,
    max_depth: int = 6,
    learning_rate: float = 0.1,
    seed: int = 42,
    max_bins: int = 256,
    scale_pos_weight: float | None = None,
) -> tuple:
    """What a fit of boosted trees takes: rows, features, weight, rows per label, weight of label 1 and settings."""
    counts = class_counts(train)
    if scale_pos_weight is None:
        scale_pos_weight = positive_scale(*counts)
    settings = {
        "featuresCol": "features",
        "labelCol": "label",
        "weightCol": _WEIGHT,
        "maxIter": n_estimators,
        "maxDepth": max_depth,
        "stepSize": learning_rate,
        "maxBins": max_bins,
        "seed": seed,
    }
    return train, features, positive_weight(scale_pos_weight), counts, scale_pos_weight, settings


def fit_together(asked: Sequence[tuple]) -> list[PipelineModel] | None:
    """Boosted trees of several models in the same passes; None where `histograms` grows not all of them, or not alike."""
    alike = {tuple(a[-1][c] for c in ("maxIter", "maxDepth", "stepSize")) for a in asked}
    large = [a[4] > 0 and _by_histograms(a[0], a[3], a[-1]["maxBins"]) for a in asked]
    return histograms.fit_boosted(asked) if all(large) and len(alike) == 1 else None


def train_boosted_trees(
    train: DataFrame,
    features: Sequence[str] = tuple(ALL_FEATURES),
    n_estimators: int = 100,
    max_depth: int = 6,
    learning_rate: float = 0.1,
    seed: int = 42,
    max_bins: int = 256,
    scale_pos_weight: float | None = None,
) -> PipelineModel:
    """Gradient-boosted trees; failures weigh negatives per positive unless given.

    On a large table the trees are grown by `histograms`.
    """
    asked = ask_boosted_trees(
        train, features, n_estimators, max_depth, learning_rate, seed, max_bins, scale_pos_weight
    )
    if found := fit_together([asked]):
        return found[0]
    stages = [_assembler(features, "features"), GBTClassifier(**asked[-1])]
    return Pipeline(stages=stages).fit(train.withColumn(_WEIGHT, asked[2]))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predicted class and probability of label 1, with task key and label where present."""
    kept = [c for c in (*TASK_KEY, "label") if c in df.columns]
    probability = vector_to_array("probability")[1].alias("probability")
    return model.transform(df).select(*kept, "prediction", probability)


def _features_of(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def get_feature_importance(model: PipelineModel) -> DataFrame:
    """Features of a tree model by falling importance."""
    values = model.stages[-1].featureImportances.toArray()
    return _ranked(_features_of(model), values, "importance").orderBy(F.desc("importance"))


def get_coefficients(model: PipelineModel) -> DataFrame:
    """Coefficients of a logistic regression by falling absolute value, with their direction."""
    values = model.stages[-1].coefficients.toArray()
    ranked = _ranked(_features_of(model), values, "coefficient")
    direction = F.when(F.col("coefficient") > 0, "raises risk").otherwise("lowers risk")
    return ranked.withColumn("direction", direction).orderBy(F.abs("coefficient").desc())


def penalised_gradient(model: PipelineModel, train: DataFrame) -> DataFrame:
    """Gradient of a logistic regression's objective at the fit: one row per feature and the intercept.

    The objective is the weighted mean log loss plus regParam / 2 times the squared
    coefficients, of scaled features. It is convex, so entries of 0 certify the optimum.
    All entries come from one aggregate over the train rows.
    """
    fitted, names = model.stages[-1], _features_of(model)
    weighted = train.withColumn(_WEIGHT, balanced_weight(*class_counts(train)))
    scored = model.transform(weighted).select(
        _WEIGHT,
        vector_to_array("features").alias("_x"),
        (F.col(_WEIGHT) * (vector_to_array("probability")[1] - F.col("label"))).alias("_r"),
    )
    sums = [F.sum(F.col("_r") * F.col("_x")[i]).alias(f"g{i}") for i in range(len(names))]
    row = scored.agg(*sums, F.sum("_r").alias("g"), F.sum(_WEIGHT).alias("w")).first()
    beta = fitted.coefficients.toArray()
    entries = [row[f"g{i}"] / row["w"] + fitted.getRegParam() * beta[i] for i in range(len(names))]
    return _ranked([*names, "(intercept)"], [*entries, row["g"] / row["w"]], "gradient")


def _ranked(names: Sequence[str], values, column: str) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return SparkSession.active().createDataFrame(rows, f"feature string, {column} double")
