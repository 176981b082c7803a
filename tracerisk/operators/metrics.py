"""Classification metrics from scored tasks.

Scored tasks have `label`, `prediction` and `probability`. They are counted per
score first; every metric then reads that table, written once in score order.

With `by`, columns such as the model and the fold, everything is per group: many
models are measured in the same few jobs, however many there are and however large each is.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracerisk.functions import two_sided_p
from tracerisk.operators.ranges import in_ranges
from tracerisk.operators.skew import sized
from tracerisk.sources.shared import materialize

RATES = ["accuracy", "precision", "recall", "f1"]


def score_table(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tasks of either label per group, probability and prediction, in ranges of falling probability."""
    label = F.col("label")
    counts = scored.groupBy(*by, "probability", "prediction").agg(
        F.count_if(label == 1).alias("positives"), F.count_if(label == 0).alias("negatives")
    )
    return in_ranges(counts, [*by, F.col("probability").desc()])


def _total(col: str, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col(col))), F.lit(0))


def confusion_counts(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True and false negatives and positives in one row (per group)."""
    hit = F.col("prediction") == 1
    return scores.groupBy(*by).agg(
        _total("negatives", ~hit).alias("tn"),
        _total("negatives", hit).alias("fp"),
        _total("positives", ~hit).alias("fn"),
        _total("positives", hit).alias("tp"),
    )


def confusion_matrix(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The four counts as one row per label and prediction (and group)."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    rows = [
        F.struct(
            F.lit(label).alias("label"),
            F.lit(prediction).alias("prediction"),
            F.col(name).alias("n_tasks"),
        )
        for label, prediction, name in cells
    ]
    return confusion_counts(scores, by).select(*by, F.inline(F.array(*rows)))


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where nothing is to be divided by."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def _rates(hit: str, false_hit: str, miss: str) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of one class."""
    tp, fp, fn = F.col(hit), F.col(false_hit), F.col(miss)
    return _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)


def _accuracy() -> Column:
    right = F.col("tn") + F.col("tp")
    return _ratio(right, right + F.col("fn") + F.col("fp"))


def _all_rates() -> list[Column]:
    return [c.alias(n) for n, c in zip(RATES, (_accuracy(), *_rates("tp", "fp", "fn")))]


def classification_metrics(scores: DataFrame, name: str) -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC-AUC in one row."""
    return confusion_counts(scores).select(
        F.lit(name).alias("model"), *_all_rates(), roc_auc(scores).scalar().alias("roc_auc")
    )


def _same_group(by: Sequence[str], other: str) -> Column:
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in by])


def classification_metrics_by(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC-AUC of every group of a score table made with `by`."""
    areas = roc_auc(scores, by).select(*[F.col(c).alias(f"_a_{c}") for c in by], "roc_auc")
    rates = confusion_counts(scores, by).select(*by, *_all_rates())
    return rates.join(areas, _same_group(by, "_a_")).select(*by, *RATES, "roc_auc")


def evaluate_model(name: str, scored: DataFrame) -> DataFrame:
    """Metrics of one scored frame."""
    return classification_metrics(score_table(scored), name)


def classification_report(scores: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages."""
    kinds = ["precision", "recall", "f1"]
    sides = {"0": ("tn", "fn", "fp"), "1": ("tp", "fp", "fn")}
    rates = [
        rate.alias(f"{kind}_{side}")
        for side, cols in sides.items()
        for kind, rate in zip(kinds, _rates(*cols))
    ]
    negatives, positives = F.col("tn") + F.col("fp"), F.col("tp") + F.col("fn")
    counted = confusion_counts(scores).select(
        *rates, negatives.alias("n_0"), positives.alias("n_1"), _accuracy().alias("accuracy")
    )
    total = F.col("n_0") + F.col("n_1")
    nothing = F.lit(None).cast("double")

    def row(name, values, support):
        named = [v.alias(k) for k, v in zip(kinds, values)]
        return F.struct(F.lit(name).alias("class"), *named, support.alias("support"))

    def average(kind, weight_0, weight_1):
        return F.col(f"{kind}_0") * weight_0 + F.col(f"{kind}_1") * weight_1

    half = F.lit(0.5)
    shares = [_ratio(F.col("n_0"), total), _ratio(F.col("n_1"), total)]
    rows = [
        row("0", [F.col(f"{k}_0") for k in kinds], F.col("n_0")),
        row("1", [F.col(f"{k}_1") for k in kinds], F.col("n_1")),
        row("accuracy", [nothing, nothing, F.col("accuracy")], total),
        row("macro avg", [average(k, half, half) for k in kinds], total),
        row("weighted avg", [average(k, *shares) for k in kinds], total),
    ]
    return counted.select(F.inline(F.array(*rows)))


def _ranked(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group and probability: tasks of either label at it and above it, and of the whole group.

    Also `chunk`, the range that holds the probability. A group may span many
    ranges, and a range many groups; each range of a group gets the totals of those before it.
    """
    by = list(by)
    piece = [*by, "chunk"]
    by_score = scores.groupBy(*piece, "probability").agg(
        F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives")
    )
    # No more rows than ranges plus groups.
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = every.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = scores.groupBy(*piece).agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
    offsets = sizes.select(
        *[F.col(c).alias(f"_o_{c}") for c in piece],
        F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.sum("p").over(every).alias("all_positives"),
        F.sum("n").over(every).alias("all_negatives"),
    )
    offsets = sized(materialize(offsets)) if by else F.broadcast(offsets)
    upto = (
        Window.partitionBy(*piece)
        .orderBy(F.col("probability").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = by_score.withColumns(
        {"p_upto": F.sum("positives").over(upto), "n_upto": F.sum("negatives").over(upto)}
    )
    return local.join(offsets, _same_group(piece, "_o_")).select(
        *piece,
        "probability",
        "positives",
        "negatives",
        (F.col("p_before") + F.col("p_upto")).alias("tp"),
        (F.col("n_before") + F.col("n_upto")).alias("fp"),
        "all_positives",
        "all_negatives",
    )


def _corners(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    """The points where the curve's step changes, and each group's first and last.

    A point goes if the step to it is the step to the next. The next point of a range's
    last one is the first of the following range of the group: one row per range is exchanged.
    """
    piece = [*by, "chunk"]
    step = F.struct("positives", "negatives")
    ranked = materialize(ranked)
    firsts = ranked.groupBy(*piece).agg(F.max_by(step, "probability").alias("_first"))
    later = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("chunk")
    borders = firsts.select(
        *[F.col(c).alias(f"_b_{c}") for c in piece], F.lead("_first").over(later).alias("_border")
    )
    along = Window.partitionBy(*piece).orderBy(F.col("probability").desc())
    with_next = ranked.withColumn("_next", F.lead(step).over(along))
    with_next = with_next.join(sized(materialize(borders)), _same_group(piece, "_b_"))
    following = F.coalesce("_next", "_border")
    first = (F.col("tp") == F.col("positives")) & (F.col("fp") == F.col("negatives"))
    return with_next.filter(first | following.isNull() | (following != step)).select(*ranked.columns)


def roc_points(scores: DataFrame, by: Sequence[str] = (), drop_intermediate: bool = False) -> DataFrame:
    """False and true positive rate at every distinct probability, from (0, 0) on (per group).

    With `drop_intermediate`, points between two equal steps are left out, which
    changes neither the curve nor its area.
    """
    by = list(by)
    ranked = _ranked(scores, by)
    points = (_corners(ranked, by) if drop_intermediate else ranked).select(
        *by,
        F.col("probability").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("all_negatives")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("all_positives")).alias("tpr"),
    )
    groups = scores.select(*by).distinct() if by else scores.sparkSession.range(1)
    start = groups.select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(points)


def roc_auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve (per group); equal probabilities count half."""
    above = F.col("tp") - F.col("positives")
    ordered = F.col("negatives") * (above + F.col("positives") / 2)
    pairs = F.max(F.col("all_positives").cast("double") * F.col("all_negatives"))
    area = F.try_divide(F.sum(ordered), pairs).alias("roc_auc")
    return _ranked(scores, by).groupBy(*by).agg(area)


def operational_impact(scores: DataFrame) -> DataFrame:
    """Failures caught and missed, false alarms, each also in percent."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion_counts(scores).select(
        (tn + fp + fn + tp).alias("n_tasks"),
        (tp + fn).alias("failures"),
        tp.alias("caught"),
        fn.alias("missed"),
        fp.alias("false_alarms"),
        (_ratio(tp, tp + fn) * 100).alias("caught_percent"),
        (_ratio(fn, tp + fn) * 100).alias("missed_percent"),
        (_ratio(fp, fp + tn) * 100).alias("false_alarm_percent"),
    )


def run_paired_ttest(folds: DataFrame, level: float = 0.05) -> DataFrame:
    """Paired t-test of the columns `best` and `baseline`, one row per fold."""
    gap = F.col("best") - F.col("baseline")
    moments = folds.agg(
        F.count(gap).alias("n"), F.avg(gap).alias("mean_gap"), F.stddev_samp(gap).alias("sd")
    )
    statistic = F.try_divide(F.col("mean_gap"), F.col("sd") / F.sqrt("n"))
    tested = moments.withColumn("t_statistic", statistic)
    p_value = two_sided_p(F.col("t_statistic"), F.col("n") - 1)
    return tested.withColumn("p_value", p_value).select(
        "n", "mean_gap", "t_statistic", "p_value", (F.col("p_value") < level).alias("significant")
    )
