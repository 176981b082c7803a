"""Named queries over the test tables, one or more per operator.

Names ending in `_events` use the `events` adapter (nulls, several attempts,
out-of-order submits), as do the small profiling and model queries; the others
use the larger `lineitem` adapter. Windows fit the density of each.
"""

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracerisk.operators import (
    clean,
    experiments,
    features,
    labels,
    metrics,
    models,
    profile,
    sketches,
    skew,
    split,
    trees,
)
from tracerisk.operators.quantiles import exact_quantiles
from tracerisk.plans import matrix as plans
from tracerisk.schema import (
    ALL_FEATURES,
    COLUMNS,
    DATA_COLUMNS,
    EVENT_NO,
    NOVEL_FEATURES,
    RAW_FEATURES,
    RESOURCES,
    SEQ,
    TASK_KEY,
)
from tracerisk.sources import (
    load_model,
    load_trace_parts,
    materialize,
    read_table,
    rejected_rows,
    rows_per_part as count_per_part,
    save_model,
    write_result,
    write_table,
)
from tracerisk.sources.adapters import line_partitions, trace_from_events, trace_from_lineitem
from tracerisk.sources.buckets import buckets_for, write_by_task
from tracerisk.sources.ledger import load_new_parts, read_ledger
from tracerisk.sources.shared import new_path
from tracerisk.streaming import (
    read_stream,
    run_to_end,
    stream_schedules_per_slot,
    stream_waiting_priority,
    write_end_mark,
)

EVENTS_SLOT, EVENTS_WAITING = 21_600, 3_600
LINES_SLOT, LINES_WAITING = 604_800, 60

# Fits that run side by side.
FIT_THREADS = 4
PREDICTION_FRAMES = {
    "lr_prediction_frame": "Logistic Regression",
    "rf_prediction_frame": "Random Forest",
    "gbt_prediction_frame": "Boosted Trees",
}

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, since sums depend on the order of rows; no negative zero."""
    return df.select(
        *[
            (F.round(f.name, 6) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def raw_e(spark, folder):
    return trace_from_events(spark, folder, copies=True)


def clean_e(spark, folder):
    return clean.clean_trace(raw_e(spark, folder))


def clean_l(spark, folder):
    # The adapter joins two tables on the job. Cleaning first reads the keys alone, then the rows where they lie.
    n = line_partitions(spark, folder)
    return clean.clean_trace(trace_from_lineitem(spark, folder, n), by=["job_id"], parts=n)


def matrix_e(spark, folder):
    return plans.matrix_of_trace(raw_e(spark, folder), EVENTS_SLOT, EVENTS_WAITING)


def matrix_l(spark, folder):
    n = line_partitions(spark, folder)
    raw = trace_from_lineitem(spark, folder, n)
    return plans.matrix_of_trace(raw, LINES_SLOT, LINES_WAITING, by=["job_id"], parts=n)


# Cleaning


@query
def trace_parts(spark, folder):
    """The trace written as gzipped header-less CSV parts and loaded again."""
    path = new_path(spark)
    raw_e(spark, folder).select(*COLUMNS).write.option("compression", "gzip").csv(path)
    return load_trace_parts(spark, path).select(*COLUMNS)


def _three_parts(spark, folder):
    """The trace in three CSV parts, the rest of the position by three giving the part."""
    path = new_path(spark)
    raw = raw_e(spark, folder).repartitionById(3, (F.col(SEQ) % 3).cast("int"))
    raw.select(*COLUMNS).write.csv(path)
    return path


@query
def rows_per_part(spark, folder):
    counted = count_per_part(spark, _three_parts(spark, folder))
    return counted.select(F.substring("part", 1, 10).alias("part"), "n_rows")


@query
def trace_first_parts(spark, folder):
    """The first two of three parts, in name order."""
    return load_trace_parts(spark, _three_parts(spark, folder), n_parts=2).select(*COLUMNS)


@query
def trace_rejected(spark, folder):
    """Rows that the strict loader refuses: every seventh has a text for a machine."""
    path = new_path(spark)
    text = {c: F.col(c).cast("string") for c in COLUMNS}
    text["machine_id"] = F.when(F.col(SEQ) % 7 == 0, "none").otherwise(text["machine_id"])
    raw_e(spark, folder).select(*[v.alias(c) for c, v in text.items()]).write.csv(path)
    fields = F.split("record", ",")
    bad = rejected_rows(spark, path)
    return bad.select(fields[0].cast("long").alias("timestamp"), fields[2].cast("long").alias("job_id"))


def _table_roundtrip(fmt):
    def run(spark, folder):
        path = new_path(spark)
        table = clean_trace_events(spark, folder)
        write_table(table, path, fmt)
        return read_table(spark, path, fmt, table.schema)

    return run


for _fmt in ("parquet", "csv"):
    _QUERIES[f"table_roundtrip_{_fmt}"] = _table_roundtrip(_fmt)


@query
def result_roundtrip(spark, folder):
    """A result table written as one CSV file and read again."""
    path = new_path(spark)
    table = event_distribution(spark, folder)
    write_result(table, path)
    return read_table(spark, path, "csv", table.schema)


@query
def clean_trace_ranges(spark, folder):
    """Cleaning with every task of over 20 rows counted as large, so that its timeline is cut into ranges."""
    cleaned = clean.clean_trace(raw_e(spark, folder), hot_rows=20)
    return cleaned.select(*DATA_COLUMNS, "event_label", EVENT_NO)


@query
def clean_trace(spark, folder):
    return clean_l(spark, folder).select(*DATA_COLUMNS, "event_label", EVENT_NO)


@query
def clean_trace_events(spark, folder):
    return clean_e(spark, folder).select(*DATA_COLUMNS, "event_label", EVENT_NO)


@query
def dedupe_events(spark, folder):
    return clean.drop_duplicate_events(raw_e(spark, folder)).select(*DATA_COLUMNS, SEQ)


@query
def ffill_resources(spark, folder):
    keyed = clean.drop_missing_keys(clean.drop_duplicate_events(raw_e(spark, folder)))
    return clean.forward_fill(keyed).select(*TASK_KEY, "timestamp", EVENT_NO, *RESOURCES)


@query
def event_labels(spark, folder):
    return clean.decode_events(raw_e(spark, folder)).select(SEQ, "event_type", "event_label")


@query
def cleaning_summary(spark, folder):
    return clean.cleaning_summary(raw_e(spark, folder))


@query
def cleaning_counts(spark, folder):
    """What cleaning removes, counted while the cleaned events are written."""
    counts = clean.CleaningCounts()
    materialize(clean.clean_trace(raw_e(spark, folder), counts=counts))
    found = counts.get()
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{c} long" for c in found))


@query
def incremental_parts(spark, folder):
    """Two of three parts loaded, then the rest: as if all were loaded at once."""
    parts, table = _three_parts(spark, folder), new_path(spark)
    load_new_parts(spark, parts, table, n_parts=2)
    return load_new_parts(spark, parts, table).select(*COLUMNS)


@query
def part_ledger(spark, folder):
    parts, table = _three_parts(spark, folder), new_path(spark)
    load_new_parts(spark, parts, table, n_parts=2)
    load_new_parts(spark, parts, table)
    return read_ledger(spark, table).select(F.substring("part", 1, 10).alias("part"), "no", "n_rows", "load")


# Labels

_LABELLED = [*DATA_COLUMNS, "event_label", "label"]


@query
def task_labels(spark, folder):
    return labels.create_labels(clean_l(spark, folder)).select(*_LABELLED)


@query
def task_labels_events(spark, folder):
    return labels.create_labels(clean_e(spark, folder)).select(*_LABELLED)


@query
def label_distribution(spark, folder):
    return rounded(labels.label_distribution(labels.create_labels(clean_l(spark, folder))))


@query
def label_distribution_events(spark, folder):
    return rounded(labels.label_distribution(labels.create_labels(clean_e(spark, folder))))


# Features


@query
def scheduling_delay(spark, folder):
    return features.calculate_scheduling_delay(clean_l(spark, folder))


@query
def scheduling_delay_events(spark, folder):
    return features.calculate_scheduling_delay(clean_e(spark, folder))


@query
def execution_duration(spark, folder):
    events = materialize(clean_l(spark, folder))
    return features.calculate_execution_duration(events, labels.create_labels(events))


@query
def execution_duration_events(spark, folder):
    events = materialize(clean_e(spark, folder))
    return features.calculate_execution_duration(events, labels.create_labels(events))


@query
def negative_times(spark, folder):
    events = materialize(clean_e(spark, folder))
    return features.removed_negative_times(events, labels.create_labels(events))


@query
def machine_failure_rate(spark, folder):
    return rounded(features.calculate_machine_failure_rate(clean_l(spark, folder)))


@query
def machine_failure_rate_events(spark, folder):
    return rounded(features.calculate_machine_failure_rate(clean_e(spark, folder)))


@query
def concurrency_density(spark, folder):
    return features.calculate_concurrency_density(
        materialize(clean_l(spark, folder)), LINES_SLOT
    )


@query
def concurrency_density_events(spark, folder):
    return features.calculate_concurrency_density(
        materialize(clean_e(spark, folder)), EVENTS_SLOT
    )


@query
def resource_overcommit(spark, folder):
    events = materialize(clean_l(spark, folder))
    return rounded(features.calculate_resource_overcommit(events))


@query
def resource_overcommit_events(spark, folder):
    events = materialize(clean_e(spark, folder))
    return rounded(features.calculate_resource_overcommit(events))


@query
def priority_gap(spark, folder):
    return features.calculate_priority_gap(materialize(clean_l(spark, folder)), LINES_WAITING)


@query
def priority_gap_events(spark, folder):
    return features.calculate_priority_gap(materialize(clean_e(spark, folder)), EVENTS_WAITING)


@query
def priority_inversion_flag(spark, folder):
    events = materialize(clean_l(spark, folder))
    return features.calculate_priority_inversion(events, LINES_WAITING)


@query
def priority_inversion_flag_events(spark, folder):
    events = materialize(clean_e(spark, folder))
    return features.calculate_priority_inversion(events, EVENTS_WAITING)


def _rate_before(make, **settings):
    def run(spark, folder):
        events = materialize(make(spark, folder))
        return rounded(features.calculate_machine_failure_rate_before(events, **settings))

    return run


_QUERIES |= {
    "machine_rate_before": _rate_before(clean_l),
    "machine_rate_before_events": _rate_before(clean_e),
    # Every machine of over 50 times counted as large, so that its timeline is cut into ranges.
    "machine_rate_before_ranges": _rate_before(clean_e, hot_rows=50),
}


@query
def task_times_by_bucket(spark, folder):
    """Label, delay and duration of every labelled task, from events stored by task: no shuffle after that."""
    buckets = buckets_for(trace_from_lineitem(spark, folder).count(), least=16)
    events = spark.table(write_by_task(clean_l(spark, folder), buckets=buckets))
    labelled = labels.create_labels(events).select(*TASK_KEY, "timestamp", "label")
    delay = features.calculate_scheduling_delay(events)
    duration = features.calculate_execution_duration(events, labelled)
    joined = labelled.drop("timestamp").join(delay, TASK_KEY, "left").join(duration, TASK_KEY, "left")
    return rounded(joined)


# Streaming forms of the window tables


def _streamed(make, window):
    """The cleaned events as a folder of files, streamed to its end."""

    def run(spark, folder):
        path, out = new_path(spark), new_path(spark)
        events = clean_l(spark, folder).select(*TASK_KEY, "timestamp", "machine_id", "event_type", "priority")
        events.write.parquet(path)
        write_end_mark(spark, path, events.schema)
        result = make(read_stream(spark, path, events.schema), window)
        run_to_end(result, out, new_path(spark))
        return spark.read.schema(result.schema).parquet(out)

    return run


_QUERIES |= {
    "stream_slots": _streamed(stream_schedules_per_slot, LINES_SLOT),
    "stream_waiting": _streamed(stream_waiting_priority, LINES_WAITING),
}


@query
def feature_matrix(spark, folder):
    return rounded(matrix_l(spark, folder))


@query
def feature_matrix_events(spark, folder):
    return rounded(matrix_e(spark, folder))


@query
def feature_matrix_joined(spark, folder):
    """The matrix put together from the six feature tables."""
    events = materialize(clean_e(spark, folder))
    labelled = labels.create_labels(events)
    return rounded(
        plans.build_feature_matrix(
            labelled,
            features.calculate_scheduling_delay(events),
            features.calculate_execution_duration(events, labelled),
            features.calculate_machine_failure_rate(events),
            features.calculate_concurrency_density(events, EVENTS_SLOT),
            features.calculate_resource_overcommit(events),
            features.calculate_priority_gap(events, EVENTS_WAITING),
        )
    )


# Features by label


def _by_label(make, col):
    def run(spark, folder):
        events = materialize(clean_l(spark, folder))
        labelled = labels.create_labels(events)
        joined = materialize(profile.with_label(make(events, labelled), labelled))
        return rounded(profile.stats_by_label(joined, col))

    return run


_FEATURE_TABLES = {
    "delay": (
        lambda ev, _: features.calculate_scheduling_delay(ev),
        "scheduling_delay_sec",
    ),
    "duration": (features.calculate_execution_duration, "execution_duration_sec"),
    "concurrency": (
        lambda ev, _: features.calculate_concurrency_density(ev, LINES_SLOT),
        "concurrency_density",
    ),
    "overcommit": (
        lambda ev, _: features.calculate_resource_overcommit(ev),
        "resource_overcommit_ratio",
    ),
    "priority_gap": (
        lambda ev, _: features.calculate_priority_gap(ev, LINES_WAITING),
        "priority_inversion_flag",
    ),
}
for _name, (_make, _col) in _FEATURE_TABLES.items():
    _QUERIES[f"{_name}_by_label"] = _by_label(_make, _col)


@query
def machine_rate_by_label(spark, folder):
    """Failure rate of the final machine of every labelled task, per label."""
    events = materialize(clean_l(spark, folder))
    rates, small = skew.stage_lookup(features.calculate_machine_failure_rate(events))
    tasks = labels.create_labels(events).select(*TASK_KEY, "machine_id", "label")
    joined = skew.lookup(tasks, rates, ["machine_id"], small=small)
    return rounded(profile.stats_by_label(materialize(joined), "machine_failure_rate"))


@query
def raw_feature_means(spark, folder):
    labelled = labels.create_labels(clean_e(spark, folder))
    return rounded(profile.means_by_label(labelled, RAW_FEATURES))


def _flags(spark, folder):
    events = materialize(clean_e(spark, folder))
    flags = features.calculate_priority_inversion(events, EVENTS_WAITING)
    return flags, profile.with_label(flags, labels.create_labels(events))


@query
def inversion_crosstab(spark, folder):
    _, flags = _flags(spark, folder)
    return profile.crosstab(flags, "label", "priority_inversion_flag")


@query
def inversion_pivot(spark, folder):
    _, flags = _flags(spark, folder)
    return profile.counts_by_flag(flags)


@query
def inversion_rate(spark, folder):
    _, flags = _flags(spark, folder)
    return rounded(profile.flag_rates(flags))


@query
def inversion_distribution(spark, folder):
    flags, _ = _flags(spark, folder)
    return rounded(profile.flag_distribution(flags))


@query
def machine_rate_bands(spark, folder):
    rates = features.calculate_machine_failure_rate(clean_e(spark, folder))
    return features.machine_rate_bands(rates)


# Exploration


@query
def missing_summary(spark, folder):
    return rounded(profile.get_missing_summary(raw_e(spark, folder).select(*COLUMNS)))


@query
def clean_missing_summary(spark, folder):
    cleaned = clean_e(spark, folder).select(*DATA_COLUMNS, "event_label")
    return rounded(profile.get_missing_summary(cleaned))


@query
def cpu_nulls_by_event(spark, folder):
    return profile.nulls_by_event(raw_e(spark, folder))


@query
def event_distribution(spark, folder):
    return profile.event_distribution(raw_e(spark, folder))


@query
def final_event_distribution(spark, folder):
    return profile.event_distribution(labels.final_events(clean_e(spark, folder)))


@query
def scheduling_class_distribution(spark, folder):
    return profile.value_distribution(raw_e(spark, folder), "scheduling_class")


@query
def priority_distribution(spark, folder):
    return profile.value_distribution(raw_e(spark, folder), "priority")


@query
def describe_features(spark, folder):
    return rounded(profile.describe(materialize(matrix_e(spark, folder)), ALL_FEATURES))


@query
def describe_features_volume(spark, folder):
    return rounded(profile.describe(materialize(matrix_l(spark, folder)), ALL_FEATURES))


@query
def describe_machine_rate(spark, folder):
    rates = features.calculate_machine_failure_rate(clean_l(spark, folder))
    return rounded(profile.describe(materialize(rates), ["machine_failure_rate"]))


@query
def describe_slots(spark, folder):
    slots = features.schedules_per_slot(clean_l(spark, folder), LINES_SLOT)
    return rounded(profile.describe(materialize(slots), ["concurrency_density"]))


@query
def describe_waiting_priority(spark, folder):
    waiting = features.waiting_priority(clean_e(spark, folder), EVENTS_WAITING)
    return rounded(profile.describe(materialize(waiting), ["max_waiting_priority"]))


def _histogram(col, upper):
    """Of values rounded first: a last bit may not decide on which side of an edge they fall."""

    def run(spark, folder):
        values = materialize(rounded(matrix_l(spark, folder).select(col)))
        return rounded(profile.histogram(values, col, 50, upper))

    return run


# Upper bounds where the distribution is cut off for display (fixed values).
_HISTOGRAMS = {
    "histogram_delay": ("scheduling_delay_sec", 500),
    "histogram_duration": ("execution_duration_sec", 1000),
    "histogram_machine_rate": ("machine_failure_rate", None),
    "histogram_concurrency": ("concurrency_density", 150),
    "histogram_overcommit": ("resource_overcommit_ratio", 10),
    "histogram_priority_gap": ("priority_inversion_flag", None),
}
for _name, (_col, _upper) in _HISTOGRAMS.items():
    _QUERIES[_name] = _histogram(_col, _upper)


@query
def histogram_priority(spark, folder):
    raw = raw_e(spark, folder).select("priority")
    return rounded(profile.histogram(raw, "priority", 12))


@query
def histogram_cpu(spark, folder):
    return rounded(profile.histogram(rounded(raw_e(spark, folder)), "cpu_requested", 30))


SKETCH_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query
def sketched_quantiles(spark, folder):
    """Sketches per label merged into one per feature: whether quantiles lie within twice the error of a rank.

    A quantile is within if one of the exact quantiles at its probability, less or plus that error, is no
    greater and the other no less.
    """
    matrix = materialize(matrix_l(spark, folder))
    parts = materialize(sketches.quantile_sketches(matrix, ALL_FEATURES, ["label"]))
    found = sketches.sketched_quantiles(sketches.merge_quantile_sketches(parts), SKETCH_PROBS)
    found = found.withColumn("prob", F.round("prob", 6))
    error = 2 * sketches.rank_error()
    exact = None
    for name, shift in (("low", -error), ("high", error)):
        moved = {round(p, 6): min(max(p + shift, 0.0), 1.0) for p in SKETCH_PROBS}
        back = F.array(*[F.struct(F.lit(q).alias("at"), F.lit(p).alias("p")) for p, q in moved.items()])
        at = exact_quantiles(matrix, ALL_FEATURES, list(moved.values()))
        # A probability comes back as the double that was given.
        of = F.get(F.filter(back, lambda x: x["at"] == F.col("prob")), F.lit(0))["p"]
        side = at.select("feature", of.alias("prob"), F.col("value").alias(name))
        exact = side if exact is None else exact.join(side, ["feature", "prob"])
    within = (F.col("low") <= F.col("value")) & (F.col("value") <= F.col("high"))
    return found.join(exact, ["feature", "prob"]).select("feature", "prob", "n", within.alias("within"))


@query
def sketched_task_counts(spark, folder):
    """Distinct tasks by sketches of the event types, united: within four standard errors; the whole adds nothing."""
    events = materialize(clean_l(spark, folder).select(*TASK_KEY, "event_type"))
    parts = materialize(sketches.distinct_sketches(events, TASK_KEY, ["event_type"]))
    whole = sketches.distinct_sketches(events, TASK_KEY)
    more = sketches.merge_distinct_sketches(parts.select("sketch").unionByName(whole))
    united = sketches.sketched_counts(sketches.merge_distinct_sketches(parts)).scalar()
    exact = events.agg(F.count_distinct(*TASK_KEY).alias("n_tasks"))
    error = F.abs(united - F.col("n_tasks")) / F.col("n_tasks")
    return exact.select(
        "n_tasks",
        (error <= 4 * sketches.distinct_error()).alias("within"),
        (united == sketches.sketched_counts(more).scalar()).alias("as_of_whole"),
    )


@query
def boxplot_duration(spark, folder):
    matrix = materialize(matrix_l(spark, folder).select("label", "execution_duration_sec"))
    return rounded(profile.boxplot_stats(matrix, ["execution_duration_sec"]))


@query
def boxplot_features(spark, folder):
    matrix = materialize(matrix_e(spark, folder))
    return rounded(profile.boxplot_stats(matrix, NOVEL_FEATURES))


@query
def feature_label_corr(spark, folder):
    return rounded(profile.feature_label_correlation(matrix_e(spark, folder), ALL_FEATURES))


@query
def feature_label_corr_volume(spark, folder):
    return rounded(profile.feature_label_correlation(matrix_l(spark, folder), ALL_FEATURES))


@query
def corr_matrix(spark, folder):
    matrix = materialize(matrix_e(spark, folder))
    return rounded(profile.correlation_matrix(matrix, [*ALL_FEATURES, "label"]))


@query
def corr_matrix_volume(spark, folder):
    matrix = materialize(matrix_l(spark, folder))
    return rounded(profile.correlation_matrix(matrix, [*ALL_FEATURES, "label"]))


@query
def stage_summary(spark, folder):
    events = materialize(clean_e(spark, folder))
    return rounded(profile.stage_summary(events, labels.create_labels(events)))


@query
def trace_shape(spark, folder):
    return profile.shape(raw_e(spark, folder).select(*COLUMNS))


@query
def trace_head(spark, folder):
    return profile.head(raw_e(spark, folder).select(SEQ, *COLUMNS), [SEQ])


# Split, folds, weights, scaling


def _labelled_tasks(spark, folder):
    return materialize(labels.create_labels(clean_l(spark, folder)).select(*TASK_KEY, "label"))


@query
def stratified_split(spark, folder):
    tasks = _labelled_tasks(spark, folder)
    return split.stratified_split(tasks)


@query
def split_distribution(spark, folder):
    tasks = _labelled_tasks(spark, folder)
    return split.split_distribution(split.stratified_split(tasks))


@query
def stratified_folds(spark, folder):
    tasks = _labelled_tasks(spark, folder)
    return split.stratified_folds(tasks)


@query
def class_weights(spark, folder):
    return rounded(split.class_weights(labels.create_labels(clean_l(spark, folder))))


@query
def standard_scale(spark, folder):
    """All rows of the matrix, scaled with mean and deviation of the train rows."""
    parts = split.stratified_split(materialize(matrix_l(spark, folder)))
    scaled = models.scale_columns(parts.filter(F.col("split") == "train"), parts, ALL_FEATURES)
    return rounded(scaled.select(*TASK_KEY, "split", *ALL_FEATURES))


# Metrics of a fixed score


def scored_l(spark, folder):
    """Matrix rows scored by duration and concurrency, x / (x + 5000)."""
    x = F.col("execution_duration_sec") + 100 * F.col("concurrency_density")
    probability = x / (x + 5000.0)
    return matrix_l(spark, folder).select(
        *TASK_KEY,
        "label",
        "priority",
        probability.alias("probability"),
        (probability >= 0.5).cast("double").alias("prediction"),
    )


def _scores(spark, folder):
    return metrics.score_table(scored_l(spark, folder))


@query
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_scores(spark, folder))


@query
def classification_metrics(spark, folder):
    return rounded(metrics.evaluate_model("fixed score", scored_l(spark, folder)))


@query
def classification_report(spark, folder):
    return rounded(metrics.classification_report(_scores(spark, folder)))


@query
def roc_points(spark, folder):
    return rounded(metrics.roc_points(_scores(spark, folder)))


@query
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(_scores(spark, folder)))


@query
def operational_impact(spark, folder):
    return rounded(metrics.operational_impact(_scores(spark, folder)))


@query
def paired_ttest(spark, folder):
    """F1 per fold of the fixed score against a rule on the priority alone."""
    folds = split.stratified_folds(materialize(scored_l(spark, folder)))
    truth, best = F.col("label") == 1, F.col("prediction") == 1
    rule = F.col("priority") >= 3

    def f1(hit):
        tp, wrong = F.count_if(truth & hit), F.count_if(truth != hit)
        return F.try_divide(2.0 * tp, 2 * tp + wrong)

    scores = folds.groupBy("fold").agg(f1(best).alias("best"), f1(rule).alias("baseline"))
    return rounded(metrics.run_paired_ttest(scores))


# Six fixed rules in place of the six models: what compares, folds, ablates and plots
# models is checked on them. A rule scores x / (x + half), so it predicts 1 from half on.

SCORE_RULES = {
    ("Logistic Regression", "raw"): ("priority", 3.0),
    ("Logistic Regression", "all"): ("scheduling_delay_sec", 25.0),
    ("Random Forest", "raw"): ("memory_requested", 0.04),
    ("Random Forest", "all"): ("concurrency_density", 2.0),
    ("Boosted Trees", "raw"): ("disk_requested", 0.00025),
    ("Boosted Trees", "all"): ("execution_duration_sec", 5000.0),
}
# The rule that stands for the full model in the ablation; the others for it less one feature.
FULL_RULE = ("Boosted Trees", "all")


def _ruled(spark, folder):
    """The folds of the matrix, once written, scored by every rule."""
    wanted = [*TASK_KEY, "label", *[c for c, _ in SCORE_RULES.values()]]
    matrix = materialize(matrix_l(spark, folder).select(*wanted))
    folds = materialize(split.stratified_folds(matrix))
    scored = {}
    for rule, (column, half) in SCORE_RULES.items():
        probability = F.col(column) / (F.col(column) + half)
        scored[rule] = folds.select(
            *TASK_KEY,
            "label",
            "fold",
            probability.alias("probability"),
            (probability >= 0.5).cast("double").alias("prediction"),
        )
    return scored


def _named_rules(spark, folder):
    return {f"{family} ({group})": frame for (family, group), frame in _ruled(spark, folder).items()}


def _rule_groups(spark, folder):
    by = ["model", "fold"]
    named = experiments.scored_groups(_named_rules(spark, folder), ["model"])
    return metrics.score_table(named, by), by


@query
def roc_auc_by_group(spark, folder):
    """Area under the curve of six rules in five folds, in one pass."""
    return rounded(metrics.roc_auc(*_rule_groups(spark, folder)))


@query
def metrics_by_group(spark, folder):
    return rounded(metrics.classification_metrics_by(*_rule_groups(spark, folder)))


@query
def rule_comparison(spark, folder):
    return rounded(experiments.compared(_ruled(spark, folder)))


@query
def rule_improvement(spark, folder):
    return rounded(experiments.improvement_summary(experiments.compared(_ruled(spark, folder))))


@query
def rule_ablation(spark, folder):
    """Drops of the other rules against the full one, and whether they are high."""
    measured = experiments.measured_groups(_ruled(spark, folder), ["family", "feature_group"])
    name = F.format_string("%s (%s)", "family", "feature_group").alias("removed_feature")
    full = (F.col("family") == FULL_RULE[0]) & (F.col("feature_group") == FULL_RULE[1])
    row = measured.filter(full).first()
    drops = experiments.feature_drops(measured.filter(~full).select(name, "f1", "roc_auc"), (row["f1"], row["roc_auc"]))
    return rounded(experiments.ablation_plot_data(drops))


@query
def rule_cross_validation(spark, folder):
    """Mean and deviation over the folds of the full rule."""
    scores = metrics.score_table(_ruled(spark, folder)[FULL_RULE], ["fold"])
    return rounded(experiments.summarize_folds(metrics.classification_metrics_by(scores, ["fold"])))


@query
def rule_roc_plot(spark, folder):
    return rounded(experiments.roc_plot_data(_named_rules(spark, folder)))


@query
def rule_confusion_plot(spark, folder):
    return experiments.confusion_plot_data(_named_rules(spark, folder))


@query
def roc_corners(spark, folder):
    """The ROC curves of the rules less the points between two equal steps."""
    named = experiments.scored_groups(_named_rules(spark, folder), ["model"])
    scores = metrics.score_table(named, ["model"])
    return rounded(metrics.roc_points(scores, ["model"], drop_intermediate=True))


# Models, in the package's own settings on the larger matrix. Queries over the same
# tables share the split and the fits: a model is fitted once per session and folder.

_SHARED: dict[tuple, object] = {}


def _once(spark, folder, what, make):
    key = (spark.sparkContext.applicationId, folder, what)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def _train_test(spark, folder):
    return _once(spark, folder, "split", lambda: split.prepare_data(matrix_l(spark, folder)))


def _fits(spark, folder, wanted):
    """Fitted models by family and feature group: those wanted, each fitted once."""
    train, _ = _train_test(spark, folder)
    fits = experiments.grid()
    jobs = [partial(_once, spark, folder, ("fit", *key), partial(fits[key], train)) for key in wanted]
    return dict(zip(wanted, experiments.in_parallel(jobs, spark, FIT_THREADS)))


def _fitted(spark, folder, family, group="all"):
    return _fits(spark, folder, [(family, group)])[family, group]


def _predicted(spark, folder, family, group="all"):
    _, test = _train_test(spark, folder)
    return models.predict(_fitted(spark, folder, family, group), test)


def _comparison(spark, folder):
    train, test = _train_test(spark, folder)
    fitted = _fits(spark, folder, list(experiments.grid()))
    return _once(
        spark, folder, "comparison", partial(experiments.compare_models, train, test, fitted=fitted)
    )


@query
def lr_coefficients(spark, folder):
    return models.get_coefficients(_fitted(spark, folder, "Logistic Regression"))


@query
def rf_importance(spark, folder):
    return models.get_feature_importance(_fitted(spark, folder, "Random Forest"))


@query
def gbt_importance(spark, folder):
    return models.get_feature_importance(_fitted(spark, folder, "Boosted Trees"))


@query
def lr_gradient(spark, folder):
    """Gradient of the objective at the fitted logistic regression, to four places."""
    train, _ = _train_test(spark, folder)
    found = models.penalised_gradient(_fitted(spark, folder, "Logistic Regression"), train)
    return found.select("feature", (F.round("gradient", 4) + F.lit(0.0)).alias("gradient"))


@query
def gbt_split_gains(spark, folder):
    """Splits and their gain per feature of the boosted trees."""
    return trees.split_gains(_fitted(spark, folder, "Boosted Trees"))


# Columns of few values: each is a bin of its own, so a tree tries every split that SQL can.
STUMP_FEATURES = ["scheduling_class", "priority", "different_machine"]


@query
def stump_gain(spark, folder):
    """The split of one boosted tree of one level, with unit weights: its feature, threshold, rows and gain."""
    tasks = labels.create_labels(clean_l(spark, folder)).select(*TASK_KEY, "label", *STUMP_FEATURES)
    one_split = {"n_estimators": 1, "max_depth": 1, "scale_pos_weight": 1.0}
    nodes = trees.tree_nodes(models.train_boosted_trees(materialize(tasks), STUMP_FEATURES, **one_split))
    root = nodes.filter("node = 0").select("feature", "threshold", "rows", "weight", "impurity", "gain")
    return rounded(root)


@query
def lr_predictions(spark, folder):
    return _predicted(spark, folder, "Logistic Regression")


@query
def rf_predictions(spark, folder):
    return _predicted(spark, folder, "Random Forest")


@query
def gbt_predictions(spark, folder):
    return _predicted(spark, folder, "Boosted Trees")


def _frame(family):
    """What SQL can tell of predictions: the rows, their labels, and that class and probability agree."""

    def run(spark, folder):
        probability = F.col("probability")
        return _predicted(spark, folder, family).select(
            *TASK_KEY,
            "label",
            (F.col("prediction") == (probability > 0.5).cast("double")).alias("consistent"),
            probability.between(0, 1).alias("in_range"),
        )

    return run


for _name, _family in PREDICTION_FRAMES.items():
    _QUERIES[_name] = _frame(_family)


@query
def model_roundtrip(spark, folder):
    """A fitted model saved and loaded: rows predicted, and rows predicted otherwise than before."""
    path = new_path(spark)
    save_model(_fitted(spark, folder, "Boosted Trees"), path)
    before = _predicted(spark, folder, "Boosted Trees")
    _, test = _train_test(spark, folder)
    after = models.predict(load_model(path), test).withColumnRenamed("probability", "again")
    joined = before.join(after.select(*TASK_KEY, "again"), TASK_KEY)
    return joined.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("probability") != F.col("again")).alias("n_changed")
    )


@query
def model_comparison(spark, folder):
    return _comparison(spark, folder)


@query
def improvement_summary(spark, folder):
    return experiments.improvement_summary(_comparison(spark, folder))


@query
def ablation(spark, folder):
    # The same row as in the comparison, which takes the other five fits as well.
    key = "Boosted Trees", "all"
    full = experiments.compared({key: _predicted(spark, folder, *key)}).first()
    study = experiments.run_ablation_study(
        *_train_test(spark, folder), baseline=(full["f1"], full["roc_auc"]), threads=FIT_THREADS
    )
    return experiments.ablation_plot_data(study)


def _fold_scores(spark, folder, family, group):
    train, test = _train_test(spark, folder)
    scored = partial(
        experiments.fold_scores,
        experiments.grid()[family, group],
        train.unionByName(test),
        threads=FIT_THREADS,
    )
    return _once(spark, folder, ("folds", family, group), scored)


@query
def cross_validation(spark, folder):
    return experiments.summarize_folds(_fold_scores(spark, folder, "Boosted Trees", "all"))


@query
def cross_validation_ttest(spark, folder):
    best = _fold_scores(spark, folder, "Boosted Trees", "all")
    baseline = _fold_scores(spark, folder, "Logistic Regression", "raw")
    return metrics.run_paired_ttest(experiments.paired_scores(best, baseline))


def _two_scored(spark, folder):
    _, test = _train_test(spark, folder)
    fitted = _fits(spark, folder, [("Boosted Trees", "all"), ("Logistic Regression", "raw")])
    return {f"{family} ({group})": models.predict(model, test) for (family, group), model in fitted.items()}


@query
def roc_plot(spark, folder):
    return experiments.roc_plot_data(_two_scored(spark, folder))


@query
def confusion_plot(spark, folder):
    return experiments.confusion_plot_data(_two_scored(spark, folder))
