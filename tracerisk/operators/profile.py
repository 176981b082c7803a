"""Exploration of events, features and labels."""

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracerisk.functions import event_label
from tracerisk.operators.quantiles import exact_quantiles
from tracerisk.operators.skew import sized
from tracerisk.schema import TASK_KEY, TERMINAL_EVENTS
from tracerisk.sources.shared import materialize

QUARTILES = [0.25, 0.5, 0.75]


def _long(frame: DataFrame, names: Sequence[str], fields: Sequence[str], key: str) -> DataFrame:
    """One-row frame with columns `name__field` as one row per name."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias(key), *[F.col(f"{n}__{f}").alias(f) for f in fields])
            for n in names
        ]
    )
    return frame.select(F.inline(rows))


def get_missing_summary(df: DataFrame) -> DataFrame:
    """Nulls per column, as count and in percent, in one pass."""
    cols = df.columns
    aggs = [F.count_if(F.col(c).isNull()).alias(f"{c}__missing_count") for c in cols]
    share = [
        F.try_divide(F.col(f"{c}__missing_count") * 100.0, F.col("_rows")).alias(f"{c}__missing_pct")
        for c in cols
    ]
    counted = df.agg(F.count("*").alias("_rows"), *aggs).select("*", *share)
    return _long(counted, cols, ["missing_count", "missing_pct"], "column")


def event_distribution(events: DataFrame) -> DataFrame:
    """Events per known event name."""
    named = events.select(event_label(F.col("event_type")).alias("event_label"))
    return value_distribution(named, "event_label")


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows per value that is not null."""
    known = df.filter(F.col(col).isNotNull())
    return known.groupBy(col).agg(F.count("*").alias("n_rows"))


def nulls_by_event(events: DataFrame, col: str = "cpu_requested") -> DataFrame:
    """Rows and nulls of a column per event name."""
    return events.groupBy(event_label(F.col("event_type")).alias("event_label")).agg(
        F.count_if(F.col(col).isNull()).alias("n_missing"), F.count("*").alias("n_rows")
    )


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column.

    Reads the frame twice: give it a written table.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    moments = (
        doubles.unpivot([], list(cols), "feature", "value")
        .groupBy("feature")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    quartiles = exact_quantiles(doubles, cols, QUARTILES)
    return moments.join(_wide_quartiles(quartiles, ["feature"]), "feature", "left").select(
        "feature", "n", "mean", "std", "min", "q1", "median", "q3", "max"
    )


def _wide_quartiles(quantiles: DataFrame, by: Sequence[str]) -> DataFrame:
    names = zip(["q1", "median", "q3"], QUARTILES)
    at = [F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in names]
    return quantiles.groupBy(*by).agg(*at)


def histogram(df: DataFrame, col: str, bins: int = 50, upper: float | None = None) -> DataFrame:
    """Rows in `bins` equal bins from minimum to maximum; the last bin is closed.

    With `upper`, larger values count as `upper`. Empty bins are listed with 0.
    Null and NaN are left out.
    """
    value = F.col(col).cast("double")
    value = value if upper is None else F.least(value, F.lit(float(upper)))
    values = df.select(value.alias("value")).filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    span = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # A constant column gets a span of one around its value.
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    place = F.floor((F.col("value") - lo) / (hi - lo) * bins)
    counts = (
        values.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n_rows"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    every = span.filter(F.col("lo").isNotNull()).select(
        "lo", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def boxplot_stats(df: DataFrame, cols: Sequence[str], by: str = "label") -> DataFrame:
    """Quartiles and whiskers (last values within 1.5 quartile ranges) per group."""
    wide = df.select(by, *[F.col(c).cast("double").alias(c) for c in cols])
    group = [by, "feature"]
    box = _wide_quartiles(exact_quantiles(wide, cols, QUARTILES, [by]), group)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    # One row of `box` per group and feature, of which there may be many.
    box = materialize(box)
    values = wide.unpivot([by], list(cols), "feature", "value").filter(F.col("value").isNotNull())
    whiskers = values.join(sized(box), group).filter(inside)
    return (
        whiskers.groupBy(*group)
        .agg(F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high"))
        .join(box, group)
        .select(*group, "whisker_low", "q1", "median", "q3", "whisker_high")
    )


def with_label(feature: DataFrame, labelled: DataFrame) -> DataFrame:
    """Feature table of tasks joined with the label."""
    return feature.join(labelled.select(*TASK_KEY, "label"), TASK_KEY)


def stats_by_label(df: DataFrame, col: str) -> DataFrame:
    """Rows, mean, exact median and sample deviation of a column per label."""
    medians = exact_quantiles(df, [col], [0.5], ["label"])
    medians = medians.select("label", F.col("value").alias("median"))
    return (
        df.groupBy("label")
        .agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))
        .join(medians, "label", "left")
        .select("label", "n", "mean", "median", "std")
    )


def means_by_label(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of every column per label."""
    return df.groupBy("label").agg(*[F.avg(c).alias(c) for c in cols])


def _pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation per pair of columns over the rows with both values.

    Null for a constant column. The pairs become rows that each task sums up
    before the shuffle: hundreds of aggregates side by side would not be compiled.
    """
    values = [
        F.struct(
            F.lit(i).alias("pair"),
            F.col(a).cast("double").alias("x"),
            F.col(b).cast("double").alias("y"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    scale = F.sqrt(F.regr_sxx("y", "x")) * F.sqrt(F.regr_syy("y", "x"))
    correlation = F.try_divide(F.regr_sxy("y", "x"), scale)

    def name(side: int) -> Column:
        return F.get(F.array(*[F.lit(p[side]) for p in pairs]), F.col("pair"))

    return (
        df.select(F.inline(F.array(*values)))
        .groupBy("pair")
        .agg(correlation.alias("correlation"))
        .select(name(0).alias("feature"), name(1).alias("other"), "correlation")
    )


def feature_label_correlation(matrix: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of every feature with the label, largest absolute value first."""
    rows = _pair_correlations(matrix, [(c, "label") for c in cols])
    return rows.select("feature", "correlation").orderBy(
        F.abs("correlation").desc_nulls_last(), "feature"
    )


def correlation_matrix(matrix: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of every pair of columns, each over its own complete rows.

    Varying columns without nulls go through Spark's correlation of vectors, the
    pairs of the others through `_pair_correlations`. Give it a written table.
    """
    state = matrix.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in cols],
        *[(F.min(c) == F.max(c)).alias(f"{c}__constant") for c in cols],
    ).first()
    full = [c for c in cols if state[f"{c}__nulls"] == 0 and not state[f"{c}__constant"]]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]

    if full:
        vector = array_to_vector(F.array(*[F.col(c).cast("double") for c in full]))
        found = Correlation.corr(matrix.select(vector.alias("v")), "v").first()[0].toArray()
        known = {(a, b): float(found[i, j]) for i, a in enumerate(full) for j, b in enumerate(full)}
    else:
        known = {}
    rows = [(*pair, known[pair]) for pair in pairs if pair in known]
    schema = "feature string, other string, correlation double"
    half = matrix.sparkSession.createDataFrame(rows, schema)
    rest = [pair for pair in pairs if pair not in known]
    if rest:
        half = half.unionByName(_pair_correlations(matrix, rest))
    sides = F.array(
        F.struct(F.col("feature"), F.col("other")),
        F.struct(F.col("other").alias("feature"), F.col("feature").alias("other")),
    )
    return half.select("correlation", F.inline(F.array_distinct(sides)))


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts of two columns with totals; a total has null in the column summed over."""
    return df.cube(row, col).agg(
        F.count("*").alias("n_rows"), F.grouping_id().cast("int").alias("total_level")
    )


def counts_by_flag(df: DataFrame, flag: str = "priority_inversion_flag") -> DataFrame:
    """Tasks per label, with one column for flag 0 and one for flag 1."""
    wide = df.groupBy("label").pivot(flag, [0, 1]).agg(F.count(flag))
    return wide.select(
        "label",
        F.coalesce("0", F.lit(0)).alias("not_flagged"),
        F.coalesce("1", F.lit(0)).alias("flagged"),
    )


def flag_rates(df: DataFrame, flag: str = "priority_inversion_flag") -> DataFrame:
    """Tasks, flagged tasks and flagged share per label."""
    return df.groupBy("label").agg(
        F.count("*").alias("n_tasks"),
        F.sum(flag).cast("long").alias("flagged"),
        F.avg(flag).alias("rate"),
    )


def flag_distribution(df: DataFrame, flag: str = "priority_inversion_flag") -> DataFrame:
    """Tasks per flag and their share of all tasks."""
    counted = df.agg(
        F.count_if(F.col(flag) == 0).alias("n0"), F.count_if(F.col(flag) == 1).alias("n1")
    )
    per_flag = F.array(
        F.struct(F.lit(0).alias(flag), F.col("n0").alias("n_tasks")),
        F.struct(F.lit(1).alias(flag), F.col("n1").alias("n_tasks")),
    )
    share = F.try_divide(F.col("n_tasks").cast("double"), F.col("n0") + F.col("n1"))
    return counted.select("n0", "n1", F.inline(per_flag)).select(
        flag, "n_tasks", share.alias("share")
    )


def stage_summary(events: DataFrame, labelled: DataFrame) -> DataFrame:
    """Events, tasks, terminal tasks, tasks per label and class ratio in one row."""
    tasks = events.groupBy(*TASK_KEY).agg(F.count("*").alias("n"))
    sizes = tasks.agg(F.sum("n").alias("n_events"), F.count("*").alias("n_tasks"))
    ends = labelled.agg(
        F.count_if(F.col("event_type").isin(TERMINAL_EVENTS)).alias("n_terminal"),
        F.count_if(F.col("label") == 0).alias("n_normal"),
        F.count_if(F.col("label") == 1).alias("n_failed"),
    )
    ratio = F.try_divide(F.col("n_normal").cast("double"), F.col("n_failed"))
    both = ends.withColumn("size", sizes.select(F.struct("n_events", "n_tasks")).scalar())
    return both.select("size.*", "n_terminal", "n_normal", "n_failed", ratio.alias("ratio"))


def shape(df: DataFrame) -> DataFrame:
    """Column names and types with the number of rows."""
    fields = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    rows = df.agg(F.count("*").alias("n_rows"))
    return rows.select("n_rows", F.inline(F.array(*fields)))


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First `n` rows in a given order."""
    return df.orderBy(*order).limit(n)
