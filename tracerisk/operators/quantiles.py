"""Exact quantiles of groups of any size."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracerisk.operators.ranges import in_ranges
from tracerisk.operators.skew import sized
from tracerisk.sources.shared import materialize


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles with linear interpolation, one row per group, feature and probability.

    `percentile` would gather all distinct values of a group in one task. Here
    equal values are counted, the counts are sorted in ranges, the totals of the
    ranges tell which of them hold the wanted ranks, and only those are ranked.
    """
    by = list(by)
    group = [*by, "feature"]
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    counts = (
        wide.unpivot(by, list(cols), "feature", "value")
        .filter(F.col("value").isNotNull())
        .groupBy(*group, "value")
        .agg(F.count("*").alias("n"))
    )
    ranged = in_ranges(counts, [*group, "value"])

    # No more rows than ranges plus groups.
    before = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "chunk").agg(F.sum("n").alias("size"))
    totals = totals.select(
        *group,
        "chunk",
        "size",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("skipped"),
        F.sum("size").over(Window.partitionBy(*group)).alias("total"),
    )

    # Two ranks per group, feature and probability.
    position = F.col("prob") * (F.col("total") - 1)
    wanted = (
        totals.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("below", F.floor(position))
        .withColumn("share", position - F.col("below"))
        .withColumn("rank", F.explode(F.array("below", F.ceil(position))))
        .filter(F.col("rank") >= F.col("skipped"))
        .filter(F.col("rank") < F.col("skipped") + F.col("size"))
        .select(*group, "chunk", "prob", "share", "below", "rank", "skipped")
        .distinct()
    )

    piece = [*group, "chunk"]
    # Rows for every group: as many as `by` has values.
    wanted = materialize(wanted)
    pieces = materialize(wanted.select(*piece).distinct())
    running = (
        Window.partitionBy(*piece)
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = ranged.join(sized(pieces), piece, "left_semi")
    ranked = ranked.withColumn("upto", F.sum("n").over(running))
    local = F.col("rank") - F.col("skipped")
    hit = (local < F.col("upto")) & (local >= F.col("upto") - F.col("n"))
    found = ranked.join(sized(wanted), piece).filter(hit)

    low = F.max(F.when(F.col("rank") == F.col("below"), F.col("value")))
    high = F.max("value")
    interpolated = low + (high - low) * F.first("share")
    return found.groupBy(*group, "prob").agg(interpolated.alias("value"))
