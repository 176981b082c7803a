"""Mergeable sketches: quantiles and distinct counts of parts that are never read again.

A sketch has a bounded size whatever it has seen. Those of single parts, days or
loads are stored; any union of them is summarised from the stored sketches alone.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of a quantile sketch, and log2 of the registers of a distinct-count sketch.
KLL_K, HLL_LOG2 = 400, 12


def rank_error(k: int = KLL_K) -> float:
    """Error of a rank, as a share of all rows, that a quantile sketch keeps in 99 of 100 cases (published fit)."""
    return 2.296 / k**0.9723


def distinct_error(log2: int = HLL_LOG2) -> float:
    """Relative standard error of a merged distinct-count sketch (published constant)."""
    return 1.04 / 2 ** (log2 / 2)


def quantile_sketches(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = KLL_K
) -> DataFrame:
    """A quantile sketch per group and column: by, feature, sketch. Null and NaN are left out."""
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    values = wide.unpivot(list(by), list(cols), "feature", "value")
    known = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return known.groupBy(*by, "feature").agg(F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def merge_quantile_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of larger groups from those of smaller ones."""
    return sketches.groupBy(*by, "feature").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The other columns of the sketches with n, prob and value."""
    others = [c for c in sketches.columns if c != "sketch"]
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probs]))
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), found.alias("value"))
    return sketches.select(
        *others, F.kll_sketch_get_n_double("sketch").alias("n"), F.inline(pairs).alias("prob", "value")
    )


def distinct_sketches(
    df: DataFrame, key: Sequence[str | Column], by: Sequence[str] = (), log2: int = HLL_LOG2
) -> DataFrame:
    """A distinct-count sketch of the key per group: by, sketch."""
    whole = F.xxhash64(*key)
    return df.groupBy(*by).agg(F.hll_sketch_agg(whole, F.lit(log2)).alias("sketch"))


def merge_distinct_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of unions of groups; a key in several of them counts once.

    A union holds the same registers as a sketch of all rows. Its estimate may differ a little from
    that of a sketch that was never merged, which also uses the order in which keys came.
    """
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """The other columns of the sketches with the estimated distinct count."""
    others = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*others, F.hll_sketch_estimate("sketch").alias("estimate"))
