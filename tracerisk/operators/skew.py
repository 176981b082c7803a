"""Keys that hold far more rows than one task should get."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracerisk.sources.shared import materialize

# Rows of one key that a single task takes without trouble.
HOT_ROWS = 1_000_000
# Rows of a lookup table that are sent to every executor (a few dozen bytes each).
BROADCAST_ROWS = 1_000_000
# The same for a table of one whole number per whole-number key.
NARROW_ROWS = 4_000_000
# Tasks over which a key is spread where its rows can't be told apart beforehand.
SALTS = 64


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> DataFrame | None:
    """Written table of the keys with more than `limit` rows, all of them; None if there is none.

    An exact count, combined before the shuffle, so a large key costs one row per
    task. Rows with a null in the key are no key's.
    """
    counts = df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("_rows"))
    found = materialize(counts.filter(F.col("_rows") > limit).select(*keys))
    return None if found.isEmpty() else found


def is_small(dim: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a lookup table is small enough to broadcast. Give it a written table."""
    return dim.limit(rows + 1).count() <= rows


def sized(dim: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it is small enough."""
    return F.broadcast(dim) if is_small(dim, rows) else dim


def split_by_key(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of all other keys, and rows of the keys in `hot`."""
    listed = sized(hot)
    return df.join(listed, list(keys), "left_anti"), df.join(listed, list(keys), "left_semi")


def _salted(facts: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which every key's rows go to SALTS places and the table goes to each."""
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS)).cast("int")
    spread = facts.withColumn("_salt", salt)
    return spread.join(dim.withColumn("_salt", every), [*on, "_salt"], "left").drop("_salt")


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    rows: str | None = None,
    small: bool = False,
    limit: int = HOT_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join of `facts` with `dim`, which has one row per key `on`.

    A table checked by `is_small` is broadcast. Beyond that size, large keys are
    joined by broadcast on their own, and in the shuffle join their rows (and
    rows with a null key) get an extra key that spreads them over all tasks and
    meets nothing. Large keys come from `rows`, the column of `dim` that bounds
    the fact rows of its key, or from a count of `facts`. If they are too many to
    broadcast, all keys are salted instead. The column `rows` stays.
    """
    on = list(on)
    if small:
        return facts.join(F.broadcast(dim), on, "left")

    values = [c for c in dim.columns if c not in on]
    if rows is None:
        hot = hot_keys(facts, on, limit)
        large = dim.limit(0).select(*on) if hot is None else hot
        listed = large.join(dim, on, "left")
        cold = dim.join(large, on, "left_anti")
    else:
        listed, cold = dim.filter(F.col(rows) > limit), dim.filter(F.col(rows) <= limit)
    listed = materialize(listed)
    if not is_small(listed, broadcast_rows):
        return _salted(facts, dim, on).select(*facts.columns, *values)
    listed = listed.select(
        *on, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot")
    )
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    apart = no_key | F.col("_hot").isNotNull()
    cold = cold.withColumn("_spread", F.lit(0).cast("long"))
    found = (
        facts.join(F.broadcast(listed), on, "left")
        .withColumn("_spread", F.when(apart, F.xxhash64(*facts.columns)).otherwise(F.lit(0)))
        .join(cold, [*on, "_spread"], "left")
    )
    picked = [F.coalesce(f"_hot_{c}", c).alias(c) for c in values]
    return found.select(*facts.columns, *picked)


def stage_lookup(dim: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Write a lookup table once and check its size: the frame and whether it is small."""
    written = materialize(dim)
    return written, is_small(written, rows)
