"""Large keys go another way and give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from tracerisk.catalog.queries import rounded
from tracerisk.operators.clean import clean_trace, forward_fill
from tracerisk.operators.skew import hot_keys, lookup
from tracerisk.plans.matrix import feature_matrix
from tracerisk.schema import RESOURCES, TASK_KEY
from tracerisk.sources.adapters import trace_from_events


@pytest.fixture(scope="module")
def skewed(spark, small):
    """Events of which every third belongs to one task, and many share one time."""
    raw = trace_from_events(spark, small, copies=True)
    third = F.col("ingest_seq") % 3 == 0
    same_time = F.when(F.col("ingest_seq") % 2 == 0, F.lit(1_704_070_000_000_000))
    return raw.withColumns(
        {
            "job_id": F.when(third, 7).otherwise(F.col("job_id")),
            "task_index": F.when(third, 1).otherwise(F.col("task_index")),
            "timestamp": F.when(third, F.coalesce(same_time, "timestamp")).otherwise(
                F.col("timestamp")
            ),
        }
    )


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_hot_keys_finds_the_large_task(skewed):
    assert hot_keys(skewed, TASK_KEY) is None
    assert [tuple(r) for r in hot_keys(skewed, TASK_KEY, 200).collect()] == [(7, 1)]


def test_hot_keys_has_no_cap_and_no_resolution(spark):
    many = spark.range(5_000 * 200).select((F.col("id") % 5_000).alias("k"))
    assert hot_keys(many, ["k"], 100).count() == 5_000
    cold = spark.range(2_000_000).select((F.col("id") % 1_000_000 + 10_000).alias("k"))
    few = spark.range(200 * 300).select((F.col("id") % 200).alias("k"))
    assert hot_keys(cold.unionByName(few), ["k"], 100).count() == 200


def test_forward_fill_in_ranges(skewed):
    distinct = skewed.dropDuplicates(["ingest_seq"])
    plain = forward_fill(distinct, look=False)
    large = forward_fill(distinct, hot=hot_keys(distinct, TASK_KEY, 10))
    assert rows(plain) == rows(large)
    assert plain.filter(F.greatest(*[F.col(c).isNull() for c in RESOURCES])).count() == 0


def test_clean_and_matrix_with_large_tasks(skewed):
    plain, large = clean_trace(skewed), clean_trace(skewed, hot_rows=10)
    assert rows(plain) == rows(large)
    ways = [rounded(feature_matrix(df, 21_600, 3_600)) for df in (plain, large)]
    assert rows(ways[0]) == rows(ways[1])


@pytest.mark.parametrize("rows_column", ["n", None])
def test_lookup_beyond_broadcast_size(spark, rows_column):
    rng = random.Random(1)
    keys = [None if rng.random() < 0.2 else 3 if rng.random() < 0.4 else rng.randrange(50)
            for _ in range(500)]
    facts = spark.createDataFrame(list(enumerate(keys)), "id int, k int")
    dim = facts.filter("k < 40").groupBy("k").agg(
        F.count("*").alias("n"), F.sum("id").alias("total")
    )
    split = lookup(facts, dim, ["k"], rows=rows_column, limit=10)
    small = lookup(facts, dim, ["k"], small=True)
    assert rows(split) == rows(small)
    salted = lookup(facts, dim, ["k"], rows=rows_column, limit=10, broadcast_rows=0)
    assert rows(salted) == rows(small)
    assert split.count() == 500
