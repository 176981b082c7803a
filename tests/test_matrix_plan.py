"""The matrix from raw events that lie by job: no shuffle by task, the same rows as by the usual way."""

from pyspark.sql import functions as F
from test_growing_trace import exchanges

from tracerisk.operators import clean, split
from tracerisk.plans import matrix as plans
from tracerisk.schema import EVENT_NO, TASK_KEY
from tracerisk.sources import materialize
from tracerisk.sources.adapters import line_partitions, trace_from_lineitem


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_rows_that_lie_by_job_are_cleaned_where_they_lie(spark, small):
    raw = trace_from_lineitem(spark, small)
    events, by = clean.clean_in_place(raw, by=["job_id"])
    # The two of the join, and none of the cleaning.
    assert by == ["job_id"] and exchanges(events) == 2
    usual = clean.clean_trace(materialize(raw))
    assert exchanges(usual) == 1
    assert rows(events) == rows(usual)


def test_a_large_job_goes_the_usual_way(spark, small):
    raw = trace_from_lineitem(spark, small)
    events, by = clean.clean_in_place(raw, hot_rows=5, by=["job_id"])
    assert by is None or by == TASK_KEY
    assert rows(events) == rows(clean.clean_trace(raw))


def test_events_stored_by_job_need_no_shuffle_by_task(spark, small):
    raw = trace_from_lineitem(spark, small)
    matrix = plans.matrix_of_trace(raw, 604_800, 60, by=["job_id"])
    assert exchanges(matrix) == 0
    events = materialize(clean.clean_trace(raw))
    usual = plans.feature_matrix(events, 604_800, 60, written=True)
    assert exchanges(usual) > 0
    # Means depend on the order of rows in their last digits.
    novel = [c for c in matrix.columns if c not in ("resource_overcommit_ratio", "machine_failure_rate")]
    assert rows(matrix.select(*novel)) == rows(usual.select(*novel))


def test_partitions_grow_with_the_lines(spark, small):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert line_partitions(spark, small) == least
    parts = line_partitions(spark, small, rows=1_000)
    assert parts == -(-3 * lines // 1_000) > least

    raw = trace_from_lineitem(spark, small, parts)
    events, _ = clean.clean_in_place(raw, by=["job_id"], parts=parts)
    assert exchanges(events) == 2 and events.rdd.getNumPartitions() == parts
    matrix = plans.matrix_of_trace(raw, 604_800, 60, by=["job_id"], parts=parts)
    assert exchanges(matrix) == 0
    usual = plans.matrix_of_trace(trace_from_lineitem(spark, small), 604_800, 60, by=["job_id"])
    novel = [c for c in matrix.columns if c not in ("resource_overcommit_ratio", "machine_failure_rate")]
    assert rows(matrix.select(*novel)) == rows(usual.select(*novel))


def test_no_event_is_lost_or_numbered_otherwise(spark, small):
    raw = trace_from_lineitem(spark, small)
    found = clean.clean_trace(raw, by=["job_id"]).select(*TASK_KEY, EVENT_NO, "timestamp", "event_type")
    assert rows(found) == rows(clean.clean_trace(raw).select(*found.columns))


def test_folds_do_not_shuffle_the_digest(spark, small):
    tasks = materialize(clean.clean_trace(trace_from_lineitem(spark, small)).select(*TASK_KEY).distinct())
    folds = split.stratified_folds(tasks.withColumn("label", F.col("task_index") % 2))
    plan = folds._jdf.queryExecution().executedPlan().toString()
    above = plan.splitlines()
    window = next(i for i, line in enumerate(above) if "Window" in line)
    exchange = next(i for i, line in enumerate(above) if i > window and "Exchange hashpartitioning(label" in line)
    # The digest is made between the shuffle and the window.
    assert any("AS _key" in line for line in above[window:exchange])
    sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert sorted(sizes) == [0, 1, 2, 3, 4] and max(sizes.values()) - min(sizes.values()) <= 2
