"""What serves a trace that grows: ledger, sketches, tables by task, histories, streams."""

import random

import pytest
from pyspark.sql import functions as F

from tracerisk.catalog import queries
from tracerisk.operators import clean, features, labels, sketches
from tracerisk.operators.quantiles import exact_quantiles
from tracerisk.schema import COLUMNS, SEQ, TASK_KEY
from tracerisk.sources import buckets, ledger, load_trace_parts, materialize
from tracerisk.sources.adapters import trace_from_events, trace_from_lineitem
from tracerisk.streaming import (
    read_stream,
    run_to_end,
    stream_schedules_per_slot,
    stream_waiting_priority,
    write_end_mark,
)


@pytest.fixture(scope="module")
def events(spark, small):
    return materialize(clean.clean_trace(trace_from_events(spark, small, copies=True)))


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


# Ledger


def lines(first, n):
    return "".join(f"{i},,{i % 5},0,,0,u,0,0,0.1,0.1,0.1,0\n" for i in range(first, first + n))


@pytest.fixture
def parts(tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for i in range(2):
        (folder / f"part-{i}.csv").write_text(lines(i * 50, 50))
    return folder


def test_two_loads_equal_one(spark, parts, tmp_path):
    table = str(tmp_path / "table")
    assert ledger.read_ledger(spark, table).count() == 0
    assert ledger.load_new_parts(spark, str(parts), table).count() == 100
    (parts / "part-2.csv").write_text(lines(100, 30))
    grown = ledger.load_new_parts(spark, str(parts), table)
    whole = load_trace_parts(spark, str(parts))
    by = lambda df: [tuple(r) for r in df.orderBy(SEQ).select(*COLUMNS).collect()]
    assert by(grown) == by(whole) and grown.select(SEQ).distinct().count() == 130
    book = {r.part: (r.no, r.n_rows, r.load) for r in ledger.read_ledger(spark, table).collect()}
    assert book == {"part-0.csv": (0, 50, 0), "part-1.csv": (1, 50, 0), "part-2.csv": (2, 30, 1)}
    # Nothing new: nothing is loaded.
    assert ledger.load_new_parts(spark, str(parts), table).count() == 130
    assert ledger.read_ledger(spark, table).agg(F.max("load")).first()[0] == 1


def test_changed_parts_are_refused(spark, parts, tmp_path):
    table = str(tmp_path / "table")
    ledger.load_new_parts(spark, str(parts), table)
    (parts / "part-1.csv").write_text(lines(50, 50))  # the same lines, written again
    assert ledger.load_new_parts(spark, str(parts), table).count() == 100
    (parts / "part-1.csv").write_text(lines(50, 50).replace("59,", "58,", 1))
    with pytest.raises(ValueError, match="part-1.csv has changed"):
        ledger.load_new_parts(spark, str(parts), table)
    (parts / "part-1.csv").write_text(lines(50, 49))
    with pytest.raises(ValueError, match="part-1.csv has changed"):
        ledger.load_new_parts(spark, str(parts), table)


def test_rows_of_a_failed_load_are_not_read(spark, parts, tmp_path):
    table = str(tmp_path / "table")
    ledger.load_new_parts(spark, str(parts), table)
    (parts / "part-2.csv").write_text(lines(100, 30) + "not,a,row\n")
    with pytest.raises(Exception):
        ledger.load_new_parts(spark, str(parts), table)
    assert ledger.read_ledger(spark, table).count() == 2
    (parts / "part-2.csv").write_text(lines(100, 30))
    assert ledger.load_new_parts(spark, str(parts), table).count() == 130


# Sketches


def test_quantiles_of_merged_sketches(spark):
    draw = random.Random(3)
    data = [(i % 7, draw.expovariate(1), draw.choice([1.0, 2.0, None, float("nan")])) for i in range(20_000)]
    df = spark.createDataFrame(data, "part int, x double, y double").repartition(5)
    parts = materialize(sketches.quantile_sketches(df, ["x", "y"], ["part"]))
    assert parts.count() == 14
    found = sketches.sketched_quantiles(sketches.merge_quantile_sketches(parts), [0.1, 0.5, 0.9]).collect()
    known = {"x": sorted(r[1] for r in data), "y": sorted(r[2] for r in data if r[2] in (1.0, 2.0))}
    for r in found:
        values, error = known[r.feature], 3 * sketches.rank_error()
        assert r.n == len(values)
        assert sum(v < r.value for v in values) / len(values) <= r.prob + error
        assert sum(v <= r.value for v in values) / len(values) >= r.prob - error
    exact = exact_quantiles(df, ["x"], [0.5]).first()["value"]
    half = next(r for r in found if r.feature == "x" and r.prob == 0.5)
    assert half.value == pytest.approx(exact, rel=0.1)


def test_distinct_counts_of_united_sketches(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("k"), (F.col("id") % 3).alias("part"))
    parts = materialize(sketches.distinct_sketches(df, ["k"], ["part"]))
    whole = sketches.distinct_sketches(df, ["k"])
    united = sketches.sketched_counts(sketches.merge_distinct_sketches(parts)).first()["estimate"]
    # A single sketch counts by its history, a union by its registers: so the whole joins a union here.
    more = sketches.merge_distinct_sketches(parts.select("sketch").unionByName(whole))
    assert united == sketches.sketched_counts(more).first()["estimate"]
    assert abs(united - 20_000) < 4 * sketches.distinct_error() * 20_000


# Tables by task


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_no_shuffle_after_tables_by_task(spark, events):
    table = spark.table(buckets.write_by_task(events, buckets=6))
    labelled = labels.create_labels(table)
    delay = features.calculate_scheduling_delay(table)
    duration = features.calculate_execution_duration(table, labelled)
    joined = labelled.select(*TASK_KEY, "label").join(delay, TASK_KEY, "left").join(duration, TASK_KEY, "left")
    for df in (labelled, delay, duration, joined):
        assert exchanges(df) == 0
    usual = labels.create_labels(events)
    assert exchanges(usual) > 0
    assert rows(labelled) == rows(usual)
    assert rows(delay) == rows(features.calculate_scheduling_delay(events))
    assert rows(duration) == rows(features.calculate_execution_duration(events, usual))


def test_buckets_grow_with_the_table():
    assert [buckets.buckets_for(n, least=16) for n in (0, 8_000_000, 8_000_001, 648_000_000)] == [16, 16, 17, 1296]


def test_task_times_take_more_buckets_for_more_rows(spark, small, monkeypatch):
    asked = []
    write = queries.write_by_task
    monkeypatch.setattr(buckets, "BUCKET_ROWS", 500)
    monkeypatch.setattr(queries, "write_by_task", lambda df, buckets: asked.append(buckets) or write(df, buckets=buckets))
    assert queries.queries()["task_times_by_bucket"](spark, small).count() > 0
    n = trace_from_lineitem(spark, small).count()
    assert n > 16 * 500 and asked == [-(-n // 500)]


def test_a_stored_table_by_task_is_opened_again(spark, events, tmp_path):
    path = str(tmp_path / "by_task")
    buckets.write_by_task(events, path, buckets=6)
    again = spark.table(buckets.open_by_task(spark, path, events, 6))
    assert rows(again) == rows(events)
    assert exchanges(features.calculate_scheduling_delay(again)) == 0


# History of machines


def test_history_sees_only_what_came_before(spark, events):
    data = events.select("machine_id", "timestamp", "event_type").collect()
    want = {}
    for r in data:
        if r.machine_id != -1:
            earlier = [e.event_type for e in data if e.machine_id == r.machine_id and e.timestamp < r.timestamp]
            known = [t for t in earlier if t is not None]
            want[r.machine_id, r.timestamp] = (len(known), sum(t in (2, 3, 5) for t in known))
    for hot in (10**6, 20):
        found = features.machine_history(events, hot).collect()
        assert {(r.machine_id, r.timestamp): (r.total_before, r.failures_before) for r in found} == want


def test_rate_before_of_the_small_trace(spark, golden_raw):
    found = features.calculate_machine_failure_rate_before(clean.clean_trace(golden_raw))
    # Machine 500 has events at 10, 20, 30 s; machine 501 starts with task (3, 0).
    assert {(r.job_id, r.task_index): r.machine_failure_rate_before for r in found.collect()} == {
        (1, 0): None, (1, 1): 0.0, (2, 0): 0.0, (3, 0): None,
    }


def test_cleaning_counts_of_one_pass(spark, golden_raw):
    for hot in (10**6, 3):
        counts = clean.CleaningCounts()
        cleaned = materialize(clean.clean_trace(golden_raw, hot, counts))
        assert counts.get() == {
            "rows_in": 16, "missing_key_removed": 1, "duplicates_removed": 1, "rows_out": cleaned.count(),
        }


# Streams

STREAMED = "timestamp long, machine_id long, event_type int, priority int"
SECOND = 1_000_000


def arrive(spark, folder, data):
    spark.createDataFrame(data, STREAMED).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch(spark, events, tmp_path):
    folder, schema = str(tmp_path / "in"), events.schema
    events.write.parquet(folder)
    write_end_mark(spark, folder, schema)
    for k, (make, batch) in enumerate(
        (
            (stream_schedules_per_slot, features.schedules_per_slot),
            (stream_waiting_priority, features.waiting_priority),
        )
    ):
        result = make(read_stream(spark, folder, schema), 3600)
        assert run_to_end(result, str(tmp_path / f"out{k}"), str(tmp_path / f"check{k}")) == 0
        assert rows(spark.read.schema(result.schema).parquet(str(tmp_path / f"out{k}"))) == rows(batch(events, 3600))


def test_late_rows_and_a_second_run(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    arrive(spark, folder, [(10 * SECOND, 7, 1, 0), (70 * SECOND, 7, 1, 0), (400 * SECOND, 8, 1, 0)])
    stream = read_stream(spark, folder, spark.read.parquet(folder).schema, 1)
    result = stream_schedules_per_slot(stream, 60, "30 seconds")
    assert run_to_end(result, out, check) == 0
    table = lambda: sorted(tuple(r) for r in spark.read.schema(result.schema).parquet(out).collect())
    assert table() == [(7, 0, 1), (7, 1, 1)]
    # One row of a closed window, one of an open one, one without a machine; then the end.
    arrive(spark, folder, [(20 * SECOND, 7, 1, 0), (390 * SECOND, 8, 1, 0), (390 * SECOND, -1, 1, 0)])
    write_end_mark(spark, folder, stream.schema)
    assert run_to_end(result, out, check) == 1
    assert table() == [(7, 0, 1), (7, 1, 1), (8, 6, 2)]
