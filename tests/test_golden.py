"""Hand-worked results on the small trace, and the two ways to the matrix."""

import pytest
from golden import EXPECTED

from tracerisk import (
    build_feature_matrix,
    calculate_concurrency_density,
    calculate_execution_duration,
    calculate_machine_failure_rate,
    calculate_priority_gap,
    calculate_priority_inversion,
    calculate_resource_overcommit,
    calculate_scheduling_delay,
    clean_trace,
    create_labels,
    feature_matrix,
)
from tracerisk.operators.clean import cleaning_summary
from tracerisk.schema import MATRIX_COLUMNS, NOVEL_FEATURES, RESOURCES, SEQ
from tracerisk.sources import materialize


@pytest.fixture(scope="module")
def events(golden_raw):
    return materialize(clean_trace(golden_raw))


@pytest.fixture(scope="module")
def labelled(events):
    return materialize(create_labels(events))


def by_task(df, col):
    return {(r["job_id"], r["task_index"]): r[col] for r in df.collect()}


def check(df, col, position, dropped=()):
    expected = {k: v[position] for k, v in EXPECTED.items() if k not in dropped}
    found = by_task(df, col)
    for task, value in expected.items():
        assert found[task] == pytest.approx(value, abs=1e-9), task
    assert not set(dropped) & set(found)


def test_cleaning(events, golden_raw):
    assert events.count() == 14
    summary = cleaning_summary(golden_raw).first().asDict()
    assert summary == {
        "rows_in": 16,
        "duplicates_removed": 1,
        "missing_key_removed": 1,
        "rows_out": 14,
    }
    for c in [*RESOURCES, "machine_id", "event_label"]:
        assert events.filter(events[c].isNull()).count() == 0
    # Nothing is filled backwards: the first SCHEDULE of task (2, 0) precedes its SUBMIT.
    first = events.filter("job_id = 2 AND event_type = 1").first()
    assert first["cpu_requested"] == 0


def test_labels(labelled):
    for position, col in enumerate(["label", "machine_id", "user", "cpu_requested"]):
        check(labelled, col, position)
    assert labelled.count() == 4


def test_features(events, labelled):
    check(calculate_scheduling_delay(events), "scheduling_delay_sec", 4, {(2, 0), (3, 0)})
    check(calculate_execution_duration(events, labelled), "execution_duration_sec", 5)
    check(calculate_concurrency_density(events), "concurrency_density", 6)
    overcommit = calculate_resource_overcommit(events)
    check(overcommit, "resource_overcommit_ratio", 7, {(2, 0)})
    check(calculate_priority_gap(events), "priority_inversion_flag", 8)
    check(calculate_priority_inversion(events), "priority_inversion_flag", 9)
    rates = {r[0]: r[1] for r in calculate_machine_failure_rate(events).collect()}
    assert rates == pytest.approx({500: 1 / 6, 501: 2 / 5})


def test_matrix_both_ways(events, labelled):
    fused = feature_matrix(events)
    joined = build_feature_matrix(
        labelled,
        calculate_scheduling_delay(events),
        calculate_execution_duration(events, labelled),
        calculate_machine_failure_rate(events),
        calculate_concurrency_density(events),
        calculate_resource_overcommit(events),
        calculate_priority_gap(events),
    )
    assert fused.columns == joined.columns == MATRIX_COLUMNS
    assert sorted(fused.collect()) == sorted(joined.collect())
    rows = {(r["job_id"], r["task_index"]): r for r in fused.collect()}
    assert set(rows) == set(EXPECTED)
    for task, (label, machine, _, cpu, *novel, _) in EXPECTED.items():
        row = rows[task]
        assert (row["label"], row["machine_id"]) == (label, machine)
        assert row["cpu_requested"] == pytest.approx(cpu)
        rate = {500: 1 / 6, 501: 2 / 5}[machine]
        delay, duration, concurrency, overcommit, gap = novel
        wanted = [delay or 0, duration, rate, concurrency, overcommit or 0, gap]
        assert [row[c] for c in NOVEL_FEATURES] == pytest.approx(wanted)


def test_without_position_column(golden_raw):
    """Copies are equal and times distinct here, so content order gives the same."""
    plain, usual = clean_trace(golden_raw.drop(SEQ)), clean_trace(golden_raw)
    assert sorted(map(str, plain.collect())) == sorted(
        map(str, usual.select(*plain.columns).collect())
    )


def test_last_event_code_null(spark, golden_raw):
    """A null code after the last event doesn't hide the final state."""
    rows = [(10, 1, 0.1), (20, 4, 0.1), (30, None, 0.1)]
    raw = spark.createDataFrame(rows, "timestamp long, event_type int, cpu_requested double")
    filled = raw.selectExpr(
        "timestamp", "cast(null as int) missing_info", "1L job_id", "0 task_index", "5L machine_id", "event_type",
        "'u' user", "0 scheduling_class", "0 priority", "cpu_requested", "0.1D memory_requested", "0.1D disk_requested",
        "0 different_machine", "timestamp ingest_seq",
    )
    found = create_labels(clean_trace(filled)).collect()
    assert [(r.label, r.event_type) for r in found] == [(0, 4)]
