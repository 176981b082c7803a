"""Feature matrix: one row per labelled task."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracerisk.functions import at_first, first_known
from tracerisk.operators.clean import clean_in_place
from tracerisk.operators.features import (
    calculate_priority_gap,
    elapsed,
    first_slot,
    on_machine,
    schedules_per_slot,
    start_times,
    time_window,
    waiting_priority,
    with_concurrency,
)
from tracerisk.operators.labels import failed, final_state, is_terminal
from tracerisk.operators.skew import NARROW_ROWS, lookup, stage_lookup
from tracerisk.schema import (
    EVENT_NO,
    FAILURE_EVENTS,
    MATRIX_COLUMNS,
    NO_MACHINE,
    NOVEL_FEATURES,
    RAW_FEATURES,
    SCHEDULE,
    TASK_KEY,
)
from tracerisk.sources.buckets import write_by_task
from tracerisk.sources.shared import materialize

# What the matrix reads of the events.
_READ = [*TASK_KEY, EVENT_NO, "timestamp", "machine_id", "event_type", *RAW_FEATURES]


def build_feature_matrix(
    labelled: DataFrame,
    delay: DataFrame,
    duration: DataFrame,
    machine_rates: DataFrame,
    concurrency: DataFrame,
    overcommit: DataFrame,
    priority_gap: DataFrame,
) -> DataFrame:
    """Labelled tasks left-joined with the six feature tables; missing features become 0."""
    rates, small = stage_lookup(machine_rates)
    base = [c for c in MATRIX_COLUMNS if c not in NOVEL_FEATURES]
    matrix = lookup(labelled.select(*base), rates, ["machine_id"], small=small)
    for table in (delay, duration, concurrency, overcommit, priority_gap):
        matrix = matrix.join(table, TASK_KEY, "left")
    return _finish(matrix)


def feature_matrix(
    events: DataFrame,
    window_seconds: int = 300,
    priority_window_seconds: int = 60,
    written: bool = False,
    by: Sequence[str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """The same matrix straight from the cleaned events, in one aggregate per task.

    The events are written once (unless they are a written table already) and
    scanned four times, each time with few columns: per machine, per machine and
    window, per waiting window, and per task. If they lie by task, or by part of its key (`by`),
    they are written so (in `parts` partitions, if not as many as the session's), and the aggregate per task has no shuffle. Rows carry the highest waiting priority of their
    window into the one aggregate per task if that table is small enough to broadcast; if not,
    the gap is an aggregate of its own, on the same key.
    """
    if not written:
        events = events.select(*_READ)
        events = materialize(events) if by is None else _stored(events, by, parts)
    code = F.col("event_type")
    asks_cpu = on_machine() & (F.col("cpu_requested") > 0)

    machines, small = stage_lookup(
        events.filter(F.col("machine_id") != NO_MACHINE)
        .groupBy("machine_id")
        .agg(
            F.count(code).alias("total"),
            F.count_if(code.isin(FAILURE_EVENTS)).alias("failures"),
            F.avg(F.when(asks_cpu, F.col("cpu_requested"))).alias("mean_cpu"),
        )
    )

    waiting = stage_lookup(waiting_priority(events, priority_window_seconds), NARROW_ROWS)
    if waiting[1]:
        window = time_window(priority_window_seconds).alias("time_window")
        highest = waiting[0].select("time_window", "max_waiting_priority")
        carried = lookup(events.select("*", window), highest, ["time_window"], small=True)
        own_gap = F.when(code == SCHEDULE, F.col("max_waiting_priority") - F.col("priority"))
        gap = [first_known(own_gap).alias("priority_inversion_flag")]
    else:
        carried, gap = events, []

    tasks = (
        carried.groupBy(*TASK_KEY)
        .agg(
            *gap,
            *final_state(),
            *start_times(),
            *first_slot(window_seconds, "slot_machine"),
            at_first(F.col("machine_id"), asks_cpu).alias("asked_machine"),
            at_first(F.col("cpu_requested"), asks_cpu).alias("asked_cpu"),
        )
        .filter(is_terminal(code))
        .withColumns(
            {
                "label": failed(code),
                # No machine is a null key, which the lookup spreads; it becomes -1 again below.
                "final_machine": F.nullif(F.col("machine_id"), F.lit(NO_MACHINE)),
                "machine_id": F.col("slot_machine"),
            }
        )
    )
    if not gap:
        apart = calculate_priority_gap(events, priority_window_seconds, waiting)
        tasks = tasks.join(apart, TASK_KEY, "left")

    rate = F.try_divide("failures", "total").alias("machine_failure_rate")
    rates = machines.select(F.col("machine_id").alias("final_machine"), "total", rate)
    tasks = lookup(tasks, rates, ["final_machine"], rows="total", small=small).drop("total")
    means = machines.select(F.col("machine_id").alias("asked_machine"), "total", "mean_cpu")
    tasks = lookup(tasks, means, ["asked_machine"], rows="total", small=small)

    novel = {
        "scheduling_delay_sec": elapsed("submit_time", "schedule_time"),
        "execution_duration_sec": elapsed("schedule_time", "timestamp"),
        "resource_overcommit_ratio": F.try_divide("asked_cpu", "mean_cpu"),
    }
    # Last, with the columns of the matrix alone: the table of slots is the one that may need a shuffle.
    kept = [c for c in MATRIX_COLUMNS if c not in ("machine_id", "concurrency_density")]
    tasks = tasks.withColumns(novel).select(*kept, "final_machine", "machine_id", "time_window")
    matrix = with_concurrency(tasks, schedules_per_slot(events, window_seconds)).withColumn(
        "machine_id", F.coalesce("final_machine", F.lit(NO_MACHINE))
    )
    return _finish(matrix)


def matrix_of_trace(
    raw: DataFrame,
    window_seconds: int = 300,
    priority_window_seconds: int = 60,
    by: Sequence[str] = tuple(TASK_KEY),
    parts: int | None = None,
) -> DataFrame:
    """The matrix of raw events: cleaned and written without a shuffle in between. `by` and `parts` as in `clean_trace`."""
    events, lie_by = clean_in_place(raw, by=by, parts=parts)
    return feature_matrix(events, window_seconds, priority_window_seconds, by=lie_by, parts=parts)


def _stored(events: DataFrame, by: Sequence[str], parts: int | None = None) -> DataFrame:
    """The events in as many buckets as they have partitions: those of a shuffle, unless given."""
    spark = events.sparkSession
    buckets = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.table(write_by_task(events, buckets=buckets, by=by))


def _finish(matrix: DataFrame) -> DataFrame:
    gap = F.col("priority_inversion_flag").cast("double")
    matrix = matrix.withColumn("priority_inversion_flag", gap)
    return matrix.na.fill(0, NOVEL_FEATURES).select(*MATRIX_COLUMNS)
