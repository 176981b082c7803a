"""Contention features, each as an operator of its own.

Every operator takes the cleaned events and gives one row per task, or per
machine for the failure rate. Those with a lookup read the events more than
once: give them a written table.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracerisk.functions import at_first, bucket, first_known, seconds
from tracerisk.operators.ranges import in_ranges
from tracerisk.operators.skew import HOT_ROWS, hot_keys, lookup, sized, split_by_key, stage_lookup
from tracerisk.schema import EVENT_NO, FAILURE_EVENTS, NO_MACHINE, SCHEDULE, SUBMIT, TASK_KEY
from tracerisk.sources.shared import materialize


def on_machine() -> Column:
    """SCHEDULE event on a real machine."""
    return (F.col("event_type") == SCHEDULE) & (F.col("machine_id") != NO_MACHINE)


def start_times() -> list[Column]:
    """Aggregates per task: first SUBMIT and first SCHEDULE time."""
    code, time = F.col("event_type"), F.col("timestamp")
    return [
        F.min(F.when(code == SUBMIT, time)).alias("submit_time"),
        F.min(F.when(code == SCHEDULE, time)).alias("schedule_time"),
    ]


def elapsed(start: str, end: str) -> Column:
    """Seconds between two times; null when one is missing or the order is wrong."""
    gap = F.col(end) - F.col(start)
    return F.when(gap >= 0, seconds(gap))


def calculate_scheduling_delay(events: DataFrame) -> DataFrame:
    """Seconds from first SUBMIT to first SCHEDULE, for tasks with both in that order."""
    starts = events.filter(F.col("event_type").isin(SUBMIT, SCHEDULE))
    return (
        starts.groupBy(*TASK_KEY)
        .agg(*start_times())
        .select(*TASK_KEY, elapsed("submit_time", "schedule_time").alias("scheduling_delay_sec"))
        .filter(F.col("scheduling_delay_sec").isNotNull())
    )


def _first_schedule(events: DataFrame) -> DataFrame:
    scheduled = events.filter(F.col("event_type") == SCHEDULE)
    return scheduled.groupBy(*TASK_KEY).agg(F.min("timestamp").alias("schedule_time"))


def calculate_execution_duration(events: DataFrame, labelled: DataFrame) -> DataFrame:
    """Seconds from first SCHEDULE to the final event of a labelled task."""
    final = labelled.select(*TASK_KEY, F.col("timestamp").alias("final_time"))
    duration = elapsed("schedule_time", "final_time").alias("execution_duration_sec")
    return (
        _first_schedule(events)
        .join(final, TASK_KEY)
        .select(*TASK_KEY, duration)
        .filter(F.col("execution_duration_sec").isNotNull())
    )


def removed_negative_times(events: DataFrame, labelled: DataFrame) -> DataFrame:
    """Delays and durations computed, and how many of them were dropped as negative."""
    starts = events.filter(F.col("event_type").isin(SUBMIT, SCHEDULE))
    starts = starts.groupBy(*TASK_KEY).agg(*start_times())
    delay = F.col("schedule_time") - F.col("submit_time")
    final = labelled.select(*TASK_KEY, F.col("timestamp").alias("final_time"))
    duration = F.col("final_time") - F.col("schedule_time")
    return starts.join(final, TASK_KEY, "left").agg(
        F.count(delay).alias("delays"),
        F.count_if(delay < 0).alias("negative_delays"),
        F.count(duration).alias("durations"),
        F.count_if(duration < 0).alias("negative_durations"),
    )


def calculate_machine_failure_rate(events: DataFrame) -> DataFrame:
    """Share of EVICT, FAIL and KILL among all events of a real machine."""
    code = F.col("event_type")
    return (
        events.filter(F.col("machine_id") != NO_MACHINE)
        .groupBy("machine_id")
        .agg(F.count(code).alias("total"), F.count_if(code.isin(FAILURE_EVENTS)).alias("failures"))
        .select("machine_id", F.try_divide("failures", "total").alias("machine_failure_rate"))
    )


def machine_history(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per real machine and time: its events, and failures among them, strictly before that time.

    Events of one time are combined first, which also combines before the shuffle. Machines with
    more than `hot_rows` times are cut into sorted ranges, and each range gets the
    sums of those before it; the others take one running sum each.
    """
    code = F.col("event_type")
    times = materialize(
        events.filter(F.col("machine_id") != NO_MACHINE)
        .groupBy("machine_id", "timestamp")
        .agg(F.count(code).alias("total"), F.count_if(code.isin(FAILURE_EVENTS)).alias("failures"))
    )
    sums = ["total", "failures"]

    def before(*by):
        along = Window.partitionBy(*by).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1)
        return {f"{c}_before": F.coalesce(F.sum(c).over(along), F.lit(0)) for c in sums}

    columns = ["machine_id", "timestamp", *[f"{c}_before" for c in sums]]
    hot = hot_keys(times, ["machine_id"], hot_rows)
    if hot is None:
        return times.withColumns(before("machine_id")).select(*columns)
    usual, large = split_by_key(times, ["machine_id"], hot)
    piece = ["machine_id", "chunk"]
    ranged = in_ranges(large, ["machine_id", "timestamp"])
    earlier = Window.partitionBy("machine_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # No more rows than ranges plus large machines.
    carried = ranged.groupBy(*piece).agg(*[F.sum(c).alias(c) for c in sums]).select(
        *piece, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums]
    )
    local = ranged.withColumns(before(*piece)).join(sized(materialize(carried)), piece)
    local = local.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"_{c}") for c in sums})
    return usual.withColumns(before("machine_id")).select(*columns).unionByName(local.select(*columns))


def calculate_machine_failure_rate_before(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Failure rate of a task's machine as known when the task was first scheduled on a real machine.

    Unlike `calculate_machine_failure_rate` it sees only events before that time, so
    it holds nothing of the task's own end. Null where the machine has no earlier event.
    """
    first = events.filter(on_machine()).groupBy(*TASK_KEY).agg(
        *[at_first(F.col(c), on_machine()).alias(c) for c in ("machine_id", "timestamp")]
    )
    history = machine_history(events, hot_rows)
    rate = F.try_divide("failures_before", "total_before").alias("machine_failure_rate_before")
    return first.join(history, ["machine_id", "timestamp"]).select(*TASK_KEY, rate)


def time_window(window_seconds: int) -> Column:
    """Number of the tumbling window of an event."""
    return bucket(F.col("timestamp"), window_seconds)


def first_slot(window_seconds: int, machine: str = "machine_id") -> list[Column]:
    """Aggregates per task: machine and window of the first SCHEDULE on a real machine."""
    return [
        at_first(F.col("machine_id"), on_machine()).alias(machine),
        at_first(time_window(window_seconds), on_machine()).alias("time_window"),
    ]


def schedules_per_slot(events: DataFrame, window_seconds: int = 300) -> DataFrame:
    """SCHEDULE events per real machine and tumbling window."""
    return (
        events.filter(on_machine())
        .groupBy("machine_id", time_window(window_seconds).alias("time_window"))
        .agg(F.count("*").alias("concurrency_density"))
    )


def with_concurrency(tasks: DataFrame, per_slot: DataFrame) -> DataFrame:
    """Attach the count of the (machine_id, time_window) of every task."""
    on = ["machine_id", "time_window"]
    slots, small = stage_lookup(per_slot)
    return lookup(tasks, slots, on, rows="concurrency_density", small=small)


def calculate_concurrency_density(events: DataFrame, window_seconds: int = 300) -> DataFrame:
    """SCHEDULE events in the machine and window of the first SCHEDULE of a task.

    The first SCHEDULE is picked before the join, so one row per task is joined.
    """
    first = events.filter(on_machine()).groupBy(*TASK_KEY).agg(*first_slot(window_seconds))
    counted = with_concurrency(first, schedules_per_slot(events, window_seconds))
    return counted.select(*TASK_KEY, "concurrency_density")


def calculate_resource_overcommit(events: DataFrame) -> DataFrame:
    """CPU of the first SCHEDULE that asks for any, over the mean such CPU of its machine."""
    asking = events.filter(on_machine() & (F.col("cpu_requested") > 0))
    means, small = stage_lookup(
        asking.groupBy("machine_id").agg(
            F.avg("cpu_requested").alias("mean_cpu"), F.count("*").alias("asking")
        )
    )
    first = asking.groupBy(*TASK_KEY).agg(
        *[F.min_by(c, EVENT_NO).alias(c) for c in ("machine_id", "cpu_requested")]
    )
    ratio = F.try_divide("cpu_requested", "mean_cpu").alias("resource_overcommit_ratio")
    return lookup(first, means, ["machine_id"], rows="asking", small=small).select(*TASK_KEY, ratio)


def waiting_priority(events: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Highest SUBMIT priority per tumbling window (null without any), and its SCHEDULE events."""
    code = F.col("event_type")
    return (
        events.filter(code.isin(SUBMIT, SCHEDULE))
        .groupBy(time_window(window_seconds).alias("time_window"))
        .agg(
            F.max(F.when(code == SUBMIT, F.col("priority"))).alias("max_waiting_priority"),
            F.count_if(code == SCHEDULE).alias("schedules"),
        )
    )


def _schedules_with_waiting(
    events: DataFrame, window_seconds: int, staged: tuple[DataFrame, bool] | None = None
) -> DataFrame:
    waiting, small = staged or stage_lookup(waiting_priority(events, window_seconds))
    scheduled = events.filter(F.col("event_type") == SCHEDULE).select(
        *TASK_KEY, EVENT_NO, "priority", time_window(window_seconds).alias("time_window")
    )
    return lookup(scheduled, waiting, ["time_window"], rows="schedules", small=small)


def calculate_priority_gap(
    events: DataFrame, window_seconds: int = 60, staged: tuple[DataFrame, bool] | None = None
) -> DataFrame:
    """Highest waiting priority minus own priority, at the first SCHEDULE where both are known.

    `staged` is the table of `waiting_priority` from `stage_lookup`, where it is at hand.
    """
    gap = F.col("max_waiting_priority") - F.col("priority")
    first = first_known(gap).alias("priority_inversion_flag")
    return _schedules_with_waiting(events, window_seconds, staged).groupBy(*TASK_KEY).agg(first)


def calculate_priority_inversion(events: DataFrame, window_seconds: int = 60) -> DataFrame:
    """1 if the first SCHEDULE of a task passed a waiting task of higher priority, else 0."""
    passed = F.col("priority") < F.col("max_waiting_priority")
    flag = F.coalesce(passed.cast("int"), F.lit(0))
    first = F.min_by(flag, EVENT_NO).alias("priority_inversion_flag")
    return _schedules_with_waiting(events, window_seconds).groupBy(*TASK_KEY).agg(first)


def machine_rate_bands(rates: DataFrame) -> DataFrame:
    """Machines in all, without failures, and with a failure rate above 10 % and 50 %."""
    rate = F.col("machine_failure_rate")
    return rates.agg(
        F.count("*").alias("machines"),
        F.count_if(rate == 0).alias("no_failures"),
        F.count_if(rate > 0.1).alias("above_10_percent"),
        F.count_if(rate > 0.5).alias("above_50_percent"),
    )
