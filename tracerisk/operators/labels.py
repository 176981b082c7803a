"""Final state and label of every task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracerisk.functions import event_label, last_known
from tracerisk.schema import (
    EVENT_NO,
    EVENT_TYPES,
    FAILURE_EVENTS,
    RESOURCES,
    TASK_KEY,
    TERMINAL_EVENTS,
)

# Without nulls after cleaning: their last known value is that of the last event.
_FILLED = ["machine_id", *RESOURCES]
_MAY_BE_NULL = ["timestamp", "event_type", "scheduling_class", "priority"]


def final_state() -> list[Column]:
    """Aggregates per task: last known value of every column but the two of strings.

    One fixed-width value per aggregate, so that Spark hashes instead of sorting.
    """
    return [
        *[F.max_by(c, EVENT_NO).alias(c) for c in _FILLED],
        *[last_known(F.col(c)).alias(c) for c in _MAY_BE_NULL],
    ]


def is_terminal(code: Column) -> Column:
    return code.isin(TERMINAL_EVENTS)


def failed(code: Column) -> Column:
    """1 for evicted, failed or killed, else 0."""
    return code.isin(FAILURE_EVENTS).cast("int")


def final_events(events: DataFrame) -> DataFrame:
    """One row per task with the last known value of every column."""
    code = F.col("event_type")
    known_code = F.when(code.isin(list(EVENT_TYPES)), code)
    state = events.groupBy(*TASK_KEY).agg(
        *final_state(), last_known(F.col("user")).alias("user"), last_known(known_code).alias("_code")
    )
    return state.withColumn("event_label", event_label(F.col("_code"))).drop("_code")


def create_labels(events: DataFrame) -> DataFrame:
    """Tasks whose last event is terminal, with label 1 for a failure and 0 for a finish."""
    code = F.col("event_type")
    return final_events(events).filter(is_terminal(code)).withColumn("label", failed(code))


def label_distribution(labelled: DataFrame) -> DataFrame:
    """Tasks per label, their share in percent and the ratio of label 0 to label 1.

    One aggregate without grouping, then one row per label that occurs.
    """
    counts = labelled.agg(
        F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")
    )
    ratio = F.try_divide(F.col("n0").cast("double"), F.col("n1")).alias("imbalance_ratio")
    per_label = F.array(
        F.struct(F.lit(0).alias("label"), F.col("n0").alias("n_tasks")),
        F.struct(F.lit(1).alias("label"), F.col("n1").alias("n_tasks")),
    )
    share = F.try_divide(F.col("n_tasks") * 100.0, F.col("n0") + F.col("n1"))
    return (
        counts.select("n0", "n1", ratio, F.inline(per_label))
        .filter(F.col("n_tasks") > 0)
        .select("label", "n_tasks", share.alias("percent"), "imbalance_ratio")
    )
