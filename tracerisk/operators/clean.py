"""Cleaning of the raw event log."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tracerisk.functions import event_label
from tracerisk.operators.ranges import in_ranges
from tracerisk.operators.skew import HOT_ROWS, hot_keys, sized, split_by_key
from tracerisk.schema import DATA_COLUMNS, EVENT_NO, NO_MACHINE, RESOURCES, SEQ, TASK_KEY
from tracerisk.sources.shared import materialize


def drop_duplicate_events(raw: DataFrame) -> DataFrame:
    """One row per distinct event, at the position of its first copy.

    Without a position column, the row content gives the order of equal times.
    """
    if SEQ in raw.columns:
        return raw.groupBy(*DATA_COLUMNS).agg(F.min(SEQ).alias(SEQ))
    content = [c for c in DATA_COLUMNS if c not in (*TASK_KEY, "timestamp")]
    return raw.select(*DATA_COLUMNS).distinct().withColumn(SEQ, F.struct(*content))


def drop_missing_keys(df: DataFrame) -> DataFrame:
    """Rows with both parts of the task key."""
    return df.na.drop(subset=TASK_KEY)


def fill_machine(df: DataFrame) -> DataFrame:
    """Missing machine becomes -1."""
    filled = F.coalesce(F.col("machine_id"), F.lit(NO_MACHINE)).cast("long")
    return df.withColumn("machine_id", filled)


def forward_fill(
    df: DataFrame,
    cols: Sequence[str] = tuple(RESOURCES),
    hot: DataFrame | None = None,
    look: bool = True,
) -> DataFrame:
    """Replace nulls by the last known value of the task, or 0 where there is none.

    The sort that this takes also numbers the events of the task (`event_no`).
    `hot` lists the tasks (from `hot_keys`) too large for one sort; when not given,
    they are looked up in `df`, unless `look` says that there are none.
    """
    if hot is None and look:
        hot = hot_keys(df, TASK_KEY)
    running = (
        Window.partitionBy(*TASK_KEY)
        .orderBy("timestamp", SEQ)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def fill(rows: DataFrame) -> DataFrame:
        filled = {c: F.last(c, ignorenulls=True).over(running) for c in cols}
        filled = {c: F.coalesce(value, F.lit(0)) for c, value in filled.items()}
        return rows.withColumns(filled | {EVENT_NO: F.count("*").over(running)})

    if hot is None:
        return fill(df)
    usual, large = split_by_key(df, TASK_KEY, hot)
    return fill(usual).unionByName(_fill_in_ranges(large, cols))


def _fill_in_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Forward fill that cuts the timeline of a task into ranges and hands values on."""
    rows = in_ranges(df, [*TASK_KEY, "timestamp", SEQ])
    piece = [*TASK_KEY, "chunk"]
    before = (
        Window.partitionBy(*TASK_KEY)
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def last(c: str):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("timestamp", SEQ)))

    # No more rows than ranges plus large tasks.
    carried = (
        rows.groupBy(*piece)
        .agg(*[last(c).alias(c) for c in cols], F.count("*").alias("n"))
        .select(
            *piece,
            *[F.last(c, ignorenulls=True).over(before).alias(f"_{c}") for c in cols],
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"),
        )
    )
    running = (
        Window.partitionBy(*piece)
        .orderBy("timestamp", SEQ)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = {c: F.last(c, ignorenulls=True).over(running) for c in cols}
    local = rows.withColumns(local | {EVENT_NO: F.count("*").over(running)})
    filled = {c: F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(0)) for c in cols}
    filled[EVENT_NO] = F.col(EVENT_NO) + F.col("_n")
    joined = local.join(sized(materialize(carried)), piece, "left").withColumns(filled)
    return joined.select(*df.columns, EVENT_NO)


def decode_events(df: DataFrame) -> DataFrame:
    """Add the name of the event code."""
    return df.withColumn("event_label", event_label(F.col("event_type")))


class CleaningCounts:
    """Counts that `clean_trace` takes while its rows pass, known after the first action on them."""

    def __init__(self):
        self._seen, self._kept = Observation(), Observation()

    def watch_raw(self, raw: DataFrame) -> DataFrame:
        no_key = F.col("job_id").isNull() | F.col("task_index").isNull()
        return raw.observe(self._seen, F.count("*").alias("rows_in"), F.count_if(no_key).alias("no_key"))

    def watch_clean(self, events: DataFrame) -> DataFrame:
        return events.observe(self._kept, F.count("*").alias("rows_out"))

    def get(self) -> dict[str, int]:
        """Rows in, rows without a task key, copies removed, rows out. Waits for an action, so run one first."""
        seen, kept = self._seen.get, self._kept.get
        copies = seen["rows_in"] - seen["no_key"] - kept["rows_out"]
        return {
            "rows_in": seen["rows_in"],
            "missing_key_removed": seen["no_key"],
            "duplicates_removed": copies,
            "rows_out": kept["rows_out"],
        }


def clean_trace(
    raw: DataFrame,
    hot_rows: int = HOT_ROWS,
    counts: CleaningCounts | None = None,
    by: Sequence[str] = tuple(TASK_KEY),
    parts: int | None = None,
) -> DataFrame:
    """All cleaning steps: duplicates, task keys, machine, resources, event names.

    Not lazy throughout: tasks are counted when the plan is built, so give it raw
    rows whose task key is cheap to read twice, such as a written table.

    Copies of an event belong to one task, so a single shuffle by task serves the
    duplicate removal, the fill and any later aggregate per task. Tasks of more
    than `hot_rows` rows are set apart first, by a pass over the two key columns of
    the raw rows: their copies are combined before a shuffle by all columns, and
    the fill runs in ranges.

    `counts` takes the numbers of rows removed while the first action reads the result: no pass of its own.

    `by` may name the part of the task key by which the raw rows lie already, as after a join on the job:
    they are not shuffled again then, unless one value of it holds more than `hot_rows` rows.
    `parts` is the number of partitions by `by`, where it is not the session's.
    """
    return clean_in_place(raw, hot_rows, counts, by, parts)[0]


def clean_in_place(
    raw: DataFrame,
    hot_rows: int = HOT_ROWS,
    counts: CleaningCounts | None = None,
    by: Sequence[str] = tuple(TASK_KEY),
    parts: int | None = None,
) -> tuple[DataFrame, list[str] | None]:
    """The rows of `clean_trace`, and the columns by which they lie; None where large tasks were set apart."""
    raw, by = raw.drop("missing_info"), list(by)
    # Found before the rows are watched, so that only the pass that cleans them counts.
    hot = hot_keys(drop_missing_keys(raw), by, hot_rows)
    if hot is not None and by != TASK_KEY:
        by = TASK_KEY
        hot = hot_keys(drop_missing_keys(raw), by, hot_rows)
    keyed = drop_missing_keys(raw if counts is None else counts.watch_raw(raw))
    if hot is None:
        usual = keyed
    else:
        usual, _ = split_by_key(keyed, TASK_KEY, hot)
        _, large = split_by_key(drop_missing_keys(raw), TASK_KEY, hot)

    # Spark leaves this shuffle out where the rows lie so.
    by_task = usual.repartition(*by) if parts is None else usual.repartition(parts, *by)
    events = forward_fill(fill_machine(drop_duplicate_events(by_task)), look=False)
    if hot is not None:
        apart = fill_machine(drop_duplicate_events(large))
        events = events.unionByName(forward_fill(apart, hot=hot))
    whole = F.col("different_machine").cast("int")
    events = decode_events(events.drop(SEQ).withColumn("different_machine", whole))
    return events if counts is None else counts.watch_clean(events), by if hot is None else None


def cleaning_summary(raw: DataFrame) -> DataFrame:
    """Rows before cleaning, removed as copies, removed for a missing key, and kept."""
    distinct = raw.groupBy(*DATA_COLUMNS).agg(F.count("*").alias("copies"))
    no_key = F.col("job_id").isNull() | F.col("task_index").isNull()
    return distinct.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count_if(no_key).alias("missing_key_removed"),
        F.count_if(~no_key).alias("rows_out"),
    )
