"""Columns, event vocabulary and feature lists of the task-event trace."""

from pyspark.sql import types as T

# Raw column order of the header-less trace files (fixed values of the format).
TRACE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("missing_info", T.IntegerType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("task_index", T.IntegerType()),
        T.StructField("machine_id", T.LongType()),
        T.StructField("event_type", T.IntegerType()),
        T.StructField("user", T.StringType()),
        T.StructField("scheduling_class", T.IntegerType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("cpu_requested", T.DoubleType()),
        T.StructField("memory_requested", T.DoubleType()),
        T.StructField("disk_requested", T.DoubleType()),
        T.StructField("different_machine", T.IntegerType()),
    ]
)

COLUMNS = TRACE_SCHEMA.fieldNames()
DATA_COLUMNS = [c for c in COLUMNS if c != "missing_info"]
TASK_KEY = ["job_id", "task_index"]
RESOURCES = ["cpu_requested", "memory_requested", "disk_requested", "different_machine"]

# Position of a row in the input; breaks ties between equal times of one task.
SEQ = "ingest_seq"
# Number of an event within its task (from 1), by time and then input position. Cleaning
# adds it, and every later "first" or "last" compares this one number.
EVENT_NO = "event_no"
NO_MACHINE = -1

# Event codes of the trace format (fixed values).
SUBMIT, SCHEDULE, EVICT, FAIL, FINISH, KILL, LOST, UPDATE_PENDING, UPDATE_RUNNING = range(9)
EVENT_TYPES = {
    SUBMIT: "SUBMIT",
    SCHEDULE: "SCHEDULE",
    EVICT: "EVICT",
    FAIL: "FAIL",
    FINISH: "FINISH",
    KILL: "KILL",
    LOST: "LOST",
    UPDATE_PENDING: "UPDATE_PENDING",
    UPDATE_RUNNING: "UPDATE_RUNNING",
}
FAILURE_EVENTS = [EVICT, FAIL, KILL]
NORMAL_EVENTS = [FINISH]
TERMINAL_EVENTS = FAILURE_EVENTS + NORMAL_EVENTS

# Feature groups (fixed names and order).
RAW_FEATURES = ["scheduling_class", "priority", *RESOURCES]
NOVEL_FEATURES = [
    "scheduling_delay_sec",
    "execution_duration_sec",
    "machine_failure_rate",
    "concurrency_density",
    "resource_overcommit_ratio",
    "priority_inversion_flag",
]
ALL_FEATURES = RAW_FEATURES + NOVEL_FEATURES
MATRIX_COLUMNS = [*TASK_KEY, "machine_id", *RAW_FEATURES, "label", *NOVEL_FEATURES]
