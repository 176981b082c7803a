"""Trace-shaped events from the test tables (FIXTURES.md, section 4)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracerisk.schema import (
    COLUMNS,
    EVICT,
    FAIL,
    FINISH,
    KILL,
    SCHEDULE,
    SEQ,
    SUBMIT,
    UPDATE_RUNNING,
)

# Events of a partition, which one task cleans and sorts in memory.
PARTITION_ROWS = 250_000


def _micros(col: str):
    """Microseconds of a time without zone, read as UTC whatever the zone of the session."""
    local = F.col(col).cast("timestamp")
    return F.unix_micros(F.from_utc_timestamp(local, F.current_timezone()))


def trace_from_events(spark: SparkSession, folder: str, copies: bool = False) -> DataFrame:
    """Raw trace from `events`; with `copies`, every 50th row occurs a second time."""
    rows = spark.read.parquet(f"{folder}/events.parquet")
    kind, event_id = F.col("event_type"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    view = F.when(k % 4 == 0, UPDATE_RUNNING).when(k % 4 == 1, EVICT).otherwise(KILL)
    code = (
        F.when(kind == "signup", SUBMIT)
        .when(kind == "click", SCHEDULE)
        .when(kind == "error", FAIL)
        .when(kind == "purchase", FINISH)
        .otherwise(view)
    )
    trace = rows.select(
        _micros("ts").alias("timestamp"),
        F.lit(None).cast("int").alias("missing_info"),
        F.col("user_id").alias("job_id"),
        (event_id % 4).cast("int").alias("task_index"),
        F.when(kind != "signup", 1000 + (event_id * 7) % 20).alias("machine_id"),
        code.cast("int").alias("event_type"),
        F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("user"),
        (k % 4).alias("scheduling_class"),
        (k % 12).alias("priority"),
        F.when(k % 5 != 0, F.col("value") / 500).alias("cpu_requested"),
        F.when(k % 7 != 0, F.col("value") / 1000).alias("memory_requested"),
        F.when(k % 6 != 0, k / 10000).alias("disk_requested"),
        F.when(k % 9 != 0, k % 2).alias("different_machine"),
        event_id.alias(SEQ),
    )
    if copies:
        again = trace.filter(F.col(SEQ) % 50 == 0)
        trace = trace.unionByName(again.withColumn(SEQ, F.col(SEQ) + F.lit(1 << 40)))
    return trace.select(*COLUMNS, SEQ)


def line_partitions(spark: SparkSession, folder: str, rows: int = PARTITION_ROWS) -> int:
    """Partitions of the trace from `lineitem`: the session's, or more where they would hold over `rows` events each."""
    events = 3 * spark.read.parquet(f"{folder}/lineitem.parquet").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-events // rows))


def trace_from_lineitem(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """Raw trace from `lineitem` and `orders`: SUBMIT, SCHEDULE and a final event per line.

    It lies by job in `parts` partitions, as many as `line_partitions` tells unless given.
    """
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    # Joined by shuffle at any size: the rows then lie by job, and cleaning sends them nowhere else. By number, since
    # partitions merged to the size of the lines would be too large for three events of each.
    n = parts or line_partitions(spark, folder)
    lines, orders = lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    joined = lines.hint("merge").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    submit = _micros("o_orderdate") + (part % 1440) * F.lit(60_000_000).cast("long")
    waited = F.col("l_quantity").cast("long") * 1_000_000
    ran = F.floor("l_extendedprice") * 100_000
    cpu = F.col("l_discount") * 10
    failure = F.when(part % 3 == 0, EVICT).when(part % 3 == 1, FAIL).otherwise(KILL)
    final = F.when(F.col("l_returnflag") == "R", failure).otherwise(FINISH)
    no_machine, no_cpu = F.lit(None).cast("long"), F.lit(None).cast("double")

    # Three events per line, each a number first, so that a reader of few columns reads few of the tables.
    step = F.col("step")

    def event(first, second, third):
        return F.when(step == 0, first).when(step == 1, second).otherwise(third)

    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    # The lines carry no position; event code and content give one (FIXTURES.md, 4.2).
    million = F.lit(1_000_000).cast("long")
    content = (
        ((supplier % million) * million + part % million) * 100 + F.col("l_quantity").cast("long")
    ) * 1000 + F.round(F.col("l_discount") * 100).cast("long") * 10 + F.round(
        F.col("l_tax") * 100
    ).cast("long")
    rows = joined.withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").alias("task_index"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("user"),
        (priority % 4).alias("scheduling_class"),
        priority.alias("priority"),
        F.col("l_tax").alias("memory_requested"),
        (F.col("l_quantity") / 100000).alias("disk_requested"),
        (F.col("l_linenumber") % 2).alias("different_machine"),
        F.lit(None).cast("int").alias("missing_info"),
        content.alias("content"),
        event(submit, submit + waited, submit + waited + ran).alias("timestamp"),
        event(no_machine, supplier, supplier).alias("machine_id"),
        event(F.lit(SUBMIT), F.lit(SCHEDULE), final).cast("int").alias("event_type"),
        event(cpu, F.when(part % 5 != 0, cpu), no_cpu).alias("cpu_requested"),
    )
    tenth = F.lit(10**17).cast("long")
    seq = F.col("event_type").cast("long") * tenth + F.col("content")
    return rows.withColumn(SEQ, seq).select(*COLUMNS, SEQ)
