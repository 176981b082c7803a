"""Stage tables stored by task, so that later work per task needs no shuffle."""

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tracerisk.schema import EVENT_NO, TASK_KEY
from tracerisk.sources.shared import new_path

BUCKETS = 200
# Rows of a bucket, which one task sorts and holds.
BUCKET_ROWS = 500_000


def buckets_for(rows: int, least: int = 1) -> int:
    """Number of buckets for a table of so many rows."""
    return max(least, -(-rows // BUCKET_ROWS))


def write_by_task(
    df: DataFrame, path: str | None = None, buckets: int = BUCKETS, by: Sequence[str] = tuple(TASK_KEY)
) -> str:
    """Write a table in buckets of the task key, sorted by task (and event), and return its name.

    One shuffle puts each bucket into one task, hence one file. Aggregates per
    task and joins of tables with the same number of buckets then read bucket by
    bucket, without an exchange. Where no path is given the table lies in the shared folder and goes with
    the application; the name lives in the session's catalog (`open_by_task` names a stored table anew).

    `by` may name a part of the task key. Rows that lie by it in as many partitions are not shuffled.
    """
    spark = df.sparkSession
    name = f"by_task_{uuid.uuid4().hex}"
    order = [*TASK_KEY, *([EVENT_NO] if EVENT_NO in df.columns else [])]
    rows = df.repartition(buckets, *by)
    writer = rows.write.format("parquet").bucketBy(buckets, *by).sortBy(*order)
    writer.mode("overwrite").option("path", path or new_path(spark)).saveAsTable(name)
    return name


def open_by_task(spark: SparkSession, path: str, like: DataFrame, buckets: int) -> str:
    """Name a table that `write_by_task` left at a path, in a session that doesn't know it yet."""
    name = f"by_task_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    keys = ", ".join(TASK_KEY)
    order = ", ".join([*TASK_KEY, *([EVENT_NO] if EVENT_NO in like.columns else [])])
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({keys}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return name
