"""Window counts of a trace that still arrives: the streaming form of two features' lookups."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracerisk.operators.features import on_machine
from tracerisk.schema import SCHEDULE, SUBMIT

# Progress reports that a query keeps: more than it has batches, as late rows are summed from them.
_REPORTS = "spark.sql.streaming.numRecentProgressUpdates"
_MANY = "100000"
# Time of the mark that ends a stream, in microseconds: the year 9000.
END = 221_845_392_000_000_000


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Cleaned events as they arrive as Parquet files in a folder, oldest files first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def write_end_mark(spark: SparkSession, folder: str, schema: T.StructType) -> None:
    """Add a row without a machine from the far future: it closes all windows and is in none that is told."""
    row = tuple(END if f.name == "timestamp" else None for f in schema.fields)
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    spark.createDataFrame([row], nullable).coalesce(1).write.mode("append").parquet(folder)


def _counted(stream: DataFrame, wanted: Column) -> DataFrame:
    """The wanted rows and the end mark. Spark filters before it notes times, so only these move the watermark."""
    return stream.filter(wanted | (F.col("timestamp") == END))


def _windowed(stream: DataFrame, window_seconds: int, delay: str) -> tuple[DataFrame, Column]:
    timed = stream.withColumn("_time", F.timestamp_micros("timestamp")).withWatermark("_time", delay)
    return timed, F.window("_time", f"{window_seconds} seconds").alias("_window")


def _numbered(window_seconds: int) -> Column:
    """Number of the window since the epoch, as `bucket` counts it."""
    width = F.lit(window_seconds * 1_000_000).cast("long")
    return F.floor(F.unix_micros("_window.start") / width).alias("time_window")


def stream_schedules_per_slot(stream: DataFrame, window_seconds: int = 300, delay: str = "1 hour") -> DataFrame:
    """SCHEDULE events per real machine and tumbling window, as `schedules_per_slot` on a stream.

    The counted events move the watermark, `delay` behind the latest. A window is given once, when the
    watermark passes its end; events of windows that have been given are dropped as late. State
    holds open windows only.
    """
    timed, window = _windowed(_counted(stream, on_machine()), window_seconds, delay)
    counted = timed.groupBy("machine_id", window).agg(F.count("*").alias("concurrency_density"))
    return counted.select("machine_id", _numbered(window_seconds), "concurrency_density")


def stream_waiting_priority(stream: DataFrame, window_seconds: int = 60, delay: str = "1 hour") -> DataFrame:
    """Highest SUBMIT priority and number of SCHEDULE events per window, as `waiting_priority` on a stream."""
    code = F.col("event_type")
    timed, window = _windowed(_counted(stream, code.isin(SUBMIT, SCHEDULE)), window_seconds, delay)
    counted = timed.groupBy(window).agg(
        F.max(F.when(code == SUBMIT, F.col("priority"))).alias("max_waiting_priority"),
        F.count_if(code == SCHEDULE).alias("schedules"),
    )
    return counted.select(_numbered(window_seconds), "max_waiting_priority", "schedules")


def run_to_end(result: DataFrame, out: str, checkpoint: str) -> int:
    """Process all files that are there, append closed windows to the Parquet table `out`, and stop.

    A later run with the same checkpoint goes on where this one ended. Returns the number of late rows
    that were dropped; rows of one window are combined in their task first and count once.
    """
    spark = result.sparkSession
    before = spark.conf.get(_REPORTS)
    spark.conf.set(_REPORTS, _MANY)
    try:
        query = (
            result.writeStream.format("parquet")
            .outputMode("append")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_REPORTS, before)
    operators = [s for p in query.recentProgress for s in p["stateOperators"]]
    return sum(s["numRowsDroppedByWatermark"] for s in operators)
