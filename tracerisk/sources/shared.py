"""Intermediate tables in the shared folder of the cluster."""

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_owned: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; where it is unset, the warehouse folder, which all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """Folder of this application below the shared one; removed by `release` or when Python ends."""
    path = f"{shared_folder(spark)}/tracerisk/{spark.sparkContext.applicationId}"
    if path not in _owned:
        if not _owned:
            atexit.register(_release_all)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        _owned[path] = (place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place)
    return path


def new_path(spark: SparkSession) -> str:
    """A path for one more intermediate table."""
    return f"{own_folder(spark)}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; frames that read them end with it."""
    files, place = _owned.pop(own_folder(spark))
    files.delete(place, True)


def _release_all() -> None:
    for files, place in _owned.values():
        try:
            files.delete(place, True)
        except Exception:  # the JVM has ended before: its tables stay
            break


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame as a Parquet table and read it back.

    Used where several branches read one costly result: the lineage ends at the
    table, a lost executor costs only its own tasks, and each branch scans just
    the columns it needs. Files stay until the application ends or calls `release`.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
