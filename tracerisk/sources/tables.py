"""Tables between stages, result files and fitted models."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a stage table as Parquet, or as CSV with a header."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None
) -> DataFrame:
    """Read a stage table. CSV needs the schema: inferring it costs a pass of its own."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_result(df: DataFrame, path: str) -> None:
    """Write a result table of a few rows as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Save a fitted model; the folder is made or replaced."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Read a saved model back."""
    return PipelineModel.load(path)
