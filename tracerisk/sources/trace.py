"""Reading the raw trace."""

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracerisk.schema import COLUMNS, SEQ, TRACE_SCHEMA

# Bits of `ingest_seq`: part, megabyte where the split starts, row in the task.
PART_BITS, START_BITS, ROW_BITS = 20, 16, 27
# A path takes a few hundred bytes.
BROADCAST_PARTS = 100_000
_CORRUPT = "_corrupt_record"
_WHOLE = (T.IntegerType(), T.LongType())
# Whole numbers are read as text, so that `5.0` counts as 5 and anything else is noticed.
_TEXT_SCHEMA = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.dataType in _WHOLE else f.dataType)
        for f in TRACE_SCHEMA
    ]
)


def listed_parts(spark: SparkSession, path: str, n_parts: int | None = None) -> list[Row]:
    """The first `n_parts` parts in name order (all for None): path, uri, part (name), length, modified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,csv.gz}").load(path)
    listed = files.select(
        "path",
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_name").alias("part"),
        "length",
        F.col("modificationTime").alias("modified"),
    )
    # One row per file: no longer than the listing that the scan itself keeps on the driver.
    parts = listed.orderBy("path").collect()
    if not parts:
        raise FileNotFoundError(f"no .csv or .csv.gz part in {path}")
    return parts if n_parts is None else parts[:n_parts]


def list_parts(spark: SparkSession, path: str, n_parts: int | None = None) -> list[str]:
    """Paths of the first `n_parts` CSV parts (plain or gzip) in name order; all for None."""
    return [r["path"] for r in listed_parts(spark, path, n_parts)]


def _whole(col: Column) -> Column:
    """The number that a text like `5` or `5.0` stands for; null for other texts."""
    return F.regexp_extract(F.trim(col), r"^([+-]?\d+)(\.0*)?$", 1).try_cast("decimal(38,0)")


def _typed(field: T.StructField, strict: bool) -> Column:
    col = F.col(field.name)
    if field.dataType in _WHOLE:
        value = _whole(col).try_cast(field.dataType)
        if strict:
            bad = F.raise_error(F.concat(F.lit(f"{field.name} is not a whole number: "), col))
            value = F.when(col.isNotNull() & value.isNull(), bad.cast(field.dataType)).otherwise(value)
        return value.alias(field.name)
    if isinstance(field.dataType, T.DoubleType):
        return F.when(~F.isnan(col), col).alias(field.name)
    return col


def load_trace_parts(
    spark: SparkSession, path: str, n_parts: int | None = None, strict: bool = True
) -> DataFrame:
    """Raw event log of all parts (or the first ones), with `ingest_seq` following file order.

    `ingest_seq` packs the part number, the megabyte where the split starts and
    the row number in the task, so it grows with the position in the input
    whatever way Spark packs splits into tasks. A row of another width, or a value
    that is no number where one belongs, is an error; if not `strict`, such values
    are null (see `rejected_rows`). NaN is read as null.
    """
    parts = [(r["path"], r["uri"]) for r in listed_parts(spark, path, n_parts)]
    return load_parts(spark, parts, strict)


def load_parts(
    spark: SparkSession, parts: list[tuple[str, str]], strict: bool = True, first: int = 0
) -> DataFrame:
    """Rows of the given parts (path and URI), numbered from `first` in this order."""
    if first + len(parts) >= 1 << PART_BITS:
        raise ValueError(f"{first + len(parts)} parts; load at most {(1 << PART_BITS) - 1}")
    names = [(part, first + i) for i, (_, part) in enumerate(parts)]
    numbers = spark.createDataFrame(names, "_part string, _no long")
    if len(parts) <= BROADCAST_PARTS:
        numbers = F.broadcast(numbers)
    rows = (
        spark.read.schema(_TEXT_SCHEMA)
        .option("header", False)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .option("columnPruning", False)  # else a row's width is not seen by a query of few columns
        .csv([p for p, _ in parts])
        .select(
            *[_typed(f, strict) for f in TRACE_SCHEMA],
            F.col("_metadata.file_path").alias("_part"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    in_task = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    megabyte = F.shiftright("_start", 20)
    fits = (in_task < 1 << ROW_BITS) & (megabyte < 1 << START_BITS) & F.col("_no").isNotNull()
    seq = F.shiftleft("_no", START_BITS + ROW_BITS) + F.shiftleft(megabyte, ROW_BITS) + in_task
    out_of_range = F.raise_error(F.lit("no place in the input for a row")).cast("long")
    checked = F.when(fits, seq).otherwise(out_of_range)
    return rows.join(numbers, "_part", "left").select(*COLUMNS, checked.alias(SEQ))


def rejected_rows(spark: SparkSession, path: str, n_parts: int | None = None) -> DataFrame:
    """Part and text of every row that the strict reader refuses."""
    schema = T.StructType([*_TEXT_SCHEMA, T.StructField(_CORRUPT, T.StringType())])
    bad = F.col(_CORRUPT).isNotNull()
    for f in TRACE_SCHEMA:
        if f.dataType in _WHOLE:
            value = _whole(F.col(f.name)).try_cast(f.dataType)
            bad = bad | (F.col(f.name).isNotNull() & value.isNull())
    text = F.coalesce(_CORRUPT, F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS]))
    return (
        spark.read.schema(schema)
        .option("header", False)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("columnPruning", False)
        .csv(list_parts(spark, path, n_parts))
        .filter(bad)
        .select(F.col("_metadata.file_name").alias("part"), text.alias("record"))
    )


def rows_per_part(spark: SparkSession, path: str, n_parts: int | None = None) -> DataFrame:
    """Number of rows in every part."""
    return (
        spark.read.schema(TRACE_SCHEMA)
        .option("header", False)
        .csv(list_parts(spark, path, n_parts))
        .groupBy(F.col("_metadata.file_name").alias("part"))
        .agg(F.count("*").alias("n_rows"))
    )
