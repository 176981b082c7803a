"""Stratified split and folds, class weights."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracerisk.functions import stable_hash
from tracerisk.schema import TASK_KEY
from tracerisk.sources.shared import materialize

# Most rows of a file that fits read again and again; rows per core below which even files don't pay.
FIT_ROWS, LEAST_FIT_ROWS = 500_000, 25_000
# Leading hexadecimal digits that cut the digests into 65,536 even buckets per label.
_DIGITS = 4


def _hashed(df: DataFrame, seed: int) -> DataFrame:
    key = stable_hash(seed, *TASK_KEY)
    return df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, _DIGITS))


def _bucket_starts(hashed: DataFrame) -> DataFrame:
    """Per label and bucket: its rows, the rows before it, and the rows of the label."""
    before = (
        Window.partitionBy("label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = hashed.groupBy("label", "_bucket").agg(F.count("*").alias("_size"))
    return counts.select(
        "label",
        "_bucket",
        "_size",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy("label")).alias("_total"),
    )


def stratified_split(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add `split`: in every label, the round(test_size * n) smallest digests are "test".

    Counts per digest bucket show which bucket holds the last test row of a
    label; only that bucket is ranked, to find the digest to compare with. The
    rows themselves are never shuffled. Needs one row per task, read three times.
    """
    hashed = _hashed(df, seed)
    starts = _bucket_starts(hashed).withColumn("_wanted", F.round(F.col("_total") * test_size))
    wanted = F.col("_wanted")
    # At most one row per label, as has `last`.
    edge = starts.filter(
        (F.col("_before") < wanted) & (wanted <= F.col("_before") + F.col("_size"))
    ).select("label", "_bucket", (wanted - F.col("_before")).alias("_rank"))

    row = F.struct("_key", *TASK_KEY)
    in_edge = hashed.select("label", "_bucket", row.alias("_last"))
    in_edge = in_edge.join(F.broadcast(edge), ["label", "_bucket"])
    number = F.row_number().over(Window.partitionBy("label").orderBy("_last"))
    last = in_edge.withColumn("_no", number).filter(F.col("_no") == F.col("_rank"))
    compared = hashed.join(F.broadcast(last.select("label", "_last")), "label", "left")
    is_test = F.coalesce(row <= F.col("_last"), F.lit(False))
    split = F.when(is_test, "test").otherwise("train").alias("split")
    return compared.select(*df.columns, split)


def stratified_folds(df: DataFrame, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold` (0 to n_splits - 1): the row number in digest order of the label, modulo folds."""
    hashed = _hashed(df, seed)
    # 65,536 rows per label at most.
    starts = _bucket_starts(hashed).select("label", "_bucket", "_before")
    within = Window.partitionBy("label", "_bucket").orderBy("_key", *TASK_KEY)
    number = F.row_number().over(within) - 1 + F.col("_before")
    # The digest is computed again behind the shuffle: it is as long as many a row.
    spread = hashed.drop("_key").repartition("label", "_bucket")
    return (
        spread.withColumn("_key", stable_hash(seed, *TASK_KEY))
        .join(F.broadcast(starts), ["label", "_bucket"])
        .withColumn("fold", (number % n_splits).cast("int"))
        .select(*df.columns, "fold")
    )


def laid_out(rows: DataFrame, n_rows: int) -> DataFrame:
    """The rows, `n_rows` of them, written once in a fixed order, in even files that the cores read in full rounds.

    Fits read them in hundreds of short jobs, each as long as its slowest core: ten files on eight cores
    take two rounds. Seeded samples of the tree models are drawn by position, so the same rows on as
    many cores give the same models. A small table lies as Spark merges its shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if n_rows < cores * LEAST_FIT_ROWS:
        placed = rows.repartition(*TASK_KEY)
    else:
        placed = rows.repartition(cores * -(-n_rows // (cores * FIT_ROWS)), *TASK_KEY)
    return materialize(placed.sortWithinPartitions(*TASK_KEY))


def prepare_data(
    matrix: DataFrame, test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test frames, from one written table of the split matrix (`laid_out`)."""
    matrix = materialize(matrix)
    parts = laid_out(stratified_split(matrix, test_size, seed), matrix.count())
    train = parts.filter(F.col("split") == "train").drop("split")
    return train, parts.filter(F.col("split") == "test").drop("split")


def split_distribution(split: DataFrame) -> DataFrame:
    """Tasks per split and label."""
    return split.groupBy("split", "label").agg(F.count("*").alias("n_tasks"))


def class_counts(df: DataFrame) -> tuple[int, int]:
    """Rows with label 0 and with label 1."""
    row = df.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    return row[0], row[1]


def balanced_weight(negatives: int, positives: int) -> Column:
    """Weight n / (2 * n of the class), so both classes weigh the same."""
    n = negatives + positives
    positive = F.lit(n / (2.0 * max(positives, 1)))
    return F.when(F.col("label") == 1, positive).otherwise(F.lit(n / (2.0 * max(negatives, 1))))


def positive_weight(scale: float) -> Column:
    """Weight `scale` for label 1, else 1."""
    return F.when(F.col("label") == 1, F.lit(float(scale))).otherwise(F.lit(1.0))


def positive_scale(negatives: int, positives: int) -> float:
    """Negatives per positive."""
    return negatives / max(positives, 1)


def class_weights(df: DataFrame) -> DataFrame:
    """Both kinds of weight per label as a table."""
    n = F.count("*")
    negatives, positives = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    counts = df.agg(n.alias("n"), negatives.alias("n0"), positives.alias("n1"))

    def row(label, own, scale):
        return F.struct(
            F.lit(label).alias("label"),
            F.try_divide(F.col("n").cast("double"), own * 2).alias("balanced_weight"),
            scale.alias("positive_weight"),
        )

    scale = F.try_divide(F.col("n0").cast("double"), F.col("n1"))
    rows = F.array(row(0, F.col("n0"), F.lit(1.0)), row(1, F.col("n1"), scale))
    return counts.select(F.inline(rows))
