"""Training corpus from raw documents: five stages, each a table that the next one reads."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracerisk.llm import language_id, near_dedup, packing, secret_scan, toxicity
from tracerisk.sources.shared import new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was told: those without letters (null and empty texts too) and ambiguous ones go."""
    model = language_id.train_language_model(docs)
    told = language_id.predict_language(docs, model)
    clear = (F.col("lang_pred") != language_id.UNDETERMINED) & ~F.col("ambiguous")
    return told.filter(clear).select(*docs.columns)


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; null and empty texts are scored as a blank window."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, toxicity.train_toxicity_model(docs, labels))
    return scored.filter("predicted = 0").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; null and empty texts are copies of each other."""
    return near_dedup.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; n_chars follows the text, and is null for a null one."""
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Plan of the training sequences: which piece of which document goes where. A null or empty text has no bin."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("toxicity", filter_toxic),
    ("near-duplicates", deduplicate),
    ("secrets", redact),
    ("packing", pack),
]

# SQL can express neither the learned stages nor the packing; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each result is written to the shared folder and read again."""
    return _run(spark, sf_dir, new_path(spark))[-1]


def _run(spark: SparkSession, sf_dir: str, folder: str) -> list[DataFrame]:
    """The tables that the stages leave in a folder, one after the other."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        tables.append(docs)
    return tables


def write_corpus(spark: SparkSession, sf_dir: str, out: str) -> None:
    """The corpus itself, below a folder of the caller's: `documents` as they were packed, the `plan`, and `sequences`.

    A sequence is the text of a bin, its pieces in order. Documents without an id are in the
    first two tables only, since nothing tells which piece is whose.
    """
    *_, documents, plan = _run(spark, sf_dir, new_path(spark))
    documents.write.parquet(f"{out}/documents")
    plan.write.parquet(f"{out}/plan")
    packing.packed_texts(documents, plan).write.parquet(f"{out}/sequences")
