"""Queries of this folder's operators and their DuckDB counterparts."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracerisk.llm import (
    ann,
    bpe,
    collocations,
    jaccard_join,
    language_id,
    license_scan,
    near_dedup,
    packing,
    quality,
    secret_scan,
    toxicity,
    url_filter,
    whitening,
)
from tracerisk.llm.common import held_out

Query = Callable[[SparkSession, str], DataFrame]

# The rules of the URL query (fixed values).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_dedup.near_duplicates(_table(spark, folder, "documents"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(_table(spark, folder, "pages"), rules)


def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every 20th vector among all others."""
    vectors = _table(spark, folder, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document's text and the bytes they decode to, as digests."""
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    encoded = bpe.encode_texts(docs, tokens, public_tokenizers.PATTERN, keep=["doc_id"])
    decoded = bpe.decode_ids(encoded, tokens)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Plan of the sequences that hold all documents."""
    return packing.pack_documents(_table(spark, folder, "documents"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.train_language_model(docs)
    found = language_id.predict_language(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every document; its path is source, thousand, hundred and ten of the id, id.

    Every tenth document lies at the hundred's level, every hundredth at the thousand's: files at several depths.
    """
    digits = [F.expr(f"doc_id div {k}").cast("string") for k in (1000, 100, 10)]
    own = F.col("doc_id").cast("string")
    deep = F.concat_ws("/", "source", *digits, own)
    path = F.when(F.col("doc_id") % 100 == 0, F.concat_ws("/", "source", digits[0], own))
    path = path.when(F.col("doc_id") % 10 == 0, F.concat_ws("/", "source", *digits[:2], own)).otherwise(deep)
    return license_scan.scan_licenses(_table(spark, folder, "documents"), path)


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, their digest, and all spans."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs, keep=["doc_id"])
    base = [r.kind for r in secret_scan.BASE_RULES]
    return found.select(
        "doc_id",
        *[secret_scan.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secret_scan.span_text(F.col("spans"), base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
    )


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity_model(docs, _table(spark, folder, "labels"))
    scored = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics and verdict of every document, hosts being the sources."""
    judged = quality.quality_rules(_table(spark, folder, "documents"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Number of shingles and component of every document."""
    return jaccard_join.jaccard_components(_table(spark, folder, "documents"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return collocations.collocations(_table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The first four whitened coordinates of every vector."""
    return whitening.whiten(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_nearest": op3_nearest,
    "op4_bpe": op4_bpe,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_secret_scan": op8_secret_scan,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}
