"""Helpers that several operators of this folder share."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Bytes of text that a Python worker handles at once; one longer text is a block of its own.
BLOCK_BYTES = 1 << 20
# Rows of a table that may be broadcast, if each has at most a few dozen bytes.
BROADCAST_ROWS = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of all learning. Null stays null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is held out; rows without an id are, as nothing may be learned from them."""
    return F.coalesce(fold_of(doc_id) == 0, F.lit(True))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts (null as empty) of about `limit` characters, with the first row's number."""
    start, size, run = 0, 0, []
    for text in texts:
        value = text.as_py() or ""
        run.append(value)
        size += len(value)
        if size >= limit:
            yield start, run
            start, size, run = start + len(run), 0, []
    if run:
        yield start, run


def with_columns(
    df: DataFrame,
    text: str,
    schema: str,
    fn: Callable[[list[str]], list],
    keep: Sequence[str] | None = None,
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """Add the columns of `schema`, computed by `fn` from runs of whole texts; no shuffle.

    `fn` takes a list of strings and returns one sequence (or Arrow array) per new
    column. The columns `keep` (all by default) stay; one with the name of a new
    column is replaced.
    """
    added = T.StructType.fromDDL(schema)
    names = [f.name for f in added]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    whole = T.StructType([*(df.schema[c] for c in kept), *added])
    source = df.select(*kept) if text in kept else df.select(*kept, text)
    fields = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for start, texts in blocks(column, limit):
                new = [
                    x if isinstance(x, pa.Array) else pa.array(x, type=fields.field(i).type)
                    for i, x in enumerate(fn(texts))
                ]
                part = batch.slice(start, len(texts))
                old = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*old, *new], names=[*kept, *names])

    return source.mapInArrow(run, whole)


def sample_rows(df: DataFrame, rows: int, key: str) -> DataFrame:
    """At most `rows` rows, those whose key has the smallest hashes, the same at any partitioning.

    Rows that can't be among them are left out first, by the share that is wanted of
    all, so that the task that picks gets a few times `rows`, however many there
    are. Give it narrow rows.
    """
    share = min(1.0, 4 * rows / max(df.count(), 1))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    few = df.withColumn("_place", place).filter(F.col("_place") <= int(share * (1 << 40)))
    return few.orderBy("_place", key).limit(rows).drop("_place")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
