"""Best-fit packing of documents into sequences, with conflicts of source and duplicate cluster."""

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracerisk.sources import materialize

# Characters of a sequence, and pieces that one task packs.
CAPACITY, SHARD_ROWS = 8_192, 4_096
PLAN_SCHEMA = "bin_id long, position int, doc_id long, start long, length long"


def best_fit(
    lengths: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int
) -> list[int]:
    """Bin number of every piece, taken in the given order.

    Open bins are ordered by what is left in them; per residual, per source and per
    cluster a bitmap tells the bins that have it. The successor search starts at the
    first residual that holds the piece and goes on until one has a bin without the
    piece's source and cluster: the tightest compatible bin. Of equally tight ones
    the oldest is taken; without any, a bin is opened. A null source or cluster conflicts with nothing.
    """
    residuals: list[int] = []
    open_at: dict[int, int] = {}
    holding: dict[tuple, int] = {}
    out, bins = [], 0
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        keys = [(k, v) for k, v in (("source", source), ("cluster", cluster)) if v is not None]
        blocked = 0
        for key in keys:
            blocked |= holding.get(key, 0)
        left, bit = capacity, 1 << bins
        for i in range(bisect_left(residuals, length), len(residuals)):
            free = open_at[residuals[i]] & ~blocked
            if free:
                left, bit = residuals[i], free & -free
                break
        if bit == 1 << bins:
            bins += 1
        else:
            open_at[left] ^= bit
            if not open_at[left]:
                del open_at[left]
                del residuals[bisect_left(residuals, left)]
        left -= length
        if left:
            if left not in open_at:
                open_at[left] = 0
                insort(residuals, left)
            open_at[left] |= bit
        for key in keys:
            holding[key] = holding.get(key, 0) | bit
        out.append(bit.bit_length() - 1)
    return out


def pack_documents(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Plan of sequences of at most `capacity` characters: one row per piece.

    bin_id and position say where a piece goes, doc_id, start and length (in
    characters) what it is. A text longer than the capacity is cut; its full pieces
    fill a bin each, what remains is packed. No bin has two packed pieces of one
    source, or of one duplicate cluster (equal texts, unless `cluster` is given).

    Only numbers are packed, never texts. The pieces are written once, dealt evenly by hash
    to shards of about `shard_rows`, whose number grows with them, and each shard is
    packed largest first, ties by id, cluster and place. Cutting into shards costs
    at most a few open bins each.

    Every document comes out: a null or empty text as one row of length 0 without a
    bin. Repeated rows are packed each by itself, in different bins. A null id stays null.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    same = F.md5(body) if cluster is None else cluster.cast("string")
    items = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        same.alias("cluster"),
        F.length(body).cast("long").alias("size"),
    )
    items = materialize(items)
    empty = items.filter("size = 0").select(
        F.lit(None).cast("long").alias("bin_id"),
        F.lit(None).cast("int").alias("position"),
        "doc_id",
        F.lit(0).cast("long").alias("start"),
        F.lit(0).cast("long").alias("length"),
    )
    shards = max(1, -(-items.filter("size > 0").count() // shard_rows))
    # The scan of a written table numbers its rows alike each time.
    number = F.monotonically_increasing_id()
    dealt = items.filter("size > 0").withColumn("number", number)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "number"), F.lit(shards)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(rest=group["size"] % capacity)
        order = ["rest", "doc_id", "cluster", "number"]
        group = group.sort_values(order, ascending=[False, True, True, True], kind="stable")
        first = int(group["shard"].iloc[0]) << 40
        rows, used = [], 0
        part = group[group["rest"] > 0]
        ids = [None if pd.isna(x) else int(x) for x in part["doc_id"]]
        names = [None if pd.isna(x) else x for x in part["source"]]
        alike = [None if pd.isna(x) else x for x in part["cluster"]]
        rest = [int(x) for x in part["rest"]]
        filled: dict[int, int] = {}
        bins = best_fit(rest, names, alike, capacity)
        for b, i, size, length in zip(bins, ids, part["size"], rest, strict=True):
            rows.append((first + b, filled.get(b, 0), i, int(size) - length, length))
            filled[b] = filled.get(b, 0) + 1
        used = max(bins, default=-1) + 1
        whole = group[group["size"] >= capacity]
        for i, size in zip(whole["doc_id"], whole["size"], strict=True):
            for k in range(int(size) // capacity):
                name = None if pd.isna(i) else int(i)
                rows.append((first + used, 0, name, k * capacity, capacity))
                used += 1
        plan = pd.DataFrame(rows, columns=["bin_id", "position", "doc_id", "start", "length"])
        return plan.astype({"doc_id": "Int64"})

    packed = dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(run, PLAN_SCHEMA)
    return packed.unionByName(empty)


def packed_texts(
    docs: DataFrame, plan: DataFrame, text: str = "text", doc_id: str = "doc_id", glue: str = "\n"
) -> DataFrame:
    """The sequences themselves: bin_id and text, pieces in order, joined by `glue`.

    For documents with distinct ids. The texts are shuffled once to their pieces and
    once to their bins; a bin holds at most its capacity.
    """
    pieces = plan.filter(F.col("bin_id").isNotNull()).join(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")), "doc_id"
    )
    start, size = (F.col("start") + 1).cast("int"), F.col("length").cast("int")
    cut = F.struct("position", F.substr("_text", start, size).alias("t"))
    grouped = pieces.select("bin_id", cut.alias("p")).groupBy("bin_id")
    joined = F.transform(F.array_sort(F.collect_list("p")), lambda p: p.t)
    return grouped.agg(F.array_join(joined, glue).alias("text"))
