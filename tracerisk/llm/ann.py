"""Approximate nearest neighbours: one navigable small-world graph per shard, results merged."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracerisk.sources import materialize

# Distinct vectors of a shard, at most on average, and shards at least.
SHARD_ROWS, LEAST_SHARDS = 50_000, 6
# Vectors share a shard if their largest components lie within the same 2^GRADE.
GRADE = 3
# Neighbours on the upper layers (the lowest has twice as many), and beam widths.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 48, 96
# Queries that one task of a shard takes, and those that walk the graph in step.
QUERY_BLOCK, IN_STEP = 16_384, 128
INDEX_SCHEMA = "shard int, n int, dim int, vectors binary, entry int, layers array<binary>"


class Graph:
    """Layers of flat neighbour arrays (row x slot, -1 for none) over the rows of a matrix.

    The rows are the vectors, extended by one component so that all have the same
    length: the nearest by distance then has the largest inner product.
    """

    def __init__(self, points: np.ndarray, layers: list[np.ndarray], entry: int):
        self.points, self.layers, self.entry = points, layers, entry

    def walk(self, queries: np.ndarray, entries: np.ndarray, layer: int, beam: int):
        """Best-first search of one layer for many queries in step: row numbers and products.

        Each query keeps the `beam` best rows found; every step expands its best
        unexpanded row, until none is left. `entries` has start rows per query (-1 for none).
        """
        links, points = self.layers[layer], self.points
        n, width = len(queries), links.shape[1]
        seen = np.zeros((n, len(points)), bool)
        rows = np.full((n, beam), -1, np.int64)
        score = np.full((n, beam), -np.inf, np.float32)
        fresh = np.zeros((n, beam), bool)

        def merge(who: np.ndarray, new: np.ndarray) -> None:
            ok = new >= 0
            safe = np.where(ok, new, 0)
            ok &= ~seen[who[:, None], safe]
            a, b = np.nonzero(ok)
            seen[who[a], safe[a, b]] = True
            value = np.einsum("qd,qsd->qs", queries[who], points[safe])
            value[~ok] = -np.inf
            all_rows = np.concatenate([rows[who], np.where(ok, new, -1)], axis=1)
            all_score = np.concatenate([score[who], value], axis=1)
            all_fresh = np.concatenate([fresh[who], ok], axis=1)
            keep = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
            rows[who] = np.take_along_axis(all_rows, keep, 1)
            score[who] = np.take_along_axis(all_score, keep, 1)
            fresh[who] = np.take_along_axis(all_fresh, keep, 1)

        merge(np.arange(n), entries)
        active = np.arange(n)
        while len(active):
            open_score = np.where(fresh[active], score[active], -np.inf)
            pick = open_score.argmax(1)
            some = open_score[np.arange(len(active)), pick] > -np.inf
            active, pick = active[some], pick[some]
            if not len(active):
                break
            at = rows[active, pick]
            fresh[active, pick] = False
            merge(active, links[at][:, :width])
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(rows, order, 1), np.take_along_axis(score, order, 1)

    def search(self, queries: np.ndarray, beam: int = SEARCH_BEAM):
        """Descend through the layers, then search the lowest with the full beam."""
        found_rows, found_score = [], []
        for i in range(0, len(queries), IN_STEP):
            part = queries[i : i + IN_STEP]
            starts = np.full((len(part), 1), self.entry, np.int64)
            for layer in range(len(self.layers) - 1, 0, -1):
                starts = self.walk(part, starts, layer, 4)[0]
            rows, score = self.walk(part, starts, 0, beam)
            found_rows.append(rows)
            found_score.append(score)
        return np.concatenate(found_rows), np.concatenate(found_score)


def _diverse(points: np.ndarray, row: int, near: np.ndarray, most: int) -> np.ndarray:
    """Neighbours nearest first, leaving out those closer to a chosen one; filled up with the rest."""
    near = near[near >= 0]
    if len(near) <= most:
        return near
    to_row = points[near] @ points[row]
    near = near[np.argsort(-to_row, kind="stable")]
    to_row = points[near] @ points[row]
    between = points[near] @ points[near].T
    chosen: list[int] = []
    for i in range(len(near)):
        if len(chosen) == most:
            break
        if not chosen or between[i, chosen].max() <= to_row[i]:
            chosen.append(i)
    rest = [i for i in range(len(near)) if i not in set(chosen)]
    return near[np.array([*chosen, *rest[: most - len(chosen)]], int)]


def _extended(vectors: np.ndarray) -> np.ndarray:
    """The vectors over the length of the longest, with the component that brings all to that length, in float32."""
    scaled = vectors / max(np.abs(vectors).max(initial=0), np.finfo(float).tiny)
    length = (scaled**2).sum(1)
    longest = length.max(initial=0) or 1.0
    extra = np.sqrt(np.maximum(longest - length, 0))
    return (np.column_stack([scaled, extra]) / np.sqrt(longest)).astype(np.float32)


def build_graph(vectors: np.ndarray, seed: int = 1) -> Graph:
    """Insert rows in growing batches, each searched in the graph of the rows before it.

    A row's layers follow the usual exponential draw, seeded. Within a batch, rows
    also see the batch itself, so none is left without neighbours.
    """
    points = _extended(vectors)
    n = len(points)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 8)
    order = np.arange(n)
    # The tallest row comes first and is the entry.
    top = int(level.argmax()) if n else 0
    order[[0, top]] = order[[top, 0]]
    layers = [
        np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(level.max(initial=0) + 1)
    ]
    graph = Graph(points, layers, top)

    def connect(row: int, near: np.ndarray, layer: int) -> None:
        links = layers[layer]
        width = links.shape[1]
        chosen = _diverse(points, row, near[near != row], LINKS)
        links[row, : len(chosen)] = chosen
        for other in chosen:
            own = links[other]
            if row in own:
                continue
            used = int((own >= 0).sum())
            if used < width:
                own[used] = row
            else:
                kept = _diverse(points, int(other), np.append(own, row).astype(np.int64), width)
                own[:] = -1
                own[: len(kept)] = kept

    done = 1
    while done < n:
        batch = order[done : done + max(1, min(IN_STEP, done // 4))]
        starts = np.full((len(batch), 1), top, np.int64)
        within = points[batch] @ points[batch].T
        for layer in range(len(layers) - 1, -1, -1):
            near = graph.walk(points[batch], starts, layer, BUILD_BEAM if layer == 0 else 16)[0]
            starts = near[:, :8]
            here = level[batch] >= layer
            for i in np.flatnonzero(here):
                mates = np.flatnonzero(here)
                mates = mates[np.argsort(-within[i, mates], kind="stable")][: LINKS + 1]
                found = np.unique(np.concatenate([near[i], batch[mates]]))
                connect(int(batch[i]), found, layer)
        done += len(batch)
    return graph


def usable_vectors(table: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """vec_id and v (doubles) of rows with an id whose vector is non-zero and finite throughout."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    return table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(
        whole & F.col("vec_id").isNotNull()
    )


def _distinct(vectors: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: v, its k smallest ids, ascending, and its grade by size (`GRADE`).

    Each task first reduces its own copies, so a vector that a third of all rows
    share crosses the shuffle once per task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, v in zip(batch["vec_id"], batch["v"], strict=True):
                ids = own.setdefault((np.asarray(v, np.float64) + 0.0).tobytes(), [])
                ids.append(i)
                if len(ids) > 4 * k:
                    ids[:] = sorted(set(ids))[:k]
            if len(own) > SHARD_ROWS:
                yield _frame(own)
                own = {}
        if own:
            yield _frame(own)

    def _frame(own):
        largest = [np.abs(np.frombuffer(v, np.float64)).max() for v in own]
        grade = np.floor(np.log2(largest) / GRADE).astype(np.int32)
        return pd.DataFrame({"v": list(own), "grade": grade, "ids": [sorted(set(x))[:k] for x in own.values()]})

    partial = vectors.mapInPandas(run, "v binary, grade int, ids array<bigint>")
    together = partial.groupBy("v", "grade").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return together.select("v", "grade", F.slice(F.array_sort(F.array_distinct("ids")), 1, k).alias("ids"))


def _matrix(raw, dim: int) -> np.ndarray:
    """Doubles of binary vectors; shorter ones are filled up with zeros, as a product would read them."""
    out = np.zeros((len(raw), dim))
    for i, b in enumerate(raw):
        v = np.frombuffer(b, np.float64)
        out[i, : len(v)] = v
    return out


def build_index(distinct: DataFrame, dim: int, shards: int) -> DataFrame:
    """One row per shard: its vectors, entry row and layers of flat neighbour arrays (int32)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v", kind="stable")
        raw = group["v"].to_list()
        graph = build_graph(_matrix(raw, dim))
        return pd.DataFrame(
            {
                "shard": [int(group["shard"].iloc[0])],
                "n": [len(raw)],
                "dim": [dim],
                "vectors": [_matrix(raw, dim).tobytes()],
                "entry": [graph.entry],
                "layers": [[x.tobytes() for x in graph.layers]],
                "ids": [[list(x) for x in group["ids"]]],
            }
        )

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            for _, group in pd.concat(parts).groupby("shard"):
                yield run(group)

    # A shard is a partition, so no task gets two.
    dealt = distinct.repartitionById(shards, "shard")
    return dealt.mapInPandas(build, f"{INDEX_SCHEMA}, ids array<array<bigint>>")


def _dealt(distinct: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """The vectors with `shard`, and the number of shards: those of a grade are dealt by hash among its shards.

    Products are compared in float32 with vectors brought to one length, which a single
    long vector would blunt for all others of its shard. Grades are few: a double has at most 2,100 / GRADE.
    """
    sizes = distinct.groupBy("grade").agg(F.count("*").alias("n")).orderBy("grade").collect()
    least = -(-LEAST_SHARDS // len(sizes))
    rows, total = [], 0
    for r in sizes:
        own = max(least if r["n"] >= LEAST_SHARDS else 1, -(-r["n"] // shard_rows))
        rows.append((r["grade"], total, own))
        total += own
    starts = distinct.sparkSession.createDataFrame(rows, "grade int, _start int, _own int")
    shard = F.col("_start") + F.pmod(F.xxhash64("v"), F.col("_own")).cast("int")
    return distinct.join(F.broadcast(starts), "grade").select("v", "ids", shard.alias("shard")), total


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    vector: str = "embedding",
    vec_id: str = "vec_id",
    beam: int = SEARCH_BEAM,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The k largest inner products of each query: query_id, rank, vec_id, score.

    Equal vectors are indexed once, with their k + 1 smallest ids: more can't be
    among the k nearest of any query. The distinct vectors are dealt to shards by size and hash
    (`_dealt`), so that long vectors don't blunt the search among short ones; the number of shards grows with them; each shard becomes one row of a written
    index, and blocks of queries search each shard. The score is the product of the
    original vectors in doubles, and the lists of the shards are merged per query
    (at most shards x k rows). A query's own row is left out; ties go to the smaller id.

    Vectors that are null, zero, or hold a null or non-finite component, and rows
    without an id, take no part, neither as queries nor as candidates. Shorter
    vectors count as filled up with zeros. Rows with the same id and vector are one
    candidate; of queries that share an id, one is answered (the smallest vector). An empty table gives no rows.
    """
    found = usable_vectors(vectors, vector, vec_id)
    distinct = materialize(_distinct(found, k + 1))
    size = distinct.agg(F.count("*").alias("n"), F.max(F.length("v")).alias("b")).first()
    wanted = usable_vectors(queries, vector, vec_id).groupBy("vec_id").agg(F.min("v").alias("v"))
    wanted = materialize(wanted.withColumnRenamed("vec_id", "query_id"))
    asked = wanted.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    schema = T.StructType.fromDDL("query_id long, rank int, vec_id long, score double")
    if not size["n"] or not asked["n"]:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = max(size["b"] // 8, asked["d"])
    blocks = -(-asked["n"] // QUERY_BLOCK)
    dealt, shards = _dealt(distinct, shard_rows)
    index = materialize(build_index(dealt, dim, shards))

    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    index = index.select("*", every_block)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    asking = wanted.select("query_id", "v", block, every_shard)

    def run(graphs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(graphs) or not len(asked):
            return empty
        row = graphs.iloc[0]
        base = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], dim)
        layers = [np.frombuffer(x, np.int32).reshape(row["n"], -1) for x in row["layers"]]
        graph = Graph(_extended(base), layers, row["entry"])
        own = np.zeros((len(asked), dim))
        for i, v in enumerate(asked["v"]):
            own[i, : len(v)] = v
        # A query's length doesn't change its order; at most 1 in each component, it fits float32.
        unit = own / np.abs(own).max(axis=1, keepdims=True)
        flat = np.column_stack([unit, np.zeros(len(own))]).astype(np.float32)
        near, _ = graph.search(flat, max(beam, 2 * k))
        out = []
        for q, vector, rows in zip(asked["query_id"], own, near, strict=True):
            rows = rows[rows >= 0]
            product = base[rows] @ vector
            order = np.argsort(-product, kind="stable")
            left, last = [], None
            for j in order:
                # A row that ties with the k-th may still have a smaller id.
                if len(left) >= k and product[j] < last:
                    break
                left += [(q, i, product[j]) for i in row["ids"][rows[j]] if i != q]
                last = product[j]
            left.sort(key=lambda x: (-x[2], x[1]))
            out += left[:k]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else empty

    lists = index.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInPandas(
        run, "query_id long, vec_id long, score double"
    )
    # At most shards x k rows a query; an array of them is cheaper than a window.
    pairs = F.array_sort(
        F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))
    )
    merged = lists.groupBy("query_id").agg(F.slice(pairs, 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("p", "b")).select(
        "query_id",
        (F.col("p") + 1).cast("int").alias("rank"),
        F.col("b.i").alias("vec_id"),
        (-F.col("b.s")).alias("score"),
    )
