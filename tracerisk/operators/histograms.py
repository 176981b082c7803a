"""Forests and boosted trees grown from histograms of binned rows, for large tables.

Candidate splits, gains, leaves and pruning are those of Spark's trees, and the result is a model of Spark's. Rows
are kept as one byte per feature, in blocks. Boosted trees keep their sum per row beside it, once per tree; the node
of a row is found again on every pass, and the draws of a forest again from their seed, so nothing is stored per tree.
"""

import json
import math
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, cloudpickle, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracerisk.sources.shared import new_path

# Workers get this code with the tasks; they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a block, and bytes of histograms that one job of a forest brings to the driver.
BLOCK_ROWS = 1 << 18
JOB_BYTES = 64 << 20
# Impurity below which a node counts as pure, as in Spark.
_EPSILON = 2.0**-52


# Bins


def _cuts(values: np.ndarray, weights: np.ndarray, total: float, n_splits: int) -> np.ndarray:
    """Thresholds of one feature from (a sample of) its values, at even steps of their weight.

    Zeros weigh what the others leave of the expected `total`, as in Spark.
    """
    zero = values == 0
    found, place = np.unique(values[~zero], return_inverse=True)
    counts = np.bincount(place, weights=weights[~zero], minlength=len(found))
    rest = total - counts.sum()
    if rest > _EPSILON * np.count_nonzero(~zero) * 100:
        at = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, rest)
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) <= n_splits:
        return middles
    stride = total / (n_splits + 1)
    target, upto, kept = stride, np.cumsum(counts), []
    for i, (before, after) in enumerate(zip(upto[:-1], upto[1:])):
        if abs(before - target) < abs(after - target):
            kept.append(i)
            target += stride
    return middles[kept]


def candidate_cuts(
    train: DataFrame, features: Sequence[str], weight: Column, n_rows: int, total: float, max_bins: int, seed: int
) -> list[np.ndarray]:
    """Thresholds per feature, from all rows or from a sample of as many as Spark takes."""
    wanted = max(max_bins * max_bins, 10_000)
    share = min(1.0, wanted / n_rows)
    rows = train if share == 1.0 else train.sample(False, share, seed)
    columns = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    table = rows.select(*columns, weight.alias("w")).toArrow()
    weights = table["w"].to_numpy()
    n_splits = min(max_bins, n_rows) - 1
    return [
        _cuts(_known(table[f"f{i}"]), weights, share * total, n_splits) for i in range(len(features))
    ]


def _known(column) -> np.ndarray:
    """Values of an Arrow column, none of them missing."""
    values = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    if column.null_count or np.isnan(values).any():
        raise ValueError("features must not hold null or NaN")
    return values


def binned(train: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray]) -> RDD:
    """Blocks of rows: their number, the bins (one row per feature, then one entry per row) and the labels.

    Blocks lie in no more partitions than there are cores, each of which streams its own.
    """
    n_features = len(features)
    columns = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    source = train.select(*columns, F.col("label").cast("int").alias("label"))

    def block(batches: Sequence[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        bins = [np.searchsorted(cuts[i], _known(table[f"f{i}"])).astype(np.uint8) for i in range(n_features)]
        labels = _known(table["label"])
        if not np.isin(labels, (0, 1)).all():
            raise ValueError("labels must be 0 or 1")
        values = [[number], [np.stack(bins).tobytes()], [labels.astype(np.uint8).tobytes()]]
        types = [pa.int64(), pa.binary(), pa.binary()]
        arrays = [pa.array(v, type=t) for v, t in zip(values, types)]
        return pa.RecordBatch.from_arrays(arrays, names=["number", "bins", "labels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, rows = [], 0
        for batch in batches:
            while rows + batch.num_rows >= BLOCK_ROWS:
                room = BLOCK_ROWS - rows
                yield block([*held, batch.slice(0, room)], number)
                batch, held, rows, number = batch.slice(room), [], 0, number + 1
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield block(held, number)

    def unpacked(row) -> tuple[int, np.ndarray, np.ndarray]:
        bins = np.frombuffer(row["bins"], np.uint8)
        return row["number"], bins.reshape(n_features, -1), np.frombuffer(row["labels"], np.uint8)

    blocks = source.mapInArrow(run, "number long, bins binary, labels binary")
    cores = train.sparkSession.sparkContext.defaultParallelism
    tasks = blocks.rdd.getNumPartitions()
    if tasks > cores and tasks % cores:
        # Dealt out evenly, as every pass is as long as its slowest core; in order, so that sums come out the same.
        blocks = blocks.repartition(cores).sortWithinPartitions("number")
    return blocks.rdd.coalesce(cores).map(unpacked)


# Trees under growth: numbered as a heap from 1, so the children of node i are 2 i and 2 i + 1. A row of a leaf goes on
# to the left (bin 255 is the last), so after any number of levels its number tells the leaf.


class Tree:
    """Split feature and last bin of the left side per node, and what is known of each."""

    def __init__(self, max_depth: int):
        size = 2 << max_depth
        self.feature = np.zeros(size, np.int64)
        self.cut = np.full(size, 255, np.uint8)
        # Statistics as Spark stores them, rows, gain (None in a leaf).
        self.nodes: dict[int, dict] = {}

    def value_per_end(self, max_depth: int, value: Callable[[dict], float]) -> np.ndarray:
        """Value of the leaf that rows at a node of the last level are in."""
        ends = np.zeros(2 << max_depth)
        for end in range(1 << max_depth, 2 << max_depth):
            ends[end] = value(self.nodes[self.leaf_above(end)])
        return ends

    def leaf_above(self, node: int) -> int:
        while node not in self.nodes and node > 1:
            node //= 2
        return node


def _place(bins: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node that each of the rows (by number) reaches after so many levels."""
    flat, start = bins.reshape(-1), feature * bins.shape[1]
    node = np.ones(len(rows), np.int64)
    for _ in range(levels):
        at = start.take(node)
        at += rows
        right = flat.take(at) > cut.take(node)
        node <<= 1
        node += right
    return node


def _summed(parts: Iterable[Sequence[np.ndarray]]) -> list[np.ndarray]:
    """Arrays of all tasks added up, position by position."""
    out = None
    for arrays in parts:
        if out is None:
            out = [a.astype(np.int64 if a.dtype.kind == "i" else float) for a in arrays]
        else:
            for a, b in zip(out, arrays):
                a += b
    return out


def _best(gain: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node (first axis): the gain, position on the second axis and bin of the best split; the first of equals."""
    gain = np.where(valid & (gain >= 0), gain, -np.inf)
    flat = gain.reshape(len(gain), -1).argmax(1)
    which, at = np.divmod(flat, gain.shape[2])
    return gain.reshape(len(gain), -1)[np.arange(len(gain)), flat], which, at


# Boosted trees


def _pseudo_residuals(labels: np.ndarray, sums: np.ndarray | None) -> np.ndarray:
    """What the next tree is fitted to: the labels as -1 and 1, then the negative gradient of the log loss."""
    y = labels * 2.0 - 1.0
    return y if sums is None else 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * sums, 700.0)))


def _level_of_boosted(parts, level, members):
    """Per member of the fit, histograms of its nodes with a slot: rows per feature, label, slot and bin; weighted residuals
    per feature, slot and bin.

    Also the weighted squares of the residuals per node of the level, for all nodes, and those per leaf of the tree before.
    """
    found = {}
    for member, _, bins, labels, sums, ends in parts:
        if members[member] is None:
            continue
        feature, cut, slot, n_slots, n_bins, scale = members[member]
        n_features = len(bins)
        if member not in found:
            cells = n_features, 2 * n_slots * n_bins
            found[member] = [np.zeros(cells, np.int64), np.zeros(cells), np.zeros(1 << level), np.zeros_like(ends)]
        counts, totals, squares, last = found[member]
        rows = np.arange(len(labels))
        node = _place(bins, rows, feature, cut, level)
        residuals = _pseudo_residuals(labels, sums)
        weighted = np.where(labels == 1, scale, 1.0) * residuals
        squares += np.bincount(node - (1 << level), weights=weighted * residuals, minlength=1 << level)
        last += ends
        place = slot.take(node)
        if n_slots > 1 or place.min() < 0:
            rows = np.flatnonzero(place >= 0)
            place, labels, weighted = place[rows], labels[rows], weighted[rows]
        base = (labels.astype(np.int64) * n_slots + place) * n_bins
        for f in range(n_features):
            index = base + (bins[f].take(rows) if len(rows) < bins.shape[1] else bins[f])
            counts[f] += np.bincount(index, minlength=counts.shape[1])
            totals[f] += np.bincount(index, weights=weighted, minlength=counts.shape[1])
    for member, (counts, totals, squares, last) in found.items():
        shape = len(counts), 2, members[member][3], members[member][4]
        found[member] = counts.reshape(shape), totals.reshape(shape).sum(1), squares, last
    yield found


def _after_tree(block, levels, rate, first, members):
    """The block with the tree's share in its sums, and the squared residuals that it left in each end."""
    member, number, bins, labels, sums, _ = block
    feature, cut, ends, scale = members[member]
    node = _place(bins, np.arange(len(labels)), feature, cut, levels)
    residuals = _pseudo_residuals(labels, None if first else sums)
    squares = np.bincount(node, weights=np.where(labels == 1, scale, 1.0) * residuals**2, minlength=len(ends))
    share = rate * ends.take(node)
    return member, number, bins, labels, share if first else sums + share, squares


def _per_member(parts: Sequence[dict]) -> dict[int, list[np.ndarray]]:
    """Arrays of all tasks added up, per member."""
    return {m: _summed([part[m] for part in parts if m in part]) for m in sorted({m for part in parts for m in part})}


def _variance(stats: Sequence[float]) -> float:
    return (stats[2] - stats[1] * stats[1] / stats[0]) / stats[0] if stats[0] else 0.0


def grow_boosted(
    members: Sequence[tuple[RDD, Sequence[int], float]], n_trees: int, max_depth: int, rate: float
) -> list[list[Tree]]:
    """Boosted regression trees on the log loss, one pass over the blocks per level of each tree.

    `members` are models on rows, features and weights of their own (blocks, bins per feature, weight of label 1). They
    share the passes, as a job of few rows is mostly overhead, and nothing else: each is as if fitted alone.
    """
    size = 2 << max_depth
    made = [
        blocks.map(lambda b, m=m: (m, *b, None, np.zeros(size))) for m, (blocks, *_) in enumerate(members)
    ]
    state = made[0]
    if len(made) > 1:
        state = state.context.union(made).coalesce(state.context.defaultParallelism)
    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    grown: list[list[Tree]] = [[] for _ in members]
    before = None
    for t in range(n_trees):
        first = t == 0
        trees = [Tree(max_depth) for _ in members]
        # Per member: nodes to be split, histograms of their parents, and siblings of fewer rows by the larger one's number.
        wanted, kept, smaller = [[1] for _ in members], [{} for _ in members], [{} for _ in members]
        for level in range(max_depth):
            asked: list = [None] * len(members)
            counted = [[n for n in wanted[m] if n not in smaller[m]] for m in range(len(members))]
            for m, (_, n_bins, scale) in enumerate(members):
                if wanted[m]:
                    slot = np.full(size, -1, np.int64)
                    slot[counted[m]] = np.arange(len(counted[m]))
                    asked[m] = trees[m].feature, trees[m].cut, slot, len(counted[m]), max(n_bins), scale
            if not any(asked):
                break
            args = level, asked
            passed = _per_member(state.mapPartitions(lambda parts, args=args: _level_of_boosted(parts, *args)).collect())
            if level == 0 and before is not None:
                before.unpersist()
            for m, (counts, totals, squares, last) in passed.items():
                if level == 0 and grown[m]:
                    _end_squares(grown[m][-1], last, max_depth)
                found = {n: (counts[:, :, i], totals[:, i]) for i, n in enumerate(counted[m])}
                for n, few in smaller[m].items():
                    c, s = (a - b for a, b in zip(kept[m][n // 2], found[few]))
                    # An empty bin adds nothing, not the rounding of its neighbours.
                    found[n] = c, np.where(c.sum(1) > 0, s, 0.0)
                splits, scale = np.array(members[m][1]) - 1, members[m][2]
                kept[m], wanted[m], smaller[m] = _split_boosted(
                    trees[m], found, squares, splits, scale, level, max_depth, wanted[m]
                )
        steps = []
        for m, tree in enumerate(trees):
            grown[m].append(tree)
            steps.append((tree.feature, tree.cut, tree.value_per_end(max_depth, _mean), members[m][2]))
        args = max_depth, 1.0 if first else rate, first, steps
        # Stored by the first pass of the next tree, after which the one before goes.
        before, state = state, state.map(lambda block, args=args: _after_tree(block, *args))
        state.persist(StorageLevel.MEMORY_AND_DISK)
    squares = _per_member(state.map(lambda block: {block[0]: [block[5]]}).collect())
    for m, (found,) in squares.items():
        _end_squares(grown[m][-1], found, max_depth)
    before.unpersist()
    state.unpersist()
    return grown


def _end_squares(tree: Tree, squares: np.ndarray, max_depth: int) -> None:
    """Squared residuals of the leaves, which their parents' histograms don't tell."""
    for end in range(1 << max_depth, 2 << max_depth):
        leaf = tree.nodes[tree.leaf_above(end)]
        if leaf["gain"] is None:
            leaf.setdefault("squares", 0.0)
            leaf["squares"] += squares[end]
    for node in tree.nodes.values():
        if "squares" in node:
            node["stats"][2] = node.pop("squares")
            node["impurity"] = _variance(node["stats"])


def _split_boosted(tree, found, squares, splits, scale, level, max_depth, wanted):
    """Best splits of one level; the histograms of those split, the nodes of the next level and their smaller siblings."""
    order = list(wanted)
    counts = np.stack([found[n][0] for n in order])
    sums = np.stack([found[n][1] for n in order])
    weights = counts[:, :, 0] + scale * counts[:, :, 1]
    raw = counts.sum(2)
    left = [np.cumsum(x, 2) for x in (weights, sums, raw)]
    whole = [x[:, :1, -1:] for x in left]
    right = [w - x for w, x in zip(whole, left)]
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - whole[1] ** 2 / whole[0]
        gain = parts / whole[0]
    valid = (left[2] >= 1) & (right[2] >= 1) & (np.arange(sums.shape[2]) < splits[:, None])
    best, feature, at = _best(gain, valid)
    kept, following, older = {}, [], {}
    for i, n in enumerate(order):
        stats = [float(whole[0][i, 0, 0]), float(whole[1][i, 0, 0]), float(squares[n - (1 << level)])]
        node = {"stats": stats, "rows": int(whole[2][i, 0, 0]), "gain": None, "impurity": _variance(stats)}
        tree.nodes[n] = node
        if not best[i] > 0 or (n > 1 and abs(node["impurity"]) < _EPSILON):
            continue
        f, b = int(feature[i]), int(at[i])
        node |= {"gain": float(best[i]), "feature": f, "bin": b}
        tree.feature[n], tree.cut[n] = f, b
        kept[n] = found[n]
        sides = [[float(x[i, f, b]) for x in side] for side in (left, right)]
        if level + 1 == max_depth:
            for child, (w, s, r) in zip((2 * n, 2 * n + 1), sides):
                tree.nodes[child] = {"stats": [w, s, 0.0], "rows": int(r), "gain": None, "impurity": 0.0}
            continue
        following += [2 * n, 2 * n + 1]
        few = 2 * n if sides[0][2] <= sides[1][2] else 2 * n + 1
        older[few ^ 1] = few
    return kept, following, older


# Forests


# Chances that a row is drawn no more than 0, 1, 2, ... times: the Poisson distribution of mean 1.
_DRAWN_UPTO = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)])


def _drawn(seed: int, tree: int, number: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that the tree draws, and how often."""
    at = np.random.Generator(np.random.SFC64([seed & 0xFFFFFFFF, tree, number])).random(rows)
    drawn = np.flatnonzero(at >= _DRAWN_UPTO[0])
    at = at[drawn]
    times = np.ones(len(drawn))
    for upto in _DRAWN_UPTO[1:4]:
        times += at >= upto
    many = np.flatnonzero(at >= _DRAWN_UPTO[3])
    times[many] = np.searchsorted(_DRAWN_UPTO, at[many], side="right")
    return drawn, times


def _level_of_forest(parts, batch, level, width, seed):
    """Draws per label, slot, chosen feature and bin, for the trees of the batch; slots are the nodes to be split."""
    counts = None
    for number, bins, labels in parts:
        if counts is None:
            counts = [np.zeros(2 * chosen.size * width) for _, _, _, _, chosen in batch]
        flat, n = bins.reshape(-1), bins.shape[1]
        for (tree, feature, cut, slot, chosen), found in zip(batch, counts):
            rows, times = (np.arange(n), np.ones(n)) if seed is None else _drawn(seed, tree, number, n)
            place = slot.take(_place(bins, rows, feature, cut, level))
            inside = place >= 0
            if not inside.all():
                rows, place, times = rows[inside], place[inside], times[inside]
            base = labels[rows].astype(np.int64) * (chosen.size * width) + place * (chosen.shape[1] * width)
            for j in range(chosen.shape[1]):
                at = (chosen[:, j] * n).take(place)
                at += rows
                index = base + flat.take(at)
                index += j * width
                found += np.bincount(index, weights=times, minlength=len(found))
    if counts is not None:
        yield [found.astype(np.int32) for found in counts]


def _gini(a, b):
    whole = a + b
    return 1.0 - (a / whole) ** 2 - (b / whole) ** 2


def grow_forest(
    blocks: RDD, n_bins: Sequence[int], weights: tuple[float, float], n_trees: int, max_depth: int, n_chosen: int, seed: int | None
) -> list[Tree]:
    """Trees on draws with replacement, each node split by the best of `n_chosen` random features.

    All trees grow level by level; a job takes as many of them as the driver may hold histograms of.
    Without a seed, every tree takes each row once.
    """
    width, splits, n_features = max(n_bins), np.array(n_bins) - 1, len(n_bins)
    size, tasks = 2 << max_depth, blocks.getNumPartitions()
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    trees = [Tree(max_depth) for _ in range(n_trees)]
    wanted = [[1] for _ in trees]
    for level in range(max_depth):
        for some in _batches(wanted, 8 * n_chosen * width * tasks):
            batch = []
            for t in some:
                slot = np.full(size, -1, np.int64)
                slot[wanted[t]] = np.arange(len(wanted[t]))
                rng = np.random.default_rng([(seed or 0) & 0xFFFFFFFF, t, level])
                chosen = rng.permuted(np.tile(np.arange(n_features), (len(wanted[t]), 1)), axis=1)[:, :n_chosen]
                batch.append((t, trees[t].feature, trees[t].cut, slot, np.sort(chosen, 1)))
            args = batch, level, width, seed
            found = _summed(blocks.mapPartitions(lambda parts, args=args: _level_of_forest(parts, *args)).collect())
            for (t, *_, chosen), counts in zip(batch, found):
                counts = counts.reshape(2, *chosen.shape, width)
                wanted[t] = _split_forest(trees[t], counts, chosen, splits, weights, level, max_depth, wanted[t])
    blocks.unpersist()
    return trees


def _batches(wanted: Sequence[Sequence[int]], node_bytes: int) -> list[list[int]]:
    """Trees that still grow, as many together as their histograms allow, one at least."""
    out, held = [], 0
    for t, nodes in enumerate(wanted):
        if not nodes:
            continue
        if not out or held + len(nodes) * node_bytes > JOB_BYTES:
            out.append([])
            held = 0
        out[-1].append(t)
        held += len(nodes) * node_bytes
    return out


def _split_forest(tree, counts, chosen, splits, weights, level, max_depth, wanted):
    """Best splits of one level of a tree; the nodes of the next level."""
    left = np.cumsum(counts, 3, dtype=np.int64)
    whole = left[:, :, :1, -1:]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        side = [[x[c] * weights[c] for c in (0, 1)] for x in (left, right, whole)]
        total = side[2][0] + side[2][1]
        impurity = _gini(*side[2])
        gain = impurity - sum((s[0] + s[1]) / total * _gini(*s) for s in side[:2])
    valid = (left.sum(0) >= 1) & (right.sum(0) >= 1) & (np.arange(counts.shape[3]) < splits[chosen][:, :, None])
    best, which, at = _best(gain, valid)
    following = []

    def known(rows):
        stats = [float(rows[c] * weights[c]) for c in (0, 1)]
        pure = 0.0 if not sum(stats) else float(_gini(*stats))
        return {"stats": stats, "rows": int(rows[0] + rows[1]), "gain": None, "impurity": pure}

    for i, n in enumerate(wanted):
        if n == 1:
            tree.nodes[n] = known(whole[:, i, 0, 0])
        if not best[i] > 0:
            continue
        f, b = int(chosen[i, which[i]]), int(at[i])
        tree.nodes[n] |= {"gain": float(best[i]), "feature": f, "bin": b}
        tree.feature[n], tree.cut[n] = f, b
        for child, x in ((2 * n, left), (2 * n + 1, right)):
            tree.nodes[child] = known(x[:, i, which[i], b])
            if level + 1 < max_depth and abs(tree.nodes[child]["impurity"]) >= _EPSILON:
                following.append(child)
    return following


# Models


def _mean(node: dict) -> float:
    return node["stats"][1] / node["stats"][0] if node["stats"][0] else 0.0


def _majority(node: dict) -> float:
    return 1.0 if node["stats"][1] > node["stats"][0] else 0.0


def _stored_nodes(tree: Tree, number: int, cuts: Sequence[np.ndarray], predicted: Callable[[dict], float]) -> list[tuple]:
    """Rows of a stored model, in the order that Spark numbers nodes; a split whose sides predict the same goes."""

    def pruned(n: int):
        node = tree.nodes[n]
        if node["gain"] is None:
            return node, None, None
        left, right = pruned(2 * n), pruned(2 * n + 1)
        if left[1] is None and right[1] is None and predicted(left[0]) == predicted(right[0]):
            return node, None, None
        return node, left, right

    rows: list = []

    def number_from(found) -> int:
        node, left, right = found
        own = len(rows)
        rows.append(None)
        if left is None:
            rest = -1.0, -1, -1, -1, []
        else:
            children = number_from(left), number_from(right)
            rest = node["gain"], *children, node["feature"], [float(cuts[node["feature"]][node["bin"]])]
        rows[own] = (number, own, predicted(node), node["impurity"], node["stats"], node["rows"], *rest, -1)
        return own

    number_from(pruned(1))
    return rows


_NODE = ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild"]
_SPLIT = ["featureIndex", "leftCategoriesOrThreshold", "numCategories"]
_TYPES = [
    pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.float64(),
    pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32(),
]


def _as_model(spark: SparkSession, estimator, loader, n_features: int, settings: dict, rows: list[tuple], rates: Sequence[float]):
    """A model of Spark's with the given nodes: that of a fit to two rows, with its nodes and settings replaced."""
    two = [(Vectors.dense([float(i)] * n_features), float(i), 1.0) for i in range(2)]
    few = {"numTrees": 1} if "numTrees" in settings else {"maxIter": 1}
    tiny = estimator(**(settings | few | {"maxDepth": 1})).fit(
        spark.createDataFrame(two, ["features", "label", settings["weightCol"]]).coalesce(1)
    )
    template, path = new_path(spark), new_path(spark)
    tiny.write().save(template)
    stored = json.loads(spark.read.text(f"{template}/metadata").first()[0])
    stored["paramMap"] |= {k: v for k, v in settings.items() if k in stored["paramMap"]}
    stored["numTrees"] = len(rates)
    spark.createDataFrame([(json.dumps(stored),)], "value string").coalesce(1).write.text(f"{path}/metadata")

    per_tree = spark.read.parquet(f"{template}/treesMetadata")
    about = json.loads(per_tree.first()[1])
    about["paramMap"]["maxDepth"] = settings["maxDepth"]
    described = [(i, json.dumps(about), float(rate)) for i, rate in enumerate(rates)]
    spark.createDataFrame(described, per_tree.schema).coalesce(1).write.parquet(f"{path}/treesMetadata")

    names = ["treeID", *_NODE, *_SPLIT]
    columns = [pa.array(list(c), type=t) for c, t in zip(zip(*rows), _TYPES)]
    nodes = spark.createDataFrame(pa.Table.from_arrays(columns, names=names))
    data = F.struct(*_NODE, F.struct(*_SPLIT).alias("split")).alias("nodeData")
    nodes.select("treeID", data).coalesce(1).write.parquet(f"{path}/data")
    return loader.load(path)


def _prepared(train, features, weight, counts, total, max_bins, seed):
    cuts = candidate_cuts(train, features, weight, sum(counts), total, max_bins, seed)
    return cuts, [len(c) + 1 for c in cuts], binned(train, features, cuts)


def _side_by_side(fn: Callable, items: Sequence, spark: SparkSession) -> list:
    """The small jobs of several models, a few at a time."""
    with ThreadPool(min(len(items), 4)) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items)


def fit_boosted(asked: Sequence[tuple]) -> list[PipelineModel]:
    """Boosted trees as `GBTClassifier` fits them, of several models in the same passes.

    Each is asked for by train rows, features, weight, rows with label 0 and 1, weight of label 1, and settings; number,
    depth and rate of the trees are those of the first.
    """
    spark, settings = asked[0][0].sparkSession, asked[0][-1]
    n_trees, rate = settings["maxIter"], settings["stepSize"]

    def prepared(ask):
        train, features, weight, counts, scale, own = ask
        total = counts[0] + scale * counts[1]
        return _prepared(train, features, weight, counts, total, own["maxBins"], own["seed"])

    def finished(found):
        (train, features, *_, own), (cuts, *_), trees = found
        rows = [row for i, tree in enumerate(trees) for row in _stored_nodes(tree, i, cuts, _mean)]
        rates = [1.0, *[rate] * (n_trees - 1)]
        return _in_pipeline(train, features, GBTClassifier, GBTClassificationModel, own, rows, rates)

    ready = _side_by_side(prepared, asked, spark)
    members = [(blocks, n_bins, ask[4]) for ask, (_, n_bins, blocks) in zip(asked, ready)]
    grown = grow_boosted(members, n_trees, settings["maxDepth"], rate)
    return _side_by_side(finished, list(zip(asked, ready, grown)), spark)


def fit_forest(
    train: DataFrame, features: Sequence[str], weight: Column, counts: tuple[int, int], weights: tuple[float, float], settings: dict
) -> PipelineModel:
    """A forest as `RandomForestClassifier` fits it, its draws and choices of features seeded otherwise."""
    total = sum(w * n for w, n in zip(weights, counts))
    cuts, n_bins, blocks = _prepared(train, features, weight, counts, total, settings["maxBins"], settings["seed"])
    n_chosen = math.ceil(math.sqrt(len(features)))
    trees = grow_forest(blocks, n_bins, weights, settings["numTrees"], settings["maxDepth"], n_chosen, settings["seed"])
    rows = [row for i, tree in enumerate(trees) for row in _stored_nodes(tree, i, cuts, _majority)]
    return _in_pipeline(
        train, features, RandomForestClassifier, RandomForestClassificationModel, settings, rows, [1.0] * len(trees)
    )


def _in_pipeline(train, features, estimator, loader, settings, rows, rates):
    model = _as_model(train.sparkSession, estimator, loader, len(features), settings, rows, rates)
    return PipelineModel([VectorAssembler(inputCols=list(features), outputCol="features"), model])
