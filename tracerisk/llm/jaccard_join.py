"""Jaccard self-join of word n-grams with prefix filters under several global token orders."""

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracerisk.llm.common import BROADCAST_ROWS, mix64, with_columns
from tracerisk.llm.graph import components
from tracerisk.sources import materialize

SHINGLE, PERCENT = 5, 80
# Keys of a set's sketch, and minima that one key takes together.
KEYS, MINIMA = 8, 3
ROUNDS = 2
# Rows of a token that meet all its others in one task.
SALT_ROWS = 1_000
CACHED_WORDS = 500_000
# Ends of the first quarter and start of the last quarter of all hashes, as signed numbers.
EARLY, LATE = -(1 << 62), 1 << 62

_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


class _WordHashes(dict):
    """64-bit hash of a word; at most CACHED_WORDS are kept between blocks."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[str], known: _WordHashes) -> list[np.ndarray]:
    """Distinct five-word shingles of every text as sorted 64-bit hashes.

    A-Z are lower-cased; words end at ASCII white space. A text of one to four words is
    one shingle (of its own length, so unlike any of five words), one without words has none.
    """
    if len(known) > CACHED_WORDS:
        known.clear()
    # Of bytes, lower() and split() know ASCII only.
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    words = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint64, total)
    # A window's hash: its words' hashes times one odd number per place, summed and mixed.
    value = np.zeros(max(total - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        value += words[k : k + len(value)] * _PLACES[k]
    value = mix64(value).view(np.int64)
    sets = []
    for end, n in zip(ends.tolist(), sizes.tolist()):
        if n >= SHINGLE:
            own = np.sort(value[end - n : end - SHINGLE + 1])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        elif n:
            short = (words[end - n : end] * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True)
            sets.append(mix64(short + np.uint64(n) * _STEP).view(np.int64))
        else:
            sets.append(value[:0])
    return sets


def _sketch(values: np.ndarray) -> np.ndarray:
    """KEYS keys of a sorted set: two sets agree in one with the MINIMA-th power of their Jaccard similarity.

    The first element at or after a fixed point of the ring of hashes is a minimum of the set
    under an order of its own, so two sets share it with the probability of their similarity.
    """
    points = np.linspace(-(2.0**63), 2.0**63, KEYS * MINIMA, endpoint=False).astype(np.int64)
    least = values[np.searchsorted(values, points) % len(values)].view(np.uint64).reshape(KEYS, MINIMA)
    key = np.arange(1, KEYS + 1, dtype=np.uint64)
    for k in range(MINIMA):
        key = mix64(key * _STEP + least[:, k])
    return key.view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), pa.array(values))


def _signed(rows: DataFrame) -> DataFrame:
    """Adds n (size of the set), digest, keys (its sketch) and early (its tokens of the first quarter of all hashes)."""
    known = _WordHashes()

    def run(texts):
        sets = shingle_sets(texts, known)
        sizes = np.array([len(s) for s in sets])
        early = [s[: np.searchsorted(s, EARLY)] for s in sets]
        keys = [_sketch(s) for s in sets if len(s)]
        return [
            pa.array(sizes, pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            _lists(np.concatenate([np.zeros(0, np.int64), *keys]), np.where(sizes > 0, KEYS, 0)),
            _lists(np.concatenate(early), [len(s) for s in early]),
        ]

    added = "n long, digest binary, keys array<bigint>, early array<bigint>"
    return with_columns(rows, "text", added, run, keep=["row", "doc_id", "text_key"])


def _sets_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n and tokens (the whole sorted set) of the nodes, made from their texts again.

    `nodes` has node and text_key. Whole sets take more room than the texts, so
    only those that are compared are ever written.
    """
    known = _WordHashes()

    def run(texts):
        sets = shingle_sets(texts, known)
        sizes = np.array([len(s) for s in sets])
        return [pa.array(sizes, pa.int64()), _lists(np.concatenate(sets), sizes)]

    texts = rows.select("text_key", "text").join(_small(nodes), "text_key").select("node", "text")
    return materialize(with_columns(texts.dropDuplicates(["node"]), "text", "n long, tokens array<bigint>", run, keep=["node"]))


def _small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has no more than so many rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


# Sizes that the filters need; whole numbers throughout, so that nothing is lost by rounding


def _up(top: Column, bottom: int) -> Column:
    return F.call_function("div", top + (bottom - 1), F.lit(bottom).cast("long"))


def _overlap(m: Column, n: Column, percent: int) -> Column:
    """Least number of tokens that similar sets of these sizes share."""
    return _up((m + n) * percent, 100 + percent)


def _prefix(n: Column, percent: int) -> Column:
    """Similar sets share one of so many first tokens, in any order, whatever the other's size."""
    return n - _up(n * percent, 100) + 1


def _short_prefix(n: Column, percent: int) -> Column:
    """The same for the smaller set of a pair."""
    return n - _overlap(n, n, percent) + 1


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, orders: list[str]) -> DataFrame:
    """Pairs a, b of similar sets: they pass the size filter, the prefix filter of every order, then the exact count.

    `sets` has node, n, tokens and, by the names `orders`, its prefix in each further
    order. Two orders need no column: rising and falling hashes.
    """
    columns = ["node", "n", "tokens", *orders]
    x, y = (sets.select(*[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in "xy")
    both = pairs.join(x, F.col("a") == F.col("x_node")).join(y, F.col("b") == F.col("y_node"))
    m, n = F.col("x_n"), F.col("y_n")
    near = both.filter(F.least(m, n) * 100 >= F.greatest(m, n) * percent)
    front = [F.slice(f"{s}_tokens", 1, _prefix(F.col(f"{s}_n"), percent).cast("int")) for s in "xy"]
    back = [F.slice(f"{s}_tokens", (-_prefix(F.col(f"{s}_n"), percent)).cast("int"), _prefix(F.col(f"{s}_n"), percent).cast("int")) for s in "xy"]
    for one, other in (front, back, *[[F.col(f"{s}_{c}") for s in "xy"] for c in orders]):
        near = near.filter(F.arrays_overlap(one, other))
    shared = F.size(F.array_intersect("x_tokens", "y_tokens")).cast("long")
    return near.filter(shared * 100 >= (m + n - shared) * percent).select("a", "b")


def _pivot_pairs(keyed: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs of a sketch key's members with one of them, the one that meets most others over all keys.

    Only of keys whose members are in several classes yet; later rounds take the pivot
    from the members that are linked with nothing so far.
    """
    linked = F.lit(None).cast("long") if labels is None else F.col("component")
    rows = keyed if labels is None else keyed.join(_small(labels), "node", "left")
    rows = rows.select("key", "node", "score", linked.isNull().alias("free"), F.coalesce(linked, "node").alias("class"))
    best = F.when(F.col("free"), F.struct("score", (-F.col("node")).alias("x"), "class"))
    pivots = rows.groupBy("key").agg(F.min("class").alias("y"), F.max("class").alias("z"), F.max(best).alias("p"))
    pivots = pivots.filter("y != z and p is not null")
    pivots = materialize(pivots.select("key", (-F.col("p.x")).alias("pivot"), F.col("p.class").alias("pivot_class")))
    met = rows.join(_small(pivots), "key").filter("class != pivot_class")
    return met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _hits(sets: DataFrame, tokens: str) -> DataFrame:
    """Sets of which another class has some of these tokens among its own, and how many: node, hits."""
    rows = sets.select("node", "class", F.explode(tokens).alias("token"))
    shared = rows.groupBy("token").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x != y")
    # Tables of tokens grow with the corpus: always joined by shuffle.
    shared = materialize(shared.select("token"))
    return materialize(rows.join(shared, "token", "left_semi").groupBy("node").agg(F.count("*").alias("hits")))


def _surviving(sets: DataFrame, tokens: str, percent: int, earlier: Column) -> DataFrame:
    """Sets that may have a similar one in another class, by their tokens from a fixed range of hashes.

    Such tokens are a prefix of every set in an order of hashes. All but n - overlap of a set's tokens are in
    a similar set too, so at most so many of the range are not; a passage in common doesn't pass that. `earlier`
    counts the tokens of ranges looked at before less those found in another class.
    """
    found = sets.join(_small(_hits(sets, tokens)), "node", "left")
    missed = F.size(tokens) - F.coalesce("hits", F.lit(0)) + earlier
    found = found.withColumn("missed", missed.cast("long"))
    return found.filter(F.col("missed") < _prefix(F.col("n"), percent)).drop("hits")


def _candidates(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs across classes that share a token of their prefixes, rare tokens first, and those sets with two more orders.

    Tokens of one class alone come first of all: no pair has them. The rest is ordered by the power
    of two of their number, within it by hash, falling hash, or hash of the hash. Each gives another prefix.
    """
    flat = sets.select("node", "class", "n", F.explode("tokens").alias("token"))
    shared = flat.groupBy("token").agg(
        F.count("*").alias("df"), F.min("class").alias("x"), F.max("class").alias("y")
    )
    shared = materialize(shared.filter("x != y").select("token", F.floor(F.log2("df")).alias("grade")))
    own = flat.join(shared, "token").groupBy("node", "class", "n").agg(
        F.collect_list(F.struct("grade", "token")).alias("some")
    )
    room = (_prefix(F.col("n"), percent) - (F.col("n") - F.size("some"))).cast("int")
    own = own.withColumn("room", room).filter("room > 0")

    def ordered(tie):
        by = F.transform("some", lambda s: F.struct(s["grade"].alias("grade"), tie(s["token"]).alias("tie"), s["token"].alias("token")))
        return F.slice(F.array_sort(by), 1, F.col("room"))["token"]

    orders = {"rising": lambda t: t, "falling": F.bitwise_not, "mixed": F.xxhash64}
    own = materialize(own.select("node", "class", "n", (F.col("n") - F.size("some")).alias("single"), *[ordered(t).alias(c) for c, t in orders.items()]))
    rows = own.select("node", "class", "n", "single", F.posexplode("rising").alias("k", "token"))
    place = F.col("single") + F.col("k") + 1
    rows = materialize(
        rows.select("node", "class", "n", "token", place.alias("place"), (place <= _short_prefix(F.col("n"), percent)).alias("short"))
    )
    per_class = rows.groupBy("token", "class").agg(F.count("*").alias("rows"), F.count_if("short").alias("shorts"))
    per_token = per_class.groupBy("token").agg(
        F.max_by("class", F.struct("rows", "class")).alias("main"), F.max("rows").alias("most"),
        F.sum("rows").alias("rows"), F.sum("shorts").alias("shorts"),
    )
    # A token's largest class meets only the others; many rows are dealt over salts.
    salts = _up(F.col("shorts"), SALT_ROWS).cast("int").alias("salts")
    per_token = materialize(per_token.filter("rows > most and shorts > 0").select("token", "main", salts))
    met = materialize(rows.join(per_token, "token"))
    in_main = F.col("class") == F.col("main")
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    left = met.filter("short").select(
        "token", in_main.alias("side"), salt.alias("salt"), F.col("node").alias("a"),
        F.col("class").alias("x"), F.col("n").alias("m"), F.col("place").alias("p"),
    )
    sides = F.when(in_main, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    right = met.select("token", F.explode(sides).alias("side"), "node", "class", "n", "place", "salts").select(
        "token", "side", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("node").alias("b"),
        F.col("class").alias("y"), F.col("n").alias("n"), F.col("place").alias("q"),
    )
    least = _overlap(F.col("m"), F.col("n"), percent)
    fits = (F.col("m") <= F.col("n")) & (F.col("m") * 100 >= F.col("n") * percent)
    fits = fits & (F.col("p") <= F.col("m") - least + 1) & (F.col("q") <= F.col("n") - least + 1)
    pairs = left.join(right, ["token", "side", "salt"]).filter((F.col("x") != F.col("y")) & fits)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs, own.select("node", "falling", "mixed")


def _joined(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Components of the links and of earlier ones, which stand as one link from each node to the least of its own."""
    if labels is not None:
        links = links.unionByName(labels.select(F.col("component").alias("a"), F.col("node").alias("b")))
    return components(links)


def _classed(sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return sets.withColumn("class", F.col("node"))
    found = sets.join(_small(labels), "node", "left")
    return found.withColumn("class", F.coalesce("component", "node")).drop("component")


def jaccard_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    A text's set is its distinct five-word shingles. Two texts link when
    100 * shared >= percent * union of their sets; component_id is the least doc_id
    that links reach. Sets stand as 64-bit hashes, told apart by 128-bit digests.

    Equal sets are one node. Members of a sketch key are first compared with one
    of them, so that a large group of near copies is one class after few
    comparisons. All links across classes are then found by prefix filters: similar sets share a
    token among their first ones in *any* global order, so a set stays in play only if another class
    shares enough of its first tokens by rising and by falling hash; candidates meet by the prefix that has rare
    tokens first; and a pair is counted exactly only if its prefixes meet under all five orders.
    The first comparisons only spare pairs, the filters lose none.

    One row per row. Null and blank texts have no set: n_shingles 0, linked with nothing. Rows
    are told apart by their sets, so rows that share an id but not a set may be in different components. A row without an id has
    no component (null) and links nothing. Other columns don't matter; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.unhex(F.md5("text")))
    signed = materialize(_signed(rows.withColumn("row", F.monotonically_increasing_id())))
    real = signed.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    groups = real.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    groups = materialize(groups)
    several = _small(materialize(groups.filter("copies > 1").select("digest", "node")))
    # Sets of several rows are listed; the row of any other set is its own node.
    copies = materialize(real.select("row", "digest").join(several, "digest").select("row", "node"))
    others = _small(materialize(copies.filter("row != node").select("row")))
    sets = real.join(others, "row", "left_anti").withColumnRenamed("row", "node")

    keyed = sets.select("node", F.explode("keys").alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"))
    met = materialize(keyed.join(sizes, "key"))
    scores = materialize(met.groupBy("node").agg(F.sum("members").alias("score")))
    keyed = materialize(met.join(scores, "node").select("key", "node", "score"))
    texts_of = sets.select("node", "text_key")
    close = _sets_of(rows, materialize(texts_of.join(_small(scores.select("node")), "node", "left_semi")))

    labels, tested = None, None
    for _ in range(rounds):
        pairs = _pivot_pairs(keyed, labels)
        pairs = materialize(pairs if tested is None else pairs.join(_small(tested), ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        labels = _joined(_linked(pairs, close, percent, []), labels)
        tested = pairs if tested is None else tested.unionByName(pairs)

    classed = _classed(sets.select("node", "n", "text_key", "early"), labels)
    early = materialize(_surviving(classed, "early", percent, F.lit(0)).drop("early"))
    whole = _sets_of(rows, early.select("node", "text_key"))
    late = F.filter("tokens", lambda t: t >= LATE)
    both = whole.join(_small(early.select("node", "class", F.col("missed").alias("earlier"))), "node").withColumn("late", late)
    open_sets = materialize(_surviving(both, "late", percent, F.col("earlier")).select("node", "class", "n", "tokens"))
    pairs, orders = _candidates(open_sets, percent)
    pairs = materialize(pairs if tested is None else pairs.join(_small(tested), ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        compared = open_sets.join(orders, "node")
        labels = _joined(_linked(pairs, compared, percent, ["falling", "mixed"]), labels)

    # Only linked sets and copies have another answer than the row's own id.
    firsts = groups.select("node", "first", "copies")
    if labels is not None:
        classed = firsts.join(_small(labels), "node").select("node", "component", "first")
        least = materialize(classed.groupBy("component").agg(F.min("first").alias("least")))
        reached = materialize(classed.select("node", "component").join(_small(least), "component").select("node", "least"))
        firsts = firsts.join(_small(reached), "node", "left").withColumn("first", F.coalesce("least", "first"))
        firsts = firsts.filter("copies > 1 or least is not null")
    else:
        firsts = firsts.filter("copies > 1")
    firsts = materialize(firsts.select("node", "first"))
    listed = materialize(copies.join(_small(firsts), "node").select("row", F.col("first").alias("of_copies")))
    own = _small(firsts).withColumnRenamed("node", "row").withColumnRenamed("first", "of_set")
    named = signed.select("row", "doc_id", F.col("n").alias("n_shingles"))
    named = named.join(own, "row", "left").join(_small(listed), "row", "left")
    # Rows without an id or a set are no nodes, so neither table has them.
    return named.select(
        "doc_id", "n_shingles", F.coalesce("of_copies", "of_set", "doc_id").alias("component_id")
    )
