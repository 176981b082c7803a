"""Near duplicates: ProbMinHash of word shingles, bands, verification, classes."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracerisk.llm.common import BROADCAST_ROWS, mix64, with_columns
from tracerisk.llm.graph import components
from tracerisk.sources import materialize

SHINGLE = 5
SIMILARITY = 0.8
# 24 bands of 4: a pair at similarity 0.8 misses all with probability 3e-6.
BANDS, ROWS = 24, 4
COMPONENTS = BANDS * ROWS
# Rounds of pivots, and the size of a group whose unlinked members are compared one by one.
ROUNDS, SMALL_GROUP = 3, 16
# Texts of a shingle that one salt of the prefix join holds.
SALT_ROWS = 1_000
CACHED_WORDS = 500_000


class Shingler:
    """64-bit hashes of the five-word shingles of texts; words are split at white space."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All shingles (repeats included) of all texts, and how many each text has.

        A text with one to four words is one shingle; one without words has none.
        """
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        split = [t.split() for t in texts]
        get, know = self.words.get, self.words
        flat = []
        for words in split:
            for w in words:
                h = get(w)
                if h is None:
                    h = know[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                flat.append(h)
        values = np.array(flat, np.uint64)
        sizes = np.array([*map(len, split)], np.int64)
        out = np.zeros(len(values), np.uint64)
        # Shorter windows at the end of a text are dropped, except for a text of under five words.
        for k in range(SHINGLE):
            moved = np.zeros(len(values), np.uint64)
            moved[: max(len(values) - k, 0)] = values[k:]
            out = mix64(out + moved + np.uint64(0x9E3779B97F4A7C15))
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(values)) - np.repeat(starts, sizes)
        keep = place <= np.repeat(sizes, sizes) - SHINGLE
        short = (sizes > 0) & (sizes < SHINGLE)
        for i in np.flatnonzero(short):
            own = values[starts[i] : starts[i] + sizes[i]]
            h = np.zeros(1, np.uint64)
            for v in own:
                h = mix64(h + v + np.uint64(0x9E3779B97F4A7C15))
            out[starts[i]] = mix64(h + np.uint64(len(own)))[0]
            keep[starts[i]] = True
        counts = np.where(short, 1, np.maximum(sizes - SHINGLE + 1, 0))
        return out[keep], counts


def weighted_sets(shingles: np.ndarray, counts: np.ndarray):
    """Distinct shingles of each text with their numbers: text, shingle, weight, sorted."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((shingles, text))
    text, shingles = text[order], shingles[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (shingles[1:] != shingles[:-1])
    at = np.flatnonzero(first)
    return text[at], shingles[at], np.diff(np.append(at, len(text)))


def probminhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash signatures (n x COMPONENTS): two agree in a component with probability J_P.

    Each element is a Poisson process whose rate is its weight; every arrival falls
    on a random component, which keeps the element that arrives first. An element
    stops once its arrivals are later than what every component of its text holds.
    """
    best = np.full((n, COMPONENTS), np.inf)
    sign = np.zeros((n, COMPONENTS), np.uint64)
    time = np.zeros(len(element))
    seed = mix64(element + np.uint64(0xD1B54A32D192ED03))
    active = np.arange(len(element))
    flat_best, flat_sign = best.reshape(-1), sign.reshape(-1)
    while len(active):
        seed[active] = mix64(seed[active] + np.uint64(0x9E3779B97F4A7C15))
        bits = seed[active]
        uniform = ((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
        time[active] -= np.log(uniform) / weight[active]
        # The component comes from another hash than the time.
        part = mix64(bits ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(COMPONENTS)
        slot = text[active] * COMPONENTS + part.astype(np.int64)
        now = time[active]
        earlier = now < flat_best[slot]
        np.minimum.at(flat_best, slot[earlier], now[earlier])
        won = earlier & (now == flat_best[slot])
        flat_sign[slot[won]] = element[active[won]]
        latest = best.max(axis=1)
        active = active[now < latest[text[active]]]
    return sign


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different bands having different keys."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    key = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :].repeat(len(parts), 0)
    for r in range(ROWS):
        key = mix64(key + parts[:, :, r])
    return key.view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.cumsum([0, *sizes], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _signed(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest and bands of every text; no bands for texts without words.

    A text with repeated shingles has two signatures, so up to twice the bands. In one a shingle weighs as often
    as it occurs: two of these agree with the probability Jaccard similarity of the weighted shingles,
    which brings texts together whose repeated passages agree. In the other every shingle weighs 1: two of
    these agree with the Jaccard similarity of the sets, the measure that links are verified
    by, so that repeats hide no link. Without repeats both are the same.
    """
    made: list[Shingler] = []

    def run(texts):
        if not made:
            made.append(Shingler())
        shingles, counts = made[0](texts)
        text, element, weight = weighted_sets(shingles, counts)
        keys = band_keys(probminhash(text, element, np.ones(len(text)), len(texts)))
        # Texts with repeats a second time, numbered on from the others.
        repeats = np.flatnonzero(np.bincount(text, weight > 1, len(texts)))
        place = np.full(len(texts), -1)
        place[repeats] = np.arange(len(repeats))
        own = place[text] >= 0
        weighted = probminhash(place[text[own]], element[own], weight[own].astype(float), len(repeats))
        weighted = band_keys(weighted)
        both = np.concatenate([keys, weighted])
        # Where both signatures agree, a band is listed once.
        new = np.concatenate([np.repeat((counts > 0)[:, None], BANDS, 1), weighted != keys[repeats]])
        order = np.argsort(np.concatenate([np.arange(len(texts)), repeats]), kind="stable")
        sizes = new[: len(texts)].sum(axis=1)
        sizes[repeats] += new[len(texts) :].sum(axis=1)
        return [_lists(both[order][new[order]], sizes)]

    return with_columns(docs, "text", "bands array<bigint>", run, keep=["row", "doc_id", "digest"])


def _shingled(docs: DataFrame) -> DataFrame:
    """node and its distinct shingles."""
    made: list[Shingler] = []

    def run(texts):
        if not made:
            made.append(Shingler())
        text, element, _ = weighted_sets(*made[0](texts))
        return [_lists(element.view(np.int64), np.bincount(text, minlength=len(texts)))]

    return with_columns(docs, "text", "shingles array<bigint>", run, keep=["node"])


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast if a written table of narrow rows is small enough."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def _pairs(members: DataFrame, labels: DataFrame | None, used: DataFrame | None) -> DataFrame:
    """Candidate pairs (node, pivot) of bucket members that are not in one class yet.

    Each bucket's pivot is the member that meets most others over all bands: the
    text that the others were edited from agrees with more of them than they do
    with each other. Pivots combine before the shuffle; a bucket's members only
    meet them in a join, whose large partitions Spark splits.
    """
    if labels is None:
        rows = members.withColumn("class", F.col("node"))
    else:
        rows = members.join(labels, "node", "left").withColumn(
            "class", F.coalesce("component", F.col("node"))
        ).drop("component")
    free = rows if used is None else rows.join(
        used.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti"
    )
    spread = rows.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y"))
    order = F.struct("score", (-F.col("node")).alias("n"), "class")
    pivots = free.groupBy("key").agg(F.max(order).alias("p"))
    pivots = pivots.join(spread.filter("x != y").select("key"), "key").select(
        "key", (-F.col("p.n")).alias("pivot"), F.col("p.class").alias("pivot_class")
    )
    pivots = materialize(pivots)
    return rows.join(pivots, "key").filter(
        (F.col("node") != F.col("pivot")) & (F.col("class") != F.col("pivot_class"))
    ).select("key", "node", "pivot")


def _linked(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose shingle sets have this Jaccard similarity, exactly computed."""
    left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    size = F.size("s").cast("long") + F.size("t")
    # Sets of too different sizes can't be similar; they needn't be intersected.
    fits = F.least(F.size("s"), F.size("t")) >= similarity * F.greatest(F.size("s"), F.size("t"))
    both = F.size(F.array_intersect("s", "t"))
    near = pairs.join(left, "a").join(right, "b").filter(fits)
    return near.filter(both >= similarity * (size - both) - 1e-9).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    similarity: float = SIMILARITY,
    rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id and class_id, the least doc_id of the class, for every document.

    A class is a component of the links between texts whose sets of five-word
    shingles have a Jaccard similarity of `similarity` or more; equal texts share a
    class. Copies are set aside by digest, so links are sought between different
    texts only. Each text gets a ProbMinHash signature of its set of shingles;
    texts that agree in a band share a bucket. In each bucket all
    members are compared with one pivot (`_pairs`), exactly; buckets whose members
    are then still in several classes get another pivot, `rounds` times in all. What is left
    is closed exactly: buckets of up to SMALL_GROUP members member by member, larger
    ones by an exact join on rare shingles (`_prefix_pairs`). The pivots only spare
    pairs: no link between texts that share a bucket is missed.

    One row per row that goes in. Null texts count as empty; empty texts are copies
    of each other, and so are texts of white space alone that are equal. Rows that
    share an id share a class, whatever their texts: an id is a link. A row without an id is in no class (class_id null).
    Columns of `docs` other than the two don't matter.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")
    )
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    signed = materialize(_signed(rows.withColumn("row", F.monotonically_increasing_id())))
    known = signed.filter(F.col("doc_id").isNotNull())
    # Written before the joins below: Spark splits a large key only between two plain shuffles.
    first = materialize(known.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id")))
    together = materialize(
        known.join(first, "digest").select(
            "doc_id", "node", F.when(F.col("row") == F.col("node"), F.col("bands")).alias("bands")
        )
    )
    keyed = together.filter(F.col("bands").isNotNull()).select(
        "node", F.explode("bands").alias("key")
    )
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    met = materialize(keyed.join(sizes, "key"))
    scores = materialize(met.groupBy("node").agg(F.sum("size").alias("score")))
    members = materialize(met.join(scores, "node").distinct())
    nodes = materialize(scores.select("node"))
    # Of a text's copies, those of the least id stand for all.
    wanted = first.join(small(nodes), "node").withColumnRenamed("first_id", "doc_id")
    texts = rows.join(small(materialize(wanted)), ["digest", "doc_id"]).select("node", "text")
    shingles = materialize(_shingled(texts).dropDuplicates(["node"]))

    links, used, tested, labels = _id_links(together), None, None, None
    if links is not None:
        labels = materialize(components(links))
    for k in range(rounds):
        if labels is None:
            candidates = materialize(_pairs(members, None, None))
        else:
            candidates = materialize(_pairs(members, labels, used))
        pairs = _ordered(candidates.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        if pairs.isEmpty():
            break
        found = _linked(pairs, shingles, similarity)
        links = found if links is None else links.unionByName(found)
        links = materialize(links)
        labels = materialize(components(links))
        pivots = candidates.select("key", "pivot").distinct()
        used = materialize(pivots if used is None else used.unionByName(pivots))
        tested = pairs if tested is None else tested.unionByName(pairs)
    if tested is not None:
        few = _small_groups(members, labels)
        many = _prefix_pairs(_open_texts(members, labels), shingles, similarity)
        pairs = materialize(_ordered(few.unionByName(many)).join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            found = materialize(_linked(pairs, shingles, similarity))
            if not found.isEmpty():
                labels = materialize(components(links.unionByName(found)))
    classes = together.select("doc_id", "node").join(_class_ids(first, labels), "node").select("doc_id", "class_id")
    without = signed.filter(F.col("doc_id").isNull()).select(
        "doc_id", F.lit(None).cast("long").alias("class_id")
    )
    return classes.unionByName(without)


def _id_links(together: DataFrame) -> DataFrame | None:
    """Links between the texts that share an id; None if there are none."""
    named = materialize(together.select("doc_id", "node").distinct())
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a != z")
    several = materialize(several.select("doc_id", "a"))
    if several.isEmpty():
        return None
    links = named.join(several, "doc_id").filter("node != a").select("a", F.col("node").alias("b"))
    return materialize(links)


def _class_ids(first: DataFrame, labels: DataFrame | None) -> DataFrame:
    """node and class_id, the least id of all texts of its component."""
    own = first.select("node", "first_id")
    if labels is None:
        return own.withColumnRenamed("first_id", "class_id")
    linked = labels.join(own, "node")
    least = materialize(linked.groupBy("component").agg(F.min("first_id").alias("least")))
    reached = materialize(labels.join(small(least), "component").select("node", "least"))
    found = own.join(small(reached), "node", "left")
    return materialize(found.select("node", F.coalesce("least", "first_id").alias("class_id")))


def _ordered(pairs: DataFrame) -> DataFrame:
    """The distinct pairs, the lesser node first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _small_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs across classes of the buckets with few members."""
    few = members.filter(F.col("size") <= SMALL_GROUP)
    few = few.join(labels, "node", "left").withColumn("class", F.coalesce("component", "node"))
    one = few.select("key", F.col("node").alias("a"), F.col("class").alias("x"))
    other = few.select("key", F.col("node").alias("b"), F.col("class").alias("y"))
    return one.join(other, "key").filter("a > b and x != y").select("a", "b")


def _open_texts(members: DataFrame, labels: DataFrame) -> DataFrame:
    """node and class of the members of larger buckets that are still in several classes."""
    rows = members.filter(F.col("size") > SMALL_GROUP).join(labels, "node", "left")
    rows = rows.select("key", "node", F.coalesce("component", "node").alias("class"))
    several = rows.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x != y")
    return materialize(rows.join(several.select("key"), "key").select("node", "class").distinct())


def _prefix_pairs(texts: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """All pairs across classes of `texts` that can be similar, by their rarest shingles.

    Sets that overlap by `o` share a shingle among the first size - o + 1 of each, in
    any common order; here shingles that occur in one class only come first (no pair
    has them), then rarer ones. The smaller set of a similar pair needs the shorter
    prefix only (as if both had its size), so a passage that all texts share, but that doesn't make
    them similar, gives no pairs. Of each shingle's texts, those outside its largest class meet
    all, and those of that class only the former; many texts are spread over salts.
    """
    if texts.isEmpty():
        return texts.select(F.col("node").alias("a"), F.col("node").alias("b"))
    flat = shingles.join(small(texts), "node").select(
        "node", "class", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")
    )
    shared = flat.groupBy("shingle").agg(
        F.count("*").alias("n"), F.min("class").alias("x"), F.max("class").alias("y")
    )
    shared = materialize(shared.filter("x != y").select("shingle", "n"))
    least = similarity * F.col("size")
    both = 2 * similarity / (1 + similarity) * F.col("size")
    own = flat.join(small(shared), "shingle").groupBy("node", "class", "size").agg(
        F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("s")
    )
    # A little less than the bound: rounding may only lengthen a prefix.
    first = F.col("size") - F.ceil(least - 1e-6) + 1
    rows = own.select(
        "node", "class", "size", (F.col("size") - F.size("s")).alias("single"), F.posexplode("s").alias("k", "e")
    )
    rows = rows.withColumn("place", F.col("single") + F.col("k") + 1).filter(F.col("place") <= first)
    rows = materialize(
        rows.select(
            "node", "class", "size", "place", F.col("e.shingle").alias("shingle"),
            (F.col("place") <= F.col("size") - F.ceil(both - 1e-6) + 1).alias("short"),
        )
    )
    counts = rows.groupBy("shingle", "class").agg(
        F.count("*").alias("n"), F.count_if("short").alias("n_short")
    )
    counts = counts.groupBy("shingle").agg(
        F.max_by("class", F.struct("n", "class")).alias("main"), F.max("n").alias("most"),
        F.sum("n").alias("n"), F.sum("n_short").alias("n_short"),
    )
    counts = counts.filter("n > most and n_short > 0").select(
        "shingle", "main", F.ceil(F.col("n_short") / SALT_ROWS).cast("int").alias("salts")
    )
    met = materialize(rows.join(materialize(counts), "shingle"))
    minor = F.col("class") != F.col("main")
    left = met.filter("short").select(
        "shingle", (~minor).alias("of_main"), F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"),
        F.col("node").alias("a"), F.col("class").alias("x"), F.col("size").alias("m"), F.col("place").alias("p"),
    )
    right = met.select(
        "shingle", F.explode(F.when(minor, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("of_main"),
        "node", "class", "size", "place", "salts",
    )
    right = right.select(
        "shingle", "of_main", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.col("node").alias("b"), F.col("class").alias("y"), F.col("size").alias("n"), F.col("place").alias("q"),
    )
    overlap = F.ceil(similarity / (1 + similarity) * (F.col("m") + F.col("n")) - 1e-6)
    met = left.join(right, ["shingle", "of_main", "salt"]).filter(
        (F.col("x") != F.col("y"))
        & (F.col("m") <= F.col("n"))
        & (F.col("m") >= similarity * F.col("n") - 1e-6)
        & (F.col("p") <= F.col("m") - overlap + 1)
        & (F.col("q") <= F.col("n") - overlap + 1)
    )
    return met.select("a", "b")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Keep one document of each class, the one with the least id; rows without an id stay.

    All columns stay. The ids that go are broadcast up to a checked number, else
    joined by shuffle. Of the rows that share the least id, repeated rows too, an arbitrary one stays.
    """
    classes = materialize(near_duplicates(docs, text, doc_id))
    gone = classes.filter(F.col("doc_id") != F.col("class_id"))
    gone = materialize(gone.select(F.col("doc_id").alias("_id")).distinct())
    kept = docs.join(small(gone), F.col(doc_id) == F.col("_id"), "left_anti")
    least = classes.filter(F.col("doc_id") == F.col("class_id"))
    several = least.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1")
    several = materialize(several.select("_id"))
    if several.isEmpty():
        return kept
    # Only rows of ids that occur several times are shuffled; most of them go before it.
    apart = kept.join(small(several), F.col(doc_id) == F.col("_id"), "left_semi").dropDuplicates([doc_id])
    return kept.join(small(several), F.col(doc_id) == F.col("_id"), "left_anti").unionByName(apart)
