"""Collocations: frequent phrases mined level by level from sorted occurrence relations."""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracerisk.llm.common import blocks
from tracerisk.sources import materialize

LEAST, LONGEST, TOP = 100, 5, 2000
UNDETERMINED = "und"
_ENDS = re.compile(rb"[.,;:!?\n-\r]")
# Distinct words or pairs that a task counts before it hands them on.
COUNTED = 500_000
# Frequent words (strings) and pairs (two numbers) that are sent to every task; more are joined by shuffle.
SENT_WORDS, SENT_PAIRS = 300_000, 2_000_000
# Parts over which a language's ranking is prepared.
RANK_PARTS = 64
_ID_BITS = 31


def _words(text: str) -> tuple[list[bytes], np.ndarray]:
    """Words of a text and their positions, which leave a gap between two pieces."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    # Of bytes, split() knows ASCII white space only: here space and tab, as the rest ends a piece.
    pieces = [p.split() for p in _ENDS.split(raw)]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    words = [w for p in pieces for w in p]
    return words, (np.arange(len(words)) + np.repeat(np.arange(len(pieces)), sizes)).astype(np.int32)


def _decoded(words) -> pa.Array:
    return pa.array([w.decode("utf-8", "surrogatepass") for w in words], pa.string())


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Languages and texts of a batch in runs of a bounded size."""
    for start, texts in blocks(batch.column(batch.schema.get_field_index("text"))):
        yield batch.column(batch.schema.get_field_index("lang")).slice(start, len(texts)).to_pylist(), texts


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and n; the word '' holds the number of all words."""

    def batch_of(counts):
        for lang, counter in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counter), pa.string()), _decoded(counter), pa.array(counter.values(), pa.int64())],
                ["lang", "word", "n"],
            )
        counts.clear()

    def run(batches):
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for langs, texts in _texts(batch):
                for lang, text in zip(langs, texts):
                    words, _ = _words(text)
                    counts[lang].update(words)
                    counts[lang][b""] += len(words)
                if sum(map(len, counts.values())) > COUNTED:
                    yield from batch_of(counts)
        yield from batch_of(counts)

    partial = docs.mapInArrow(run, "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _numbered(table: DataFrame) -> DataFrame:
    """The rows, written, with `id` counting them from 0 without gaps, in no set order."""
    part = F.spark_partition_id().alias("_part")
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")
    written = materialize(table.select("*", part, in_part))
    # One row per task of the write.
    sizes = written.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_part"], total))
        total += r["n"]
    if total >= 1 << _ID_BITS:
        raise ValueError(f"{total} frequent phrases of one length, more than ids can tell apart")
    offsets = table.sparkSession.createDataFrame(starts, "_part int, _start long")
    placed = written.join(F.broadcast(offsets), "_part")
    return placed.withColumn("id", F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), pa.array(values))


def _occurrence_batch(rows, lang, pos: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Occurrences of several texts; texts with fewer than two can't take part in a longer phrase."""
    keep = sizes > 1
    inside = np.repeat(keep, sizes)
    arrays = [_lists(pos[inside].astype(np.int32), sizes[keep]), _lists(ids[inside].astype(np.int32), sizes[keep])]
    at = np.flatnonzero(keep)
    return pa.RecordBatch.from_arrays([rows.take(pa.array(at)), *arrays], ["row", "pos", "id"])


def _word_occurrences(docs: DataFrame, frequent: DataFrame, limit: int) -> DataFrame:
    """Occurrences of frequent words: per text a row with sorted positions and word ids."""
    if frequent.limit(limit + 1).count() > limit:
        return _regrouped(_all_words(docs), frequent.select("lang", F.col("phrase").alias("key"), "id"), ["lang", "key"])
    by_lang: dict[str, dict] = defaultdict(dict)
    # At most `limit` words, as counted above.
    for lang, phrase, i in frequent.select("lang", "phrase", "id").toArrow().to_pandas().itertuples(index=False):
        by_lang[lang][phrase.encode("utf-8", "surrogatepass")] = i
    sent = docs.sparkSession.sparkContext.broadcast(dict(by_lang))

    def run(batches):
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("row"))
            at = 0
            for langs, texts in _texts(batch):
                found, places, sizes = [], [], []
                for lang, text in zip(langs, texts):
                    words, pos = _words(text)
                    get = sent.value.get(lang, {}).get
                    ids = np.array([get(w, -1) for w in words], np.int32)
                    hit = ids >= 0
                    found.append(ids[hit])
                    places.append(pos[hit])
                    sizes.append(int(hit.sum()))
                own = rows.slice(at, len(texts))
                at += len(texts)
                yield _occurrence_batch(own, None, np.concatenate(places), np.concatenate(found), np.array(sizes))

    return materialize(docs.mapInArrow(run, "row long, pos array<int>, id array<int>"))


def _all_words(docs: DataFrame) -> DataFrame:
    """row, lang, position and word of every word."""

    def run(batches):
        for batch in batches:
            at = 0
            rows = batch.column(batch.schema.get_field_index("row"))
            for langs, texts in _texts(batch):
                for i, (lang, text) in enumerate(zip(langs, texts)):
                    words, pos = _words(text)
                    row = pa.array([rows[at + i].as_py()] * len(words), pa.int64())
                    tongue = pa.array([lang] * len(words), pa.string())
                    yield pa.RecordBatch.from_arrays([row, tongue, pa.array(pos), _decoded(words)], ["row", "lang", "pos", "key"])
                at += len(texts)

    return docs.mapInArrow(run, "row long, lang string, pos int, key string")


def _regrouped(flat: DataFrame, frequent: DataFrame, on: list[str]) -> DataFrame:
    """Semi-join by shuffle of single occurrences with frequent keys, then one row per text again."""
    hits = flat.join(frequent, on).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("id").cast("int").alias("id")))).alias("hits"))
    return materialize(hits.filter(F.size("hits") > 1).select("row", "hits.pos", "hits.id"))


def _merged(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of a batch's sorted occurrences with themselves one place on: row number, position, pair of ids."""
    pos, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("pos", "id"))
    sizes = pos.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    p, i = pos.flatten().to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    next_to = (row[1:] == row[:-1]) & (p[1:] == p[:-1] + 1)
    return row[:-1][next_to], p[:-1][next_to], ((i[:-1] << 32) | i[1:])[next_to]


def _pair_counts(occurrences: DataFrame) -> DataFrame:
    """key (two ids) and n of all neighbouring occurrences, counted in each task first."""

    def run(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def combined():
            new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
            waiting.clear()
            both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate([counts, n]))
            return both, total

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

        for batch in batches:
            waiting.append(_merged(batch)[2])
            if sum(map(len, waiting)) > COUNTED:
                keys, counts = combined()
                if len(keys) > COUNTED:
                    yield out()
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = combined()
        yield out()

    return occurrences.select("pos", "id").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _pair_occurrences(occurrences: DataFrame, frequent: DataFrame, limit: int) -> DataFrame:
    """Semi-join of neighbouring occurrences with the frequent pairs: occurrences of the longer phrases."""
    if frequent.limit(limit + 1).count() > limit:

        def flat(batches):
            for batch in batches:
                row, pos, key = _merged(batch)
                rows = batch.column(batch.schema.get_field_index("row")).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([rows, pa.array(pos), pa.array(key)], ["row", "pos", "key"])

        pairs = occurrences.mapInArrow(flat, "row long, pos int, key long")
        return _regrouped(pairs, frequent.select("key", "id"), ["key"])
    # At most `limit` pairs, as counted above.
    table = frequent.select("key", "id").toArrow()
    keys, ids = (table.column(c).to_numpy() for c in ("key", "id"))
    order = np.argsort(keys)
    sent = occurrences.sparkSession.sparkContext.broadcast((keys[order], ids[order]))

    def run(batches):
        known, number = sent.value
        for batch in batches:
            row, pos, key = _merged(batch)
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            hit = known[at] == key if len(known) else np.zeros(len(key), bool)
            sizes = np.bincount(row[hit], minlength=batch.num_rows)
            rows = batch.column(batch.schema.get_field_index("row"))
            yield _occurrence_batch(rows, None, pos[hit], number[at[hit]], sizes)

    return materialize(occurrences.mapInArrow(run, "row long, pos array<int>, id array<int>"))


def frequent_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    sent_words: int = SENT_WORDS,
    sent_pairs: int = SENT_PAIRS,
) -> tuple[list[DataFrame], DataFrame]:
    """Phrases of 1 to `longest` words with `least` occurrences or more, a table per length; words per language.

    Set-oriented mining: the occurrences of the frequent words are written,
    sorted by text, piece and position. A phrase of k words is two overlapping ones
    of k - 1 words at neighbouring positions of a piece, so each length is a merge
    join of the last relation with itself, a count per pair, and a semi-join with the
    frequent pairs, whose result is the next relation. Texts never move; counts
    are combined in the tasks. Frequent words and pairs are sent to all tasks up to a
    checked number, else joined by shuffle.

    Each table has lang, phrase, last (word), id, f, key (ids of the phrase less its last
    and less its first word), heads and tails (f of the first and of the last 1, 2, ... words).
    """
    docs = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(lang, F.lit(UNDETERMINED)).alias("lang"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    counts = materialize(_word_counts(docs).filter((F.col("n") >= least) | (F.col("word") == "")))
    totals = counts.filter("word = ''").select("lang", "n")
    words = _numbered(counts.filter("word != ''").select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))
    one = F.array("f")
    tables = [
        materialize(words.select("lang", "phrase", F.col("phrase").alias("last"), "id", "f", F.lit(None).cast("long").alias("key"), one.alias("heads"), one.alias("tails")))
    ]
    occurrences = _word_occurrences(docs, tables[0], sent_words) if longest > 1 else None
    for k in range(2, longest + 1):
        pairs = _numbered(_pair_counts(occurrences).filter(F.col("n") >= least))
        short = tables[-1]
        left = short.select(F.col("id").alias("_l"), "lang", "phrase", "heads")
        right = short.select(F.col("id").alias("_r"), F.col("last"), "tails")
        pairs = pairs.withColumns({"_l": F.shiftright("key", 32), "_r": F.col("key").bitwiseAND(F.lit((1 << 32) - 1))})
        named = pairs.join(left, "_l").join(right, "_r").select(
            "lang",
            F.concat_ws(" ", "phrase", "last").alias("phrase"),
            "last",
            "id",
            F.col("n").alias("f"),
            "key",
            F.concat("heads", F.array("n")).alias("heads"),
            F.concat("tails", F.array("n")).alias("tails"),
        )
        tables.append(materialize(named))
        if k < longest:
            occurrences = _pair_occurrences(occurrences, tables[-1], sent_pairs)
    return tables, totals


def _cut(k: int) -> Column:
    """The lowest-scoring cut of a phrase of k words, the earliest of equal ones: score, place, l, r."""

    def at(j: int) -> Column:
        left, right = F.col("heads")[j - 1], F.col("tails")[k - j - 1]
        big = "decimal(20,0)"
        # Whole-number division of decimals: exact beyond 64 bits.
        score = F.call_function("div", F.lit(1000).cast(big) * F.col("f").cast(big) * F.col("n").cast(big), left.cast(big) * right.cast(big))
        return F.struct(score.alias("score"), F.lit(j).alias("place"), left.alias("l"), right.alias("r"))

    return F.array_min(F.array(*[at(j) for j in range(1, k)]))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    sent_words: int = SENT_WORDS,
    sent_pairs: int = SENT_PAIRS,
) -> DataFrame:
    """The `top` phrases of two words or more per language: lang, rank, phrase, a, l, r, n, score.

    a is the number of occurrences; the cut into two parts with the lowest
    floor(1000 a n / (l r)) counts, l and r being the occurrences of the parts and n all words of the
    language. Phrases inside a longer frequent phrase that occurs as often are left out: it is enough to look at
    those one word longer, as counts never grow with length. Order: score and a falling, then phrase.

    Texts are lower-cased (A-Z) and cut into pieces at . , ; : ! ? and line ends; words are split at
    space and tab. Null texts are empty, a null language is `und`. Repeated rows count each.
    An empty table, or no phrase that is frequent enough, gives no rows. Ids and other columns don't matter.
    """
    tables, totals = frequent_phrases(docs, text, lang, least, longest, sent_words, sent_pairs)
    out = None
    for k in range(2, longest + 1):
        own = tables[k - 1]
        if k < longest:
            longer = tables[k].select(
                F.explode(F.array(F.shiftright("key", 32), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)))).alias("id"), F.col("f").alias("f_longer")
            )
            held = own.join(longer, "id").filter(F.col("f_longer") * 100 >= F.col("f") * 100).select("id").distinct()
            own = own.join(held, "id", "left_anti")
        best = own.join(totals, "lang").withColumn("cut", _cut(k))
        best = best.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
        out = best if out is None else out.unionByName(best)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    in_part = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    few = materialize(out.withColumn("_part", part).withColumn("_place", in_part).filter(F.col("_place") <= top))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = few.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
