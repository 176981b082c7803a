"""Language identification by error-correcting output codes over byte n-grams."""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracerisk.llm.common import blocks, fold_of, held_out, sample_rows, with_columns

NGRAM = 3
BUCKETS = 1 << 14
UNDETERMINED = "und"
# Documents that calibrate the bits; only their bit margins reach the driver.
CALIBRATION_ROWS = 5_000
# Bytes whose n-grams are looked up at once.
PIECE = 1 << 16
LETTER = regex.compile(r"\p{L}")
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[b for b in range(128) if not chr(b).isalpha()]] = 32


def ngrams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of lower-cased texts, and where each text's begin.

    ASCII characters other than letters count as spaces; trigrams of spaces alone
    are in the last bucket, which has no weight.
    """
    raw = [t.lower().encode() for t in texts]
    joined = _SPACED[np.frombuffer(b"  ".join([b"", *raw, b""]), np.uint8)].astype(np.uint32)
    codes = joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]
    hashed = (codes * np.uint32(2654435761)) >> np.uint32(16)
    hashed = (hashed % np.uint32(BUCKETS - 1)).astype(np.int32)
    hashed[codes == 0x202020] = BUCKETS - 1
    starts = np.cumsum([0, *(len(r) + 2 for r in raw[:-1])])
    return hashed, starts


def codewords(n: int, least_bits: int = 15, tries: int = 200) -> np.ndarray:
    """A 0/1 codeword per language, from random matrices the one with the largest least distance.

    No column is constant or repeats another (or its complement), so up to four
    languages get all columns there are.
    """
    bits = max(least_bits, int(np.ceil(6 * np.log2(max(n, 2)))))
    bits = min(bits, 2 ** (n - 1) - 1) if n < 16 else bits
    rng = np.random.default_rng(7)
    best, best_distance = None, -1
    for _ in range(tries):
        columns: list[np.ndarray] = []
        seen: set[bytes] = set()
        while len(columns) < bits:
            c = rng.integers(0, 2, n)
            c = c ^ c[0]
            if c.any() and c.tobytes() not in seen:
                seen.add(c.tobytes())
                columns.append(c)
        code = np.array(columns).T
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + bits * np.eye(n, dtype=int)
        if apart.min() > best_distance:
            best, best_distance = code, apart.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit: log-odds of the n-gram
    scale: np.ndarray  # per bit, a typical margin
    trust: np.ndarray  # per bit, how often it is right beyond chance

    def margins(self, texts: Sequence[str]) -> np.ndarray:
        """Mean log-odds of each text's n-grams, per bit."""
        hashed, starts = ngrams(texts)
        total = np.zeros((len(texts), self.weights.shape[1]), np.float64)
        for at in range(0, len(hashed), PIECE):
            piece = self.weights[hashed[at : at + PIECE]]
            first = np.searchsorted(starts, at, "right") - 1
            last = np.searchsorted(starts, at + len(piece), "left")
            inner = np.maximum(starts[first:last] - at, 0)
            total[first:last] += np.add.reduceat(piece, inner, axis=0)
        counted = np.diff(np.append(starts, len(hashed)))
        return total / np.maximum(counted, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword under the weighted logistic loss, its share, and its lead."""
        signs = 2.0 * self.code - 1
        z = 4 * margins / self.scale
        loss = np.logaddexp(0, -z[:, None, :] * signs[None]) @ self.trust
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        ranked = np.sort(share, axis=1)
        lead = ranked[:, -1] - (ranked[:, -2] if ranked.shape[1] > 1 else 0)
        return best, ranked[:, -1], lead


def _counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """n-grams per language, combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for start, texts in blocks(batch.column(1)):
                hashed, starts = ngrams(texts)
                ends = np.append(starts[1:], len(hashed))
                for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    own = sums.setdefault(langs[start + i], np.zeros(BUCKETS, np.int64))
                    np.add.at(own, hashed[a:b], 1)
        for name, own in sums.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some)), pa.array(some.astype(np.int32)), pa.array(own[some])],
                names=["lang", "bucket", "n"],
            )

    counted = docs.select(lang, text).mapInArrow(run, "lang string, bucket int, n bigint")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train_language_model(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id"
) -> LanguageModel:
    """Learn from text and non-null language of the rows outside the held-out fold.

    Folds 2 to 4 are counted, all rows and whole texts: the counts (languages x
    16,384 numbers, whatever the size of the input) reach the driver. Each bit of
    the codewords gets an n-gram classifier: the log-odds of a bucket between the
    languages with a 1 and those with a 0 there. CALIBRATION_ROWS rows of fold 1
    give each bit's typical margin and how far it can be trusted. If fold 1 is
    empty, all bits count the same; without any labelled row there are no languages.
    """
    known = docs.filter(F.col(lang).isNotNull() & ~held_out(doc_id)).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id")
    )
    rows = _counts(known.filter(fold_of("doc_id") != 1), "text", "lang").toPandas()
    languages = sorted(rows["lang"].unique())
    if not languages:
        empty = np.zeros((0, 0))
        return LanguageModel([], empty, empty, np.zeros(0), np.zeros(0))
    counts = np.zeros((len(languages), BUCKETS))
    place = {name: i for i, name in enumerate(languages)}
    counts[rows["lang"].map(place), rows["bucket"]] = rows["n"]
    counts[:, -1] = 0
    # Languages count alike, however many rows they have.
    rates = (counts + 0.1) / (counts + 0.1).sum(1, keepdims=True)
    if len(languages) == 1:
        none = np.zeros((BUCKETS, 0), np.float32)
        return LanguageModel(languages, np.zeros((1, 0)), none, np.ones(0), np.ones(0))
    code = codewords(len(languages))
    one = (code / code.sum(0)).T @ rates
    zero = ((1 - code) / (1 - code).sum(0)).T @ rates
    weights = np.log(one / zero).T.astype(np.float32)
    weights[-1] = 0
    bits = code.shape[1]
    model = LanguageModel(languages, code, weights, np.ones(bits), np.ones(bits))

    # Ids are drawn, not texts: at most CALIBRATION_ROWS of them.
    second = known.filter(fold_of("doc_id") == 1)
    drawn = F.broadcast(sample_rows(second.select("doc_id"), CALIBRATION_ROWS, "doc_id"))
    sample = second.join(drawn, "doc_id", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tried = with_columns(
        sample,
        "text",
        "margins array<double>",
        lambda texts: [list(shared.value.margins(texts))],
        keep=["lang"],
    )
    # An id that many rows share may have been drawn.
    tried = tried.limit(2 * CALIBRATION_ROWS).toPandas()
    tried = tried[tried["lang"].isin(languages)]
    if len(tried):
        margins = np.stack(tried["margins"].to_numpy())
        truth = 2 * code[tried["lang"].map(place)] - 1
        model.scale = np.maximum(np.abs(margins).mean(0), 1e-6)
        model.trust = np.maximum(2 * (margins * truth > 0).mean(0) - 1, 1e-3)
    return model


def predict_language(
    docs: DataFrame,
    model: LanguageModel,
    text: str = "text",
    keep: Sequence[str] | None = None,
    least_lead: float = 0.2,
) -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous, from the whole text alone.

    The codeword with the least loss wins, each bit weighted by its trust; score is
    its share among all codewords. A text is ambiguous if it leads the next
    codeword by less than `least_lead`. A null text, one without a letter, and any
    text if no language was learned give `und`, score 0, not ambiguous. Columns
    with these names are replaced. No shuffle, one row per row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        m = shared.value
        lettered = np.array([bool(LETTER.search(t)) for t in texts])
        if not m.languages:
            return [[UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)]
        best, share, lead = m.decode(m.margins(texts))
        names = [m.languages[i] if ok else UNDETERMINED for i, ok in zip(best, lettered)]
        return [names, np.where(lettered, share, 0.0), lettered & (lead < least_lead)]

    schema = "lang_pred string, score double, ambiguous boolean"
    return with_columns(docs, text, schema, run, keep)
