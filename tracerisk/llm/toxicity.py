"""Toxicity by compression distance: two zstandard dictionaries, window lengths, calibration."""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracerisk.llm.common import fold_of, held_out, sample_rows, with_columns
from tracerisk.sources import materialize

# Labelled documents per class that the dictionaries are trained on, and documents that calibrate.
TRAIN_ROWS, CALIBRATION_ROWS = 1_500, 2_000
WINDOW_WORDS = 6
# Bytes of the base that both dictionaries share, and of what each class adds.
BASE_BYTES, OWN_BYTES = 112_640, 4_096
ROUNDS = 5
# Bytes by which a window has to tell the classes apart to be trained on again.
TELLING = 3
AT_ONCE = 1_000
WORDS = regex.compile(r"[^\W\d_]+").findall


def windows(text: str) -> list[bytes]:
    """Lower-cased letter runs in windows of six; one blank window if there are none."""
    words = WORDS(text.lower())
    parts = range(0, len(words), WINDOW_WORDS)
    return [" ".join(words[i : i + WINDOW_WORDS]).encode() for i in parts] or [b" "]


def train_dictionary(samples: Sequence[bytes], size: int, segment: int) -> bytes:
    """A zstandard dictionary; where the samples are too few for one, their last bytes."""
    try:
        made = zstandard.train_dictionary(size, list(samples), k=segment, d=6, level=3)
        return made.as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(samples)[-size:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        compression_level=3,
        window_log=17,
        hash_log=15,
        chain_log=15,
        search_log=4,
        min_match=3,
        target_length=64,
        strategy=zstandard.STRATEGY_BTOPT,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    loaded = zstandard.ZstdCompressionDict(dictionary)
    loaded.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=loaded, compression_params=parameters)


def lengths(own: zstandard.ZstdCompressor, parts: Sequence[bytes]) -> np.ndarray:
    out = []
    for i in range(0, len(parts), AT_ONCE):
        done = own.multi_compress_to_buffer(parts[i : i + AT_ONCE], threads=1)
        out += [len(done[k]) for k in range(len(done))]
    return np.array(out, np.int64)


class Distance:
    """How many bytes fewer each window takes with the toxic dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)

    def __call__(self, parts: Sequence[bytes]) -> np.ndarray:
        return lengths(self.ordinary, parts) - lengths(self.toxic, parts)

    def features(self, texts: Sequence[str]) -> np.ndarray:
        """Per text: mean and largest distance, windows, and the windows over each threshold."""
        parts = [windows(t) for t in texts]
        counts = np.array([*map(len, parts)])
        starts = np.cumsum(counts) - counts
        apart = self([w for p in parts for w in p])
        columns = [
            np.add.reduceat(apart, starts) / counts,
            np.maximum.reduceat(apart, starts),
            np.log(counts),
        ]
        for threshold in range(6):
            over = np.add.reduceat((apart > threshold).astype(np.int64), starts)
            columns += [over / counts, np.log1p(over)]
        return np.stack(columns, axis=1).astype(float)


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _calibrate(features: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logistic regression with a slight penalty, by Newton steps; the last value is its loss."""
    mean, scale = features.mean(0), features.std(0) + 1e-9
    x = np.column_stack([np.ones(len(features)), (features - mean) / scale])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[0.1] * features.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - truth) + penalty @ w
        w = w - np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, slope)
    z = np.clip(x @ w, -30, 30)
    loss = np.logaddexp(0, z).sum() - (z * truth).sum()
    return mean, scale, w, loss


def train_toxicity_model(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    toxic: str = "toxic",
) -> ToxicityModel | None:
    """Learn from labelled rows outside the held-out fold; None if one class is missing.

    The classifier is fitted on a bounded sample of the labelled rows that `docs` holds, chosen by a hash of the id: at
    most TRAIN_ROWS documents a class from folds 2 to 4, and CALIBRATION_ROWS from
    fold 1; only these reach the driver. Both dictionaries begin with one trained
    on ordinary windows, so that what they have in common costs the same; each
    adds a small one of its class. These are first trained on the windows that the
    common part compresses worst, and then in rounds on those that told the classes
    apart: truly in toxic text, either way in ordinary text. Calibration fits the
    thresholds' weights, and the round with the least loss stays.
    """
    known = labels.filter(F.col(toxic).isNotNull() & ~held_out(doc_id)).select(
        F.col(doc_id).alias("doc_id"), F.col(toxic).alias("toxic")
    )
    # Labels of documents that are gone would only thin the sample out. Ids alone are joined.
    known = materialize(known.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi"))
    trained = fold_of("doc_id") != 1
    parts = [
        sample_rows(known.filter(trained & (F.col("toxic") == k)), TRAIN_ROWS, "doc_id")
        for k in (0, 1)
    ]
    parts.append(sample_rows(known.filter(~trained), CALIBRATION_ROWS, "doc_id"))
    # At most TRAIN_ROWS * 2 + CALIBRATION_ROWS narrow rows.
    chosen = F.broadcast(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = texts.join(chosen, "doc_id").withColumn("fold", fold_of("doc_id"))
    # Ids are as good as distinct; where one has many rows, only so many are taken.
    rows = rows.limit(2 * (2 * TRAIN_ROWS + CALIBRATION_ROWS)).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    first = rows[rows["fold"] != 1]
    by_class = [first.loc[first["toxic"] == k, "text"] for k in (0, 1)]
    plain, bad = ([w for t in part for w in windows(t)] for part in by_class)
    if not plain or not bad:
        return None
    second = rows[rows["fold"] == 1]
    if second["toxic"].nunique() < 2:
        second = rows
    truth = second["toxic"].to_numpy(float)

    base = train_dictionary(plain, BASE_BYTES, 30)
    common = compressor(base)

    def worst(parts: list[bytes]) -> list[bytes]:
        cost = lengths(common, parts) / np.array([len(w) + 8 for w in parts])
        least = np.quantile(cost, 0.9)
        return [w for w, c in zip(parts, cost, strict=True) if c >= least]

    own = [worst(plain), worst(bad)]
    best, least_loss = None, np.inf
    for _ in range(ROUNDS):
        added = [train_dictionary(x, OWN_BYTES, 12) for x in own]
        size = min(map(len, added))
        ordinary, toxic_one = (base + x[len(x) - size :] for x in added)
        distance = Distance(toxic_one, ordinary)
        mean, scale, weights, loss = _calibrate(distance.features(second["text"]), truth)
        if loss < least_loss:
            best, least_loss = ToxicityModel(toxic_one, ordinary, mean, scale, weights), loss
        plain_apart, bad_apart = distance(plain), distance(bad)
        again = [w for w, x in zip(bad, bad_apart, strict=True) if x >= TELLING]
        if not again:
            break
        hard = [w for w, x in zip(plain, plain_apart, strict=True) if abs(x) >= TELLING]
        own = [hard + own[0][: len(own[0]) // 4], again]
    return best


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel | None,
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on), from the whole text alone.

    A null or empty text is one blank window. Without a model every score is 0.
    Columns with these names are replaced. No shuffle, one row per row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list[Distance] = []

    def run(texts):
        own = shared.value
        if own is None:
            return [[0.0] * len(texts), [0] * len(texts)]
        if not made:
            made.append(Distance(own.toxic, own.ordinary))
        scores = own.score(made[0].features(texts))
        return [scores, (scores >= 0.5).astype(np.int32)]

    return with_columns(docs, text, "score double, predicted int", run, keep)
