"""Byte-level BPE through a sentencepiece model serialised from a rank file."""

import base64
import struct
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracerisk.llm.common import with_columns

# Pre-tokens whose ids a worker remembers (a few hundred bytes each).
CACHED = 200_000
# Ids that are decoded at once.
DECODED = 1 << 20
# Numbers of the fields and enumerations of the public sentencepiece model format (fixed values).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 4, 40, 41, 42, 43
BPE_MODEL = 2
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of `base64 rank` lines; read on the driver, a few MB at most."""
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ranks of a vocabulary must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> list[str]:
    """One printable character per byte: Latin-1's own where printable, else those from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    more = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(more)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: Sequence[bytes]) -> bytes:
    """A BPE model whose ids are the ranks: byte-mapped pieces scored by negative rank.

    Merging the best-scored pair first is then merging the lowest rank first. The
    normaliser is the identity, without added, removed or escaped spaces. The
    unknown piece, which the format asks for, comes last and never occurs.
    """
    names = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        body = _field(PIECE, text.encode()) + _field(SCORE, score) + _field(TYPE, kind)
        return _field(PIECES, body)

    pieces = [piece("".join(names[b] for b in t), -float(i), NORMAL) for i, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, UNKNOWN))
    trainer = [(MODEL_TYPE, BPE_MODEL), (VOCAB_SIZE, len(pieces)), (UNK_ID, len(tokens))]
    trainer += [(BOS_ID, -1), (EOS_ID, -1), (PAD_ID, -1)]
    normalizer = [(NAME, b"identity"), (DUMMY_PREFIX, 0), (EXTRA_SPACES, 0), (ESCAPE_SPACES, 0)]
    return b"".join(
        [
            *pieces,
            _field(TRAINER, b"".join(_field(*x) for x in trainer)),
            _field(NORMALIZER, b"".join(_field(*x) for x in normalizer)),
        ]
    )


class Encoder:
    """Encodes pre-tokens with the serialised model; remembers those it has met."""

    def __init__(self, model: bytes, tokens: Sequence[bytes], pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.names = dict(enumerate(byte_characters()))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, Sequence[int]] = {}

    def learn(self, pre_tokens: set[str]) -> None:
        rest, texts = [], []
        for p in pre_tokens:
            raw = p.encode()
            # A pre-token that is a token takes its id, whether or not merges lead there.
            if (rank := self.whole.get(raw)) is not None:
                self.known[p] = (rank,)
            else:
                rest.append(p)
                texts.append(raw.decode("latin-1").translate(self.names))
        if rest:
            self.known.update(zip(rest, self.processor.encode(texts, num_threads=1), strict=True))

    def __call__(self, texts: Sequence[str]) -> pa.ListArray:
        split = [self.split(t) for t in texts]
        if len(self.known) > CACHED:
            self.known.clear()
        new = set(chain.from_iterable(split)).difference(self.known)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        ids = [np.fromiter(chain.from_iterable(map(get, s)), np.int32) for s in split]
        offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))


def encode_texts(
    docs: DataFrame,
    tokens: Sequence[bytes],
    pattern: str,
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add `ids` (array of int): the token ids of every whole text.

    Each match of `pattern` is encoded by itself, without special tokens. The model
    (a few MB, as large as the vocabulary) is serialised once on the driver and
    sent to the workers. A null or empty text has no ids. A column `ids` of `docs`
    is replaced. No shuffle, one row per row.
    """
    shared = docs.sparkSession.sparkContext.broadcast((sentencepiece_model(tokens), list(tokens)))
    made: list[Encoder] = []

    def run(texts):
        if not made:
            made.append(Encoder(*shared.value, pattern))
        return [made[0](texts)]

    return with_columns(docs, text, "ids array<int>", run, keep)


class Decoder:
    """Bytes of ids by the inverse mapping, as one gather from the joined tokens."""

    def __init__(self, tokens: Sequence[bytes]):
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)
        # An id outside the vocabulary has no bytes.
        self.size = np.array([*map(len, tokens), 0], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and how many each id gives."""
        n = len(self.size) - 1
        ids = np.where((ids < 0) | (ids >= n), n, ids)
        size = self.size[ids]
        shift = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.joined[shift + np.arange(len(shift))], size


def decode_ids(
    encoded: DataFrame,
    tokens: Sequence[bytes],
    ids: str = "ids",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add `decoded` (binary): the bytes of the ids, whole and in order.

    Ids that are null or outside the vocabulary give nothing; a null array gives no
    bytes. A column `decoded` is replaced. No shuffle, one row per row.
    """
    kept = [c for c in (encoded.columns if keep is None else keep) if c != "decoded"]
    whole = T.StructType(
        [*(encoded.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())]
    )
    source = encoded.select(*kept) if ids in kept else encoded.select(*kept, ids)
    shared = encoded.sparkSession.sparkContext.broadcast(list(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(batch.schema.get_field_index(ids))
            flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            data, size = decoder(flat)
            ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *lengths])]
            buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]
            new = pa.BinaryArray.from_buffers(pa.binary(), len(batch), buffers)
            old = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            return pa.RecordBatch.from_arrays([*old, new], names=[*kept, "decoded"])

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(batch):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + DECODED, "right")))
                yield part(batch.slice(start, stop - start))
                start = stop

    return source.mapInArrow(run, whole)
