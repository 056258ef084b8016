"""Words and hashes of many texts at once, in numpy, for use inside Arrow batches.

A word is a run of bytes other than `[\\x20\\x09-\\x0D]`. Texts are read in slices of bounded size, so memory
depends on the longest text and not on the number of rows in a batch.
"""

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH_LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 2_000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
}
SLICE_BYTES = 1 << 20  # texts handled together; one longer text is a slice of its own

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has at most about `size` bytes of text and at least one row."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(first, last - first)
        first = last


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts on end, and where each text begins (one more entry at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of several texts: word i is `data[start[i]:end[i]]`, with one space between words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # word at which each text begins, one more entry at the end
    origin: np.ndarray  # where each word begins in the texts on end

    @property
    def count(self) -> np.ndarray:
        """Words in each text."""
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def strings(self, which: np.ndarray) -> pa.Array:
        """The chosen words as strings."""
        lengths = (self.end - self.start)[which]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        spots = np.arange(offsets[-1]) + np.repeat(self.start[which] - offsets[:-1], lengths)
        return pa.Array.from_buffers(
            pa.large_string(), len(which), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[spots])]
        )


def split_words(texts: pa.Array, *, lower: bool = True) -> Words:
    """Split texts into words, lower-casing A-Z when asked to; a null text has none."""
    data, at = text_bytes(texts)
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    inner = at[:-1][(at[:-1] < len(data)) & (np.diff(at) > 0)]  # words end where a text ends
    opens[inner] = solid[inner]
    last = inner[inner > 0] - 1
    closes[last] = solid[last]
    begins = np.flatnonzero(opens)
    lengths = np.flatnonzero(closes) + 1 - begins
    ends = np.cumsum(lengths + 1) - 1 if len(lengths) else np.zeros(0, np.int64)
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    chars = data[solid]
    out[np.arange(len(chars)) + np.repeat(np.arange(len(lengths)), lengths)] = _LOWER[chars] if lower else chars
    return Words(out, ends - lengths, ends, np.searchsorted(begins, at), begins)


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to Python a few megabytes at a time, unless the session has set less.

    By default a batch is ten thousand rows, whatever they weigh.
    """
    for name, most in BATCH_LIMITS.items():
        now = int(spark.conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


@contextmanager
def without_collector() -> Iterator[None]:
    """Python's garbage collector rests while a task holds a million small objects without cycles; workers are reused, so it
    is switched on again and what is left goes."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()


# ── Hashes ────────────────────────────────────────────────────────────────────

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lane(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _rotate(acc + value * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer; all of them advance together."""
    start = start.astype(np.int64)
    length = end.astype(np.int64) - start
    padded = np.concatenate([data, np.zeros(40, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), seed64 + _P5)
        pos = start.copy()
        long = np.flatnonzero(length >= 32)
        if len(long):
            v = [np.full(len(long), x) for x in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            left, at = length[long] // 32, pos[long]
            live = np.arange(len(long))
            while len(live):
                for k in range(4):
                    v[k][live] = _lane(v[k][live], eights[at[live] + 8 * k])
                at[live] += 32
                left[live] -= 1
                live = live[left[live] > 0]
            acc = _rotate(v[0], 1) + _rotate(v[1], 7) + _rotate(v[2], 12) + _rotate(v[3], 18)
            for x in v:
                acc = (acc ^ _lane(np.uint64(0), x)) * _P1 + _P4
            h[long] = acc
            pos[long] = at
        h += length.astype(np.uint64)
        rest = end - pos
        for _ in range(3):
            live = np.flatnonzero(rest >= 8)
            if not len(live):
                break
            h[live] = _rotate(h[live] ^ _lane(np.uint64(0), eights[pos[live]]), 27) * _P1 + _P4
            pos[live] += 8
            rest[live] -= 8
        live = np.flatnonzero(rest >= 4)
        if len(live):
            four = eights[pos[live]] & np.uint64(0xFFFFFFFF)
            h[live] = _rotate(h[live] ^ (four * _P1), 23) * _P2 + _P3
            pos[live] += 4
            rest[live] -= 4
        for _ in range(3):
            live = np.flatnonzero(rest > 0)
            if not len(live):
                break
            h[live] = _rotate(h[live] ^ (padded[pos[live]].astype(np.uint64) * _P5), 11) * _P1
            pos[live] += 1
            rest[live] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every run of `size` words; a text with fewer words is one run, one with none has none."""
    doc = words.doc()
    spot = np.arange(len(doc))
    last = words.first[1:][doc] - 1 if len(doc) else spot
    keep = (spot + size - 1 <= last) | (spot == words.first[:-1][doc])
    spot, doc = spot[keep], doc[keep]
    return words.start[spot], words.end[np.minimum(spot + size - 1, last[keep])], doc
