"""What several operators of this package share: byte streams of texts, word fingerprints, checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from pagetally.tables import checkpointed  # noqa: F401  (operators take it from here)

BLOB = 2 << 20  # bytes of text that are worked on at once; a longer text is worked on alone

#: ASCII white space between words: 0x20 and 0x09-0x0D.
IS_GAP = np.zeros(256, bool)
IS_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII character but letters and digits.
NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def tune(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows at most: texts can be long."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def offsets(column: pa.Array) -> np.ndarray:
    """Where each text of a string or binary column begins and ends, whatever the width of its offsets."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return off[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _plain(column: pa.Array) -> pa.Array:
    """Views have no offsets: they become strings of wide offsets."""
    return column.cast(pa.large_binary()) if "view" in str(column.type) else column


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = BLOB) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each come to about ``most`` bytes."""
    for batch in batches:
        column = batch.column(text)
        if not batch.num_rows:
            continue
        size = np.diff(offsets(_plain(column)))
        part = np.cumsum(size) // most
        cut = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def blobs(batches: Iterator[pa.RecordBatch], mark: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(column 0, bytes of column 1's texts with ``mark`` after each, places of the marks). Null: empty."""
    for batch in slices(batches):
        data, ends = joined(batch.column(1), mark)
        yield batch.column(0), data, ends


def joined(column: pa.Array, mark: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(column)
    column = _plain(column)
    off = offsets(column)
    size = np.diff(off)
    if column.null_count:
        size[np.asarray(column.is_null())] = 0
    ends = np.cumsum(size + 1) - 1
    raw = column.buffers()[2]
    source = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    data = np.empty(int(size.sum()) + n, np.uint8)
    if n and not column.null_count or n and np.array_equal(np.diff(off), size):
        hole = np.zeros(len(data), bool)
        hole[ends] = True
        data[~hole] = source[off[0] : off[-1]]
        data[ends] = mark
        return data, ends
    at = 0
    for k in range(n):
        data[at : at + size[k]] = source[off[k] : off[k] + size[k]]
        data[at + size[k]] = mark
        at += size[k] + 1
    return data, ends


# -- fingerprints --------------------------------------------------------------------------
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
LONG = 64  # bytes from which on a word is hashed by itself


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i in range(n) at least."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[int(base)] = (both[0], both[1])
    return have


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits for the bytes of each word. Eight bytes at a time go through a mixing function, which is one to
    one in the bytes; words of LONG bytes and more are hashed by BLAKE2b. Two seeds give independent values."""
    size = end - start
    h = mix(size.astype(np.uint64), seed + 40)
    if not len(size):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    live, at = np.flatnonzero(size < LONG), 0
    while len(live):
        left = np.minimum(size[live] - at, 8).astype(np.uint64)
        part = eight[start[live] + at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        h[live] = mix((h[live] ^ part) * _STEP, seed + 40)
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size >= LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


class Words:
    """The words of a blob (texts with a gap byte after each): byte ranges, fingerprints, documents."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, lower: bool = False, gaps: np.ndarray = IS_GAP):
        if lower:
            data = LOWER[data]
        self.data = data
        gap = gaps[data]
        before = np.empty_like(gap)
        before[:1] = True
        before[1:] = gap[:-1]
        self.start = np.flatnonzero(before & ~gap)
        self.end = np.flatnonzero(gap & ~before)  # each text ends with a gap
        self.hash = word_hashes(data, self.start, self.end)
        begins = np.r_[0, ends[:-1] + 1] if len(ends) else np.zeros(0, np.int64)
        self.first = np.r_[np.searchsorted(self.start, begins), len(self.start)]  # of each document
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(ends)), self.count)

    def windows(self, k: int, double: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Fingerprint of the k words from each position on (those that run over a document's end mean nothing).
        The second one comes from words hashed another way, so both together have 128 bits."""
        return roll(self.hash, k, 0), roll(word_hashes(self.data, self.start, self.end, 1), k, 1) if double else None

    def fits(self, k: int) -> np.ndarray:
        """Whether k words from each position lie in one document."""
        return np.arange(len(self.hash)) + k <= self.first[1:][self.doc]

    def place(self) -> np.ndarray:
        return np.arange(len(self.hash)) - self.first[self.doc]


def roll(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Fingerprints of k neighbours by doubling: two halves, which overlap where k is no power of two, are mixed."""
    out, size = mix(h, seed + 50), 1
    while size < k:
        step = min(size, k - size)
        other = np.zeros_like(out)
        other[: max(0, len(out) - step)] = out[step:]
        out = mix(out * _STEP + other, seed + 50)
        size += step
    return out
