"""Packing token sequences by minimum bin slack.

Every document is tokenised, closed with id 0 and cut at whole windows of ``capacity`` ids; what
remains of each goes into a pool. A window is then filled from the pool: it takes the longest
remainder, and a bitset of reachable sums over the pool's multiset of lengths (each length with
its count, in powers of two) finds the total closest to the capacity; walking back through the
bitsets gives how many of each length to take. A multiset that fits is used as often as the counts
allow. If the pool's last pieces leave slack, the longest remaining piece is cut to fill it, and
what is left at the end is laid out in sequences whose lengths are powers of two, which need no
padding.

Each partition packs what it reads: there is no shuffle, the pool is bounded, and a lost task is
redone alone. ``sequence_id`` holds the partition in its upper bits.

Defined results: a null or empty text is the single id 0; a document with several pieces has one
row for each, and one of any length as many as it takes; repeated rows, and rows without id, are packed as often as
they occur; of remainders of one length the last to come is taken first (which of them goes into a window is no
promise: it depends on how rows are dealt); no rows give no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import blobs, tune
from pagetally.llm.tokens import SEPARATOR, compile_tokenizer, packed_classes

POOL = 4096  # remainders held before windows are filled


def least_slack(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths and how many of each: the longest, and what makes the total closest to the capacity."""
    lengths = sorted((n for n, c in counts.items() if c > 0 and n <= capacity), reverse=True)
    chosen = {lengths[0]: 1}
    room = capacity - lengths[0]
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        left = min(counts[n] - (n == lengths[0]), room // n)
        share = 1
        while left > 0:
            k = min(share, left)
            wider = (reach | reach << (n * k)) & mask
            if wider != reach:
                steps.append((reach, n, k))
                reach = wider
            left -= k
            share *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for before, n, k in reversed(steps):
        if not before >> total & 1:
            chosen[n] = chosen.get(n, 0) + k
            total -= n * k
    return chosen


class Packer:
    """Pieces are (document, its tokens, start, ids)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.pool: dict[int, list] = defaultdict(list)
        self.size = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.capacity
        for a in range(0, whole, self.capacity):
            self._close([(doc, n, a, ids[a : a + self.capacity])])
        if whole < n:
            self._keep((doc, n, whole, ids[whole:].copy()))

    def _keep(self, piece) -> None:
        self.pool[len(piece[3])].append(piece)
        self.size += 1

    def _take(self, n: int):
        of = self.pool[n]
        piece = of.pop()
        if not of:
            del self.pool[n]
        self.size -= 1
        return piece

    def _close(self, pieces: list) -> None:
        at = 0
        for doc, n, start, ids in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids), n, self.next_id, at, ids))
            at += len(ids)
        self.next_id += 1

    def _head(self, piece, n: int):
        """The piece's first n ids; the rest goes back to the pool."""
        doc, total, start, ids = piece
        if n < len(ids):
            self._keep((doc, total, start + n, ids[n:]))
        return doc, total, start, ids[:n]

    def fill(self, down_to: int) -> None:
        while self.size > down_to:
            counts = {n: len(x) for n, x in self.pool.items()}
            if sum(n * c for n, c in counts.items()) < self.capacity:
                break
            chosen = least_slack(counts, self.capacity)
            times = min(counts[n] // k for n, k in chosen.items())
            for _ in range(max(1, times)):
                pieces = [self._take(n) for n, k in chosen.items() for _ in range(k)]
                slack = self.capacity - sum(len(p[3]) for p in pieces)
                while slack and self.size:
                    piece = self._head(self._take(max(self.pool)), slack)
                    pieces.append(piece)
                    slack -= len(piece[3])
                self._close(pieces)
                if any(len(self.pool.get(n, ())) < k for n, k in chosen.items()):
                    break

    def finish(self) -> None:
        self.fill(0)
        left = sum(n * len(x) for n, x in self.pool.items())
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                piece = self._head(self._take(max(self.pool)), room)
                pieces.append(piece)
                room -= len(piece[3])
            self._close(pieces)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, pool: int = POOL) -> DataFrame:
    """One row for each piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])."""
    kind = docs.schema[id_col].dataType.simpleString()
    tune(docs.sparkSession)
    classes = packed_classes(tokenizer_path)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        machine = compile_tokenizer(tokenizer_path, classes)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        def out(id_type):
            rows, packer.rows = packer.rows, []
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
            return pa.record_batch(arrays, names=names + ["ids"] * with_ids)

        id_type = pa.int64()
        for ids, data, ends in blobs(batches, SEPARATOR):
            id_type = ids.type
            tokens, upto = machine.encode(data, ends)
            begin = 0
            for doc, end in zip(ids.to_pylist(), upto.tolist(), strict=True):
                packer.add(doc, tokens[begin:end])
                begin = end
            if packer.size > 2 * pool:
                packer.fill(pool)
            yield out(id_type)
        packer.finish()
        yield out(id_type)

    schema = f"{id_col} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
