"""What the two substring deduplications share: places, a bounded memory of repeats, the exact check of
single passages, and the cutting of spans. How repeats are found is theirs (``factors``, ``suffixes``).

A passage is ``window`` consecutive words of one text. A word goes if a passage that covers it also
starts at an earlier place (smaller id, or same text and earlier start); passages are judged on the input.

Rows handed to ``cut`` are (a, b, id, at, n): n > 0 says that n passages from word ``at`` of text ``id`` on
repeat for sure; n = 0 asks whether the passage there, with the 128-bit fingerprint (a, b), does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetally.llm.common import Words, joined, mix, slices

GAP = 0x20
ROWS = "a bigint, b bigint, id bigint, at int, n int"


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, whether there is one)"""
    there = np.asarray(column.is_valid())
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), there


def anchors(h: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each start the (leftmost) place of the smallest of ``width`` values from there on."""
    at = np.empty(len(starts), np.int64)
    if len(starts):
        view = np.lib.stride_tricks.sliding_window_view(h, width)
        for a in range(0, len(starts), 1 << 18):
            part = starts[a : a + (1 << 18)]
            at[a : a + len(part)] = part + view[part].argmin(1)
    return at


class Seen:
    """A task's memory of keys: a table of fixed size, in which a newer key takes an older one's slot.

    Of the occurrences of a key only the earliest place known to the task has to be compared with other
    tasks; later ones are repeats for sure. A key that every text holds so leaves a task about once."""

    def __init__(self, bits: int):
        self.bits = bits
        self.key = np.zeros(1 << bits, np.uint64)
        self.check = np.zeros(1 << bits, np.uint64)
        self.id = np.zeros(1 << bits, np.int64)
        self.at = np.full(1 << bits, -1, np.int64)  # -1: empty
        self.told = np.zeros(1 << bits, bool)

    def resolve(self, key: np.ndarray, check: np.ndarray, doc: np.ndarray, at: np.ndarray):
        """(indices to compare with other tasks; indices that repeat, with an earlier place (id, at) of each;
        places (id, at) that were handed out before and now are known to repeat)."""
        order = np.lexsort((at, doc, check, key))
        if not len(order):
            none = np.zeros(0, np.int64)
            return order, order, none, none, none, none
        k, c, d, p = key[order], check[order], doc[order], at[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        slot = (k[head] >> np.uint64(64 - self.bits)).astype(np.int64)
        known = (self.at[slot] >= 0) & (self.key[slot] == k[head]) & (self.check[slot] == c[head])
        there, since = self.id[slot], self.at[slot]
        earlier = known & ((there < d[head]) | (there == d[head]) & (since < p[head]))
        equal = known & (there == d[head]) & (since == p[head])
        first_id, first_at = np.where(earlier, there, d[head]), np.where(earlier, since, p[head])
        later = (d > first_id[group]) | (d == first_id[group]) & (p > first_at[group])
        found = np.flatnonzero(later)
        repeats = np.zeros(len(head), bool)
        repeats[group[found]] = True
        told = known & (earlier | equal) & self.told[slot]
        tell = np.flatnonzero(repeats & ~told)
        send = order[head[~earlier & ~equal]]
        tid, tat = first_id[tell], first_at[tell]
        self.key[slot], self.check[slot], self.id[slot], self.at[slot] = k[head], c[head], first_id, first_at
        self.told[slot] = told | repeats
        return send, order[found], first_id[group[found]], first_at[group[found]], tid, tat


def asked(seen: Seen, f1: np.ndarray, f2: np.ndarray, doc: np.ndarray, at: np.ndarray, sure_doc: np.ndarray, sure_at: np.ndarray) -> pa.RecordBatch:
    """Rows for ``cut``: passages to look up, and single passages that repeat for sure (their starts)."""
    send, again, *_ = seen.resolve(f1, f2, doc, at)
    d, p = np.r_[sure_doc, doc[again]], np.r_[sure_at, at[again]]
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    if len(d):
        one = np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1])]
        d, p = d[one], p[one]
    begin = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)]) if len(d) else np.zeros(0, np.int64)
    n = np.diff(np.r_[begin, len(d)])
    a = np.r_[f1[send].view(np.int64), mix(d[begin].astype(np.uint64), 1).view(np.int64)]
    b = np.r_[f2[send].view(np.int64), p[begin]]
    columns = [a, b, np.r_[doc[send], d[begin]], np.r_[at[send], p[begin]].astype(np.int32), np.r_[np.zeros(len(send), np.int64), n].astype(np.int32)]
    return pa.record_batch([pa.array(x) for x in columns], names=["a", "b", "id", "at", "n"])


def _cut(window: int, keep_layout: bool, extra: int):
    def run(batches):
        for batch in slices(batches):
            data, ends = joined(batch.column(1), GAP)
            words = Words(data, ends)
            cover = np.zeros(len(words.hash) + 1, np.int64)
            held = batch.column(2)
            if len(held) > held.null_count:
                parent = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
                flat = held.values.slice(held.offsets[0].as_py(), held.offsets[-1].as_py() - held.offsets[0].as_py())
                at = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
                n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                begin = np.minimum(words.first[parent] + at, words.first[parent + 1])
                stop = np.minimum(begin + np.maximum(n, 1) + window - 1, words.first[parent + 1])
                np.add.at(cover, begin, 1)
                np.add.at(cover, stop, -1)
            gone = np.cumsum(cover)[:-1] > 0
            doc = words.doc
            removed = np.bincount(doc[gone], minlength=batch.num_rows)
            # spans of removed words
            edge = np.flatnonzero(gone & np.r_[True, ~gone[:-1] | (doc[1:] != doc[:-1])]) if len(gone) else np.zeros(0, np.int64)
            stop = np.flatnonzero(gone & np.r_[~gone[1:] | (doc[1:] != doc[:-1]), True]) + 1 if len(gone) else np.zeros(0, np.int64)
            spans = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(np.bincount(doc[edge], minlength=batch.num_rows))].astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(edge - words.first[doc[edge]]), pa.array(stop - words.first[doc[edge]])], names=["start", "stop"]),
            )
            out = data.copy()
            mask = np.zeros(len(data) + 1, np.int8)
            if keep_layout:  # the text without its removed spans, up to the next kept word
                begins = np.r_[0, ends[:-1] + 1]
                mask[begins] += 1
                mask[ends] -= 1
                upto = np.where(stop < words.first[doc[edge] + 1], words.start[np.minimum(stop, len(words.start) - 1)], ends[doc[edge]]) if len(edge) else edge
                np.add.at(mask, words.start[edge], -1)
                np.add.at(mask, upto, 1)
            else:  # kept words with a blank after each
                kept = ~gone
                mask[words.start[kept]] += 1
                mask[words.end[kept] + 1] -= 1
                out[words.end] = GAP
            on = np.cumsum(mask[:-1].astype(np.int64)) > 0
            total = np.r_[0, np.cumsum(on)]
            lo, hi = total[np.r_[0, ends[:-1] + 1]], total[ends + 1]
            text = out[on]
            if keep_layout:
                kept_text = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(np.append(lo, hi[-1]).astype(np.int32)), pa.py_buffer(text)])
                if batch.column(1).null_count:
                    kept_text = pa.array([k if v else None for k, v in zip(kept_text.to_pylist(), np.asarray(batch.column(1).is_valid()), strict=True)], pa.string())
            else:
                raw = text.tobytes()
                kept_text = pa.array([raw[x : max(x, y - 1)].decode() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.string())
            more = [batch.column(3 + k) for k in range(extra)]
            yield pa.record_batch([batch.column(0), pa.array(words.count), pa.array(removed), spans, kept_text, *more], names=["id", "n_words", "n_removed", "spans", "kept"] + [f"x{k}" for k in range(extra)])

    return run


def texts_of(docs: DataFrame, id_col: str, text_col: str, carry: list[str] = ()) -> DataFrame:
    """(id, text, x0, x1, ...), all names internal, so that no column of the input can clash."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"x{k}") for k, c in enumerate(carry)])


def cut(docs: DataFrame, base: DataFrame, found: DataFrame, window: int, keep_layout: bool, id_col: str, carry: list[str]) -> DataFrame:
    """(id_col, n_words, n_removed, spans, kept, carried columns) for each row of ``base`` (``texts_of`` docs).
    ``found`` are rows as above; passages that are asked for are compared by their fingerprints."""
    place = F.struct("id", "at")
    first = F.min(place).over(Window.partitionBy("a", "b"))  # at most about a row for each task and key: see Seen
    repeats = found.select("id", "at", "n", first.alias("first")).where((F.col("n") > 0) | (F.col("first") < place))
    spans = repeats.groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    more = [f"x{k}" for k in range(len(carry))]
    schema = "id bigint, n_words bigint, n_removed bigint, spans array<struct<start: bigint, stop: bigint>>, kept string" + "".join(f", x{k} {types[c]}" for k, c in enumerate(carry))
    out = base.join(spans, "id", "left").select("id", "text", "found", *more).mapInArrow(_cut(window, keep_layout, len(carry)), schema)
    return out.select(F.col("id").cast(types[id_col]).alias(id_col), "n_words", "n_removed", "spans", "kept", *[F.col(f"x{k}").alias(c) for k, c in enumerate(carry)])
