"""Substring deduplication with a sparse suffix array.

Of all suffixes those are retained that begin at a minimiser: in every passage of ``window`` words
the place with the smallest fingerprint of ``prefix`` words. Equal passages retain suffixes at equal
places, which agree in their first ``prefix`` words.

1. *Retain.* Suffixes are grouped by the fingerprint of their prefix; one whose prefix no other suffix
   has cannot lie in a repeated passage and goes. A task sends a prefix about once (``Seen``).
2. *Sort.* Each suffix that is left becomes a record: 128 bits of its prefix, the words after it up to ``window``
   words, and the words before it, nearest first. Words are there as they are, with a blank after each (words of
   ``LITERAL`` bytes and more by 128 bits in hex, which are as long as no word that is written out). Records are
   sorted by prefix, words after it, words before it, and place, by ranges that also split a prefix that very
   many texts share. Records that agree wholly with one the task knows, by 128 bits, are repeats and are not sent.
3. *Compare and extend.* Neighbours in that order share the longest prefixes. Their common
   length to the right and to the left, counted in whole words that agree byte by byte, gives the passages that the
   later of the two repeats; no other suffix agrees further to the right than a neighbour, so passages that
   reach beyond are unique.
4. *Rest.* A text that agrees further to the left need not be a neighbour. Passages that the
   neighbours leave open are looked up by a fingerprint of 128 bits: two of 64, of words hashed in two ways.
5. *Removal.* Spans are merged and cut, up to the next word that is kept; all else stays as it is.

Texts are shuffled once, by id; both looks at them reuse that exchange.

Defined results: null and empty texts have no words, and texts with fewer words than ``window`` lose
nothing; a text of any length is taken whole (one that exceeds a slice is a slice of its own); of equal
passages the one with the smallest (id, start) stays; equal rows (same id and text) count as one text and
each gets the same result; of different texts under one id each is cut at the places found for that id;
a row without id is returned as it is and is not compared; further columns are ignored unless carried,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetally.llm.common import Words, joined, mix, offsets, slices, tune, word_hashes
from pagetally.llm.passages import GAP, ROWS, Seen, anchors, asked, cut, ids_of, texts_of

PART = 1 << 16  # records that are made at once
LITERAL = 32  # bytes from which on a word is in a record by its digest
RECORD = "key bigint, more bigint, after binary, before binary, id bigint, at int, own bigint, sure bigint"
_STEP = np.uint64(0xD1342543DE82EF95)


def _retain(window: int, prefix: int, memory: int):
    """live = 0: a suffix to be compared; 1: one whose prefix the task knows to repeat."""

    def run(batches):
        seen = Seen(memory)
        for batch in slices(batches):
            ids, there = ids_of(batch.column(0))
            words = Words(*joined(batch.column(1), GAP))
            h, _ = words.windows(prefix)
            starts = np.flatnonzero(words.fits(window) & there[words.doc])
            chosen = np.unique(anchors(h, starts, window - prefix + 1))
            key, doc, at = h[chosen], ids[words.doc[chosen]], words.place()[chosen]
            send, again, _, _, tell_id, tell_at = seen.resolve(key, np.zeros(len(key), np.uint64), doc, at)
            live_id, live_at = np.r_[doc[again], tell_id], np.r_[at[again], tell_at]
            columns = [
                np.r_[key[send].view(np.int64), mix(live_id.astype(np.uint64), 2).view(np.int64)],
                np.r_[doc[send], live_id],
                np.r_[at[send], live_at].astype(np.int32),
                np.repeat(np.array([0, 1], np.int8), [len(send), len(live_id)]),
            ]
            yield pa.record_batch([pa.array(x) for x in columns], names=["key", "id", "at", "live"])

    return run


def _written(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(the words with a blank after each, where each begins)"""
    size = words.end - words.start
    length = np.minimum(size, LITERAL) + 1
    off = np.r_[0, np.cumsum(length)]
    data = words.data[np.repeat(words.start - off[:-1], length) + np.arange(off[-1])]  # each text ends with a gap
    data[off[1:] - 1] = GAP
    for i in np.flatnonzero(size >= LITERAL).tolist():
        digest = hashlib.blake2b(words.data[words.start[i] : words.end[i]], digest_size=LITERAL // 2).hexdigest()
        data[off[i] : off[i] + LITERAL] = np.frombuffer(digest.encode(), np.uint8)
    return data, off


def _backwards(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same words, the last one first."""
    length = np.diff(off)[::-1]
    back = np.r_[0, np.cumsum(length)]
    return data[np.repeat(off[:-1][::-1] - back[:-1], length) + np.arange(back[-1])], back


def _pieces(data: np.ndarray, start: np.ndarray, stop: np.ndarray, empty: int) -> pa.Array:
    """data[start:stop] of each pair, and so many empty ones."""
    size = stop - start
    out = np.r_[0, np.cumsum(size)]
    flat = data[np.repeat(start - out[:-1], size) + np.arange(out[-1])]
    ends = np.r_[out, np.full(empty, out[-1])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size) + empty, [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _chain(first: np.ndarray, words: np.ndarray, seed: int) -> np.ndarray:
    """(rows, words + 1) fingerprints of the first values, then with one more word, two, and so on."""
    h = np.empty((len(first), words.shape[1] + 1), np.uint64)
    h[:, 0] = mix(first, seed)
    for j in range(words.shape[1]):
        h[:, j + 1] = mix((h[:, j] ^ words[:, j]) * _STEP, seed)
    return h


def _records(window: int, prefix: int, memory: int):
    """One record for each live suffix. ``own``: bit a is set where the passage that begins a words before the
    suffix has it as its minimiser. Records that the task knows become rows (id, at, sure): so many passages from
    there on repeat for sure."""
    side = window - prefix

    def run(batches):
        seen = Seen(memory)
        for batch in slices(batches):
            rows = np.flatnonzero(np.asarray(batch.column(2).is_valid()))
            if not len(rows):
                continue
            batch = batch.take(pa.array(rows))
            ids, _ = ids_of(batch.column(0))
            words = Words(*joined(batch.column(1), GAP))
            held = batch.column(2)
            row = np.repeat(np.arange(len(rows)), held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            live = words.first[row] + held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            live = np.unique(live[live < words.first[row + 1]])
            h, h2 = words.windows(prefix, double=True)
            starts = np.flatnonzero(words.fits(window))
            anchor = anchors(h, starts, side + 1)
            own = np.zeros(len(words.hash), np.int64)
            np.bitwise_or.at(own, anchor, np.int64(1) << (anchor - starts))
            live = live[own[live] != 0]
            second = word_hashes(words.data, words.start, words.end, 1)
            hashes = [np.r_[x, np.uint64(0)] for x in (words.hash, second)]  # 0 where a text has no more words
            data, off = _written(words)
            back, back_off = _backwards(data, off)
            last = len(words.hash)
            for part in np.array_split(live, len(live) // PART + 1):
                doc, key, more, mine = words.doc[part], h[part], h2[part], own[part]
                stop = np.minimum(part + window, words.first[doc + 1])
                begin = np.maximum(part - side, words.first[doc])
                after = part[:, None] + prefix + np.arange(side)
                before = part[:, None] - 1 - np.arange(side)
                around = np.concatenate([np.where(after < stop[:, None], after, last), np.where(before >= begin[:, None], before, last)], 1)
                f1, f2 = (_chain(k, w[around], s)[:, -1] for k, w, s in ((key, hashes[0], 60), (more, hashes[1], 61)))
                number, at = ids[doc], words.place()[part]
                send, again, *_ = seen.resolve(f1, f2, number, at)
                row, a = np.nonzero((mine[again][:, None] >> np.arange(side + 1)) & 1)
                known = np.unique(part[again][row] - a)
                head = np.flatnonzero(np.r_[True, (known[1:] != known[:-1] + 1) | (words.doc[known[1:]] != words.doc[known[:-1]])]) if len(known) else known
                n = np.diff(np.r_[head, len(known)])
                known_id, known_at = ids[words.doc[known[head]]], words.place()[known[head]]
                sent = part[send]
                columns = [
                    pa.array(np.r_[key[send], mix(known_id.astype(np.uint64), 3) + mix(known_at.astype(np.uint64), 4)].view(np.int64)),
                    pa.array(np.r_[more[send].view(np.int64), np.zeros(len(n), np.int64)]),
                    _pieces(data, off[sent + prefix], off[stop[send]], len(n)),
                    _pieces(back, back_off[last - sent], back_off[last - begin[send]], len(n)),
                    pa.array(np.r_[number[send], known_id]),
                    pa.array(np.r_[at[send], known_at].astype(np.int32)),
                    pa.array(np.r_[mine[send], np.zeros(len(n), np.int64)]),
                    pa.array(np.r_[np.zeros(len(send), np.int64), n]),
                ]
                yield pa.record_batch(columns, names=["key", "more", "after", "before", "id", "at", "own", "sure"])

    return run


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each row, with zeros up to the longest one; sizes)"""
    off = offsets(column)
    size = np.diff(off)
    out = np.zeros((len(size), int(size.max(initial=0)) + 1), np.uint8)
    if off[-1] > off[0]:
        out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return out, size


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words from the first on that two rows have in common: blanks before the first byte that differs."""
    same = x == y
    common = np.where(same.all(1), x.shape[1], same.argmin(1))
    return ((x == GAP) & (np.arange(x.shape[1]) < common[:, None])).sum(1)


def _hashes(rows: np.ndarray, size: np.ndarray, side: int) -> list[np.ndarray]:
    """Two independent hashes of each row's words, a column for each word, 0 where there is none."""
    data = np.r_[rows[np.arange(rows.shape[1]) < size[:, None]], np.zeros(8, np.uint8)]
    blank = np.flatnonzero(data == GAP)
    begin = np.r_[0, blank[:-1] + 1] if len(blank) else blank
    stop = np.cumsum(size)
    row = np.searchsorted(stop, blank, side="right")
    place = np.arange(len(blank)) - np.searchsorted(row, row)
    out = []
    for seed in (0, 1):
        h = np.zeros((len(rows), side), np.uint64)
        h[row, place] = word_hashes(data, begin, blank, seed)
        out.append(h)
    return out


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bits low to high inclusive; none if low > high."""
    one = np.int64(1)
    return np.where(low <= high, (one << (np.maximum(high, 0) + 1)) - (one << np.minimum(low, 62)), 0)


def _neighbours(window: int, prefix: int, memory: int):
    """Records in suffix order -> rows for ``cut``."""
    side = window - prefix

    def work(seen, table: pa.Table, first: bool, last: bool):
        """All records but the first and the last, which are there as neighbours (unless an end is an end of the partition)."""
        table = table.combine_chunks()
        key, more = (table[c].to_numpy().astype(np.int64) for c in ("key", "more"))
        doc, at, own, known = (table[c].to_numpy().astype(np.int64) for c in ("id", "at", "own", "sure"))
        n = len(key)
        real = known == 0
        (after, after_size), (before, before_size) = (_rows(table[c].chunk(0) if n else pa.array([], pa.binary())) for c in ("after", "before"))
        same = real[1:] & real[:-1] & (key[1:] == key[:-1]) & (more[1:] == more[:-1])
        right, left = np.full(n - 1, -1), np.full(n - 1, -1)
        pick = np.flatnonzero(same)
        right[pick], left[pick] = _agree(after[pick + 1], after[pick]), _agree(before[pick + 1], before[pick])
        shared = np.where(same, _between(side - right, left), 0)
        later = (doc[1:] > doc[:-1]) | (doc[1:] == doc[:-1]) & (at[1:] > at[:-1])
        earlier = (doc[1:] < doc[:-1]) | (doc[1:] == doc[:-1]) & (at[1:] < at[:-1])
        sure = np.zeros(n, np.int64)
        sure[1:] |= np.where(later, shared, 0)
        sure[:-1] |= np.where(earlier, shared, 0)
        far = np.full(n, -1)  # how far to the right any other suffix agrees; unknown at the ends of a partition
        far[1:] = np.maximum(far[1:], right)
        far[:-1] = np.maximum(far[:-1], right)
        if first:
            far[0] = side
        if last:
            far[-1] = side
        use = np.arange(0 if first else 1, n if last else n - 1)
        sure = (sure & own)[use]
        ask = np.where(far >= 0, own & _between(side - far, np.full(n, side)), 0)[use] & ~sure
        ask[~real[use]] = 0
        bits = np.arange(side + 1)
        i, a = np.nonzero((sure[:, None] >> bits) & 1)
        told = use[~real[use]]
        row, step = np.repeat(told, known[told]), np.arange(known[told].sum()) - np.repeat(np.cumsum(known[told]) - known[told], known[told])
        sure_doc, sure_at = np.r_[doc[use][i], doc[row]], np.r_[at[use][i] - a, at[row] + step]
        i, a = np.nonzero((ask[:, None] >> bits) & 1)
        some, back = np.unique(use[i], return_inverse=True)
        ahead, behind = _hashes(after[some], after_size[some], side), _hashes(before[some], before_size[some], side)
        f = [_passages(k[some].view(np.uint64), ahead[s], behind[s], back, a, side, 62 + s) for s, k in enumerate((key, more))]
        return asked(seen, f[0], f[1], doc[use][i], at[use][i] - a, sure_doc, sure_at)

    def run(batches):
        seen = Seen(memory)
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows > 2:
                yield work(seen, held, first, False)
                first, held = False, held.slice(held.num_rows - 2)
        if held is not None:
            yield work(seen, held, first, True)

    return run


def _passages(key: np.ndarray, after: np.ndarray, before: np.ndarray, row: np.ndarray, a: np.ndarray, side: int, seed: int) -> np.ndarray:
    """Fingerprint of the passage that begins a words before a row's suffix, for parallel arrays row and a."""
    left, right = _chain(key, before, seed + 1), _chain(key, after, seed + 2)
    return mix(left[row, a] * np.uint64(0x9E3779B97F4A7C15) + right[row, side - a] + a.astype(np.uint64), seed)


def suffix_duplicates(docs: DataFrame, window: int = 50, prefix: int | None = None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, memory: int = 18) -> DataFrame:
    """(id_col, n_words, n_removed, spans, kept[, carried columns]): kept is the text without its spans.
    A task remembers 2 ** ``memory`` prefixes, records or passages; that bounds its memory and changes no result."""
    tune(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "20")  # records are wide
    carry = carry or []
    prefix = prefix or (window + 2) // 2
    if not 0 < window - prefix < 62:
        raise ValueError("the prefix must be shorter than the window, by less than 62 words")
    base = texts_of(docs, id_col, text_col, carry)
    suffixes = texts_of(docs, id_col, text_col).mapInArrow(_retain(window, prefix, memory), "key bigint, id bigint, at int, live tinyint")
    live = suffixes.select("id", "at", "live", F.count(F.lit(1)).over(Window.partitionBy("key")).alias("same")).where("live = 1 OR same > 1")
    marked = live.groupBy("id").agg(F.collect_list("at").alias("places"))
    records = base.join(marked, "id", "left").select("id", "text", "places").mapInArrow(_records(window, prefix, memory), RECORD)
    order = ["key", "more", "after", "before", "id", "at"]
    found = records.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(window, prefix, memory), ROWS)
    return cut(docs, base, found, window, True, id_col, carry)
