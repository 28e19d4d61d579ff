"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is its own reference. Every passage of ``window`` words chooses one of its blocks of ``block``
words as a reference block: where its smallest run of a few words stands, modulo the number of its blocks
(mod-sampling, which takes fewer blocks than the smallest block itself would). Because the choice depends on the
passage's words only, equal passages hold equal blocks at equal places. Blocks begin at most
``window - block + 1`` words apart, which is no more than their length, so the blocks inside a passage cover
it without gaps.

1. *Index.* Every block of every text is indexed with its place (id, word). Each gets a pointer to
   the earliest place of its words in the corpus; where a task already knows an earlier place of the
   same words, that is the pointer (``Seen``), so a block that a third of all texts share is sent
   about once by each task.
2. *Parse.* A text is factored greedily from left to right: a factor begins at the next block with a
   pointer and goes on while the blocks' pointers move through one reference text at the same pace,
   so it is a copy of the words there. Factors of ``window`` words and more are duplicate spans. (They
   have two blocks at least, so 128 bits of fingerprint agree.)
3. *Factor boundaries.* A pointer follows one reference at a time, and a passage over a factor's
   boundary may occur in a third text. Each passage whose block repeats and that no factor contains
   is therefore looked up by its own 128-bit fingerprint. The earliest place of a passage is never
   inside a factor (it would be a copy of an earlier one), so it is always among those.
4. *Removal.* Duplicate spans of a text are merged and cut.

Texts are shuffled once, by id; both looks at them reuse that exchange.

Defined results: null and empty texts have no words, and texts with fewer words than ``window`` lose
nothing; a text of any length is taken whole (one that exceeds a slice is a slice of its own); of equal
passages the one with the smallest (id, start) stays; equal rows (same id and text) count as one text and
each gets the same result; of different texts under one id each is cut at the places found for that id;
a row without id is returned as it is and is not compared; further columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetally.llm.common import Words, joined, mix, slices, tune
from pagetally.llm.passages import GAP, ROWS, Seen, anchors, asked, cut, ids_of, texts_of


def _blocks(words: Words, starts: np.ndarray, window: int, block: int) -> np.ndarray:
    """The place of each passage's reference block."""
    choices = window - block + 1
    run = 1 + (block - 1) % choices  # as long as a block, less a multiple of the number of choices
    h, _ = words.windows(run)
    return starts + (anchors(h, starts, window - run + 1) - starts) % choices


def _chain(row: np.ndarray, at: np.ndarray, source: np.ndarray, there: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each factor's first block, words of the factor) of blocks ordered by row and place."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = at[1:] - at[:-1]
    goes_on = (row[1:] == row[:-1]) & (source[1:] == source[:-1]) & (there[1:] - there[:-1] == step) & (step <= block)
    begin = np.flatnonzero(np.r_[True, ~goes_on])
    last = np.r_[begin[1:], len(row)] - 1
    return begin, at[last] + block - at[begin]


def _index(window: int, block: int, memory: int):
    """n = 0: a block to be pointed; n > 0: a factor within what the task knows; n < 0: -n words known to repeat."""

    def run(batches):
        seen = Seen(memory)
        for batch in slices(batches):
            ids, there = ids_of(batch.column(0))
            words = Words(*joined(batch.column(1), GAP))
            h, _ = words.windows(block)
            starts = np.flatnonzero(words.fits(window) & there[words.doc])
            chosen = np.unique(_blocks(words, starts, window, block))
            key, doc, at = h[chosen], ids[words.doc[chosen]], words.place()[chosen]
            send, again, source, place, tell_id, tell_at = seen.resolve(key, np.zeros(len(key), np.uint64), doc, at)
            order = np.argsort(chosen[again], kind="stable")
            again, source, place = again[order], source[order], place[order]
            begin, length = _chain(words.doc[chosen[again]], at[again], source, place, block)
            f_id, f_at = doc[again[begin]], at[again[begin]]
            named = lambda d: mix(d.astype(np.uint64), 2).view(np.int64)
            columns = [
                np.r_[key[send].view(np.int64), named(f_id), named(tell_id)],
                np.r_[doc[send], f_id, tell_id],
                np.r_[at[send], f_at, tell_at].astype(np.int32),
                np.r_[np.zeros(len(send), np.int64), length, np.full(len(tell_id), -block)].astype(np.int32),
            ]
            yield pa.record_batch([pa.array(x) for x in columns], names=["key", "id", "at", "n"])

    return run


def _ranges(size: int, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges."""
    change = np.zeros(size + 1, np.int64)
    ok = stop > begin
    np.add.at(change, begin[ok], 1)
    np.add.at(change, stop[ok], -1)
    return np.cumsum(change)[:size] > 0


def _parse(window: int, block: int, memory: int):
    def run(batches):
        seen = Seen(memory)
        for batch in slices(batches):
            rows = np.flatnonzero(np.asarray(batch.column(2).is_valid()))
            if not len(rows):
                continue
            batch = batch.take(pa.array(rows))
            own, _ = ids_of(batch.column(0))
            words = Words(*joined(batch.column(1), GAP))
            held = batch.column(2)
            row = np.repeat(np.arange(len(rows)), held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat = held.flatten()
            at, n, there = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n", "there"))
            source, pointed = ids_of(flat.field("source"))
            begin = np.minimum(words.first[row] + at, words.first[row + 1])
            size = len(words.hash)
            limit = words.first[row + 1]
            # blocks that repeat begin in these ranges
            repeats = _ranges(size, begin, np.minimum(begin + np.where(n == 0, 1, np.abs(n) - block + 1), limit))
            pick = np.flatnonzero((n == 0) & pointed)
            pick = pick[np.lexsort((at[pick], row[pick]))]
            head, length = _chain(row[pick], at[pick], source[pick], there[pick], block)
            f_row, f_begin = row[pick[head]], begin[pick[head]]
            near = n > 0
            f_row, f_begin, length = np.r_[f_row, row[near]], np.r_[f_begin, begin[near]], np.r_[length, n[near]]
            sure = _ranges(size, f_begin, np.minimum(f_begin + length - window + 1, words.first[f_row + 1] - window + 1))
            starts = np.flatnonzero(words.fits(window))
            open_ = starts[repeats[_blocks(words, starts, window, block)] & ~sure[starts]]
            f1, f2 = words.windows(window, double=True)
            place = words.place()
            known = np.flatnonzero(sure)
            yield asked(seen, f1[open_], f2[open_], own[words.doc[open_]], place[open_], own[words.doc[known]], place[known])

    return run


def factor_duplicates(docs: DataFrame, window: int = 20, block: int | None = None, id_col: str = "doc_id", text_col: str = "text", memory: int = 19) -> DataFrame:
    """(id_col, n_words, n_removed, spans, kept): kept words are joined by one blank.
    A task remembers 2 ** ``memory`` blocks or passages; that bounds its memory and changes no result."""
    tune(docs.sparkSession)
    block = block or (window + 2) // 2
    if not (window + 1) / 2 <= block < window:
        raise ValueError("blocks must be at least half as long as the window and shorter than it")
    base = texts_of(docs, id_col, text_col)
    blocks = base.mapInArrow(_index(window, block, memory), "key bigint, id bigint, at int, n int")
    same = Window.partitionBy("key")
    place = F.struct("id", "at")
    pointed = blocks.select("id", "at", "n", F.count(F.lit(1)).over(same).alias("same"), F.min(place).over(same).alias("first")).where("n <> 0 OR same > 1")
    pointer = F.when((F.col("n") == 0) & (F.col("first") < place), F.col("first"))
    entries = pointed.groupBy("id").agg(F.collect_list(F.struct("at", "n", pointer["id"].alias("source"), F.coalesce(pointer["at"], F.lit(0)).alias("there"))).alias("entries"))
    found = base.join(entries, "id", "left").select("id", "text", "entries").mapInArrow(_parse(window, block, memory), ROWS)
    return cut(docs, base, found, window, False, id_col, [])
