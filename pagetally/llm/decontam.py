"""Benchmark decontamination: rare word and n-gram seeds, then Smith-Waterman alignment.

A text copies an item of m words if the best local alignment of their words (match 2, mismatch and
gap -1) matches at least ``identity`` of the m words. Such an alignment misses (1 - identity) * m
of the item's words at most, so one of the rarest floor((1 - identity) * m) + 1 must occur in the
text, whatever was changed, left out or inserted: these are the seeds, rarity being counted over
all training texts. The alignment has fewer than 3 m words of the text, so a text that holds a seed
is a candidate where, within 3 m words of it, words of the item occur that make up ``identity`` of
its length; there the words are aligned, unless the whole item stands there word for word.

A text also copies an item if it holds an excerpt: an alignment with ``excerpt`` matched words or
more, at least ``identity`` of whose columns match. Between its changes enough of the item's n-grams
survive close together, near one diagonal (the q-gram lemma); where they do, alignments of each number of changes
are tried. The score is always the share of the item's words that the best alignment matches, so an
excerpt can have a score below ``identity``.

The items' index is broadcast in blocks of at most ``limit`` bytes, each with its own pass over the
texts; texts are never shuffled, and a text that a third of the corpus shares costs each row the
same.

Defined results: words are runs of ASCII letters and digits and of all non-ASCII characters, compared with
A-Z lower-cased; a null or empty text, or an item without words, matches nothing; an item with
fewer than n words matches a text that has just these words; a text of any length is taken whole, and a long item
too; of equally good alignments the one that ends first in the item, then in the text, counts; equal items each get their rows, as do equal texts; rows
without id are compared like others; further columns are ignored; no texts or no items give an
empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import NO_WORD, Words, joined, slices, tune

GAP = 0x20
BITS = 20
PAIRS = 1 << 20  # hits that are looked at together
PART = 1 << 16  # words of a text in which an excerpt is looked for at once, at least


class Items:
    """Words and n-grams of a block of test items."""

    def __init__(self, ids: list, texts: list[str | None], n: int, identity: float, excerpt: int):
        words = Words(*joined(pa.array(texts, pa.string()), GAP), lower=True, gaps=NO_WORD)
        grams, _ = words.windows(n)
        fit = words.fits(n)
        self.n, self.identity, self.ids = n, identity, ids
        self.words, self.first = words.hash, words.first
        self.length = words.count
        self.need = np.ceil(identity * self.length - 1e-9).astype(np.int64)  # words that an alignment matches
        self.excerpt, self.changes, self.most = excerpt, *allowed(excerpt, identity)
        self.grams_left = max(1, excerpt - (n - 1) * (self.changes + 1))
        at = np.flatnonzero(fit)
        self.grams, inverse = np.unique(grams[at], return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        self.offset = words.place()[at][order]
        item, gram = words.doc[at][order], inverse[order]
        new = np.flatnonzero(np.r_[np.ones(min(1, len(gram)), bool), (gram[1:] != gram[:-1]) | (item[1:] != item[:-1])])
        # an item's places of one gram are together: pair p has offset[pair_first[p] : pair_first[p + 1]]
        self.pair_item, self.pair_first = item[new], np.r_[new, len(gram)]
        self.gram_pairs = np.searchsorted(gram[new], np.arange(len(self.grams) + 1))
        self.map = _map(self.grams)
        long = self.length >= n
        place = np.flatnonzero(long[words.doc])
        self.terms, self.term = np.unique(words.hash[place], return_inverse=True)  # the items' words
        self.owner = words.doc[place]
        self.term_map = _map(self.terms)
        # each item's distinct words and how often it has them, ordered by item and word
        self.pairs, self.times = np.unique(self.owner * len(self.terms) + self.term, return_counts=True)
        self.short = defaultdict(list)  # items below n words, by their words
        for q in np.flatnonzero((self.length > 0) & ~long).tolist():
            self.short[tuple(words.hash[words.first[q] : words.first[q + 1]].tolist())].append(q)
        self.seed_item, self.seed_posting = np.zeros(0, np.int64), np.zeros(len(self.terms) + 1, np.int64)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, grams found there)"""
        return _look_up(h, self.grams, self.map)

    def choose_seeds(self, frequency: np.ndarray) -> None:
        """Of each item's words the rarest that one of must be matched."""
        order = np.lexsort((self.term, frequency[self.term], self.owner))
        item, term = self.owner[order], self.term[order]
        rank = np.arange(len(order)) - np.searchsorted(item, item)
        seed = np.unique((term * len(self.length) + item)[rank <= (self.length - self.need)[item]])
        self.seed_item = seed % max(1, len(self.length))
        self.seed_posting = np.searchsorted(seed // max(1, len(self.length)), np.arange(len(self.terms) + 1))
        self.term = self.owner = np.zeros(0, np.int64)  # not needed any more


def _map(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS, bool)
    out[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return out


def _look_up(h: np.ndarray, keys: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.flatnonzero(some[(h >> np.uint64(64 - BITS)).astype(np.int64)])
    g = np.minimum(np.searchsorted(keys, h[near]), len(keys) - 1)
    ok = keys[g] == h[near]
    return near[ok], g[ok]


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the ranges of ``count`` values from ``first`` on."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def allowed(excerpt: int, identity: float) -> tuple[int, int]:
    """Changes among ``excerpt`` matched words; changes up to which longer excerpts are to be tried, because
    those with more hold ``excerpt`` matched words in a row with no more changes than the first number."""
    rate = (1 - identity) / identity
    few = math.floor(excerpt * rate + 1e-9)
    parts = math.floor((excerpt - 1) * rate / (few + 1 - excerpt * rate) + 1e-9) + 1
    return few, max(few, math.floor((excerpt * parts - 1) * rate + 1e-9))


def has_excerpt(item: np.ndarray, text: np.ndarray, excerpt: int, identity: float) -> bool:
    """Whether an alignment has ``excerpt`` matches or more, and ``identity`` of its columns match."""
    most = allowed(excerpt, identity)[1]
    reach = len(item) + most + 1  # words of the text that an excerpt spans at most
    part = max(PART, 4 * reach)
    return any(_has_excerpt(item, text[a : a + part + reach], excerpt, identity, most) for a in range(0, max(1, len(text)), part))


def _has_excerpt(item: np.ndarray, text: np.ndarray, excerpt: int, identity: float, most: int) -> bool:
    enough = np.maximum(excerpt, np.ceil(np.arange(most + 1) * identity / max(1 - identity, 1e-12) - 1e-9))
    row = np.zeros((most + 1, len(text) + 1), np.int64)  # most matches with so many changes at most
    for word in item:
        new = np.zeros_like(row)
        new[:, 1:] = np.where(text == word, row[:, :-1] + 1, 0)
        for e in range(1, most + 1):
            np.maximum(new[e], row[e - 1], out=new[e])
            np.maximum(new[e, 1:], row[e - 1, :-1], out=new[e, 1:])
            np.maximum(new[e, 1:], new[e - 1, :-1], out=new[e, 1:])
        row = new
        if (row.max(1) >= enough).any():
            return True
    return False


def occurrence(item: np.ndarray, text: np.ndarray) -> int | None:
    """Where the text first has the whole item, word for word."""
    if not len(item) or len(item) > len(text):
        return None
    width = item.dtype.itemsize
    words, all_words = item.tobytes(), text.astype(item.dtype, copy=False).tobytes()
    at = all_words.find(words)
    while at >= 0 and at % width:
        at = all_words.find(words, at + 1)
    return at // width if at >= 0 else None


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(matched words, start, stop in text) of the best local alignment; match 2, mismatch and gap -1."""
    unit = 1 << 20
    m, w = len(item), len(text)
    whole = occurrence(item, text)
    if whole is not None:
        return m, whole, whole + m
    row = np.zeros(w + 1, np.int64)  # score * unit + matches
    begin = np.arange(w + 1)
    step = np.arange(w + 1) * unit
    best, at = 0, (0, 0)
    for i in range(m):
        diagonal = row[:-1] + np.where(text == item[i], 2 * unit + 1, -unit)
        up = row[1:] - unit
        here = np.maximum(np.maximum(diagonal, up), 0)
        source = np.where(diagonal >= up, begin[:-1], begin[1:])
        here, source = np.r_[0, here], np.r_[0, source]
        fresh = here == 0
        source[fresh] = np.arange(w + 1)[fresh]
        reached = np.maximum.accumulate(here + step)  # gaps along the text
        came = np.maximum.accumulate(np.where(here + step == reached, np.arange(w + 1), 0))
        new = np.maximum(reached - step, 0)
        source = np.where(new == here, source, source[came])
        source[new == 0] = np.arange(w + 1)[new == 0]
        row, begin = new, source
        j = int(row.argmax())
        if row[j] > best:
            best, at = int(row[j]), (int(begin[j]), j)
    return best & (unit - 1), *at


def _copies(index: Items, words: Words) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(text, item) -> windows of words that may match ``identity`` of the item's words."""
    at, term = _look_up(words.hash, index.terms, index.term_map)
    out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    if not len(at):
        return out
    row, post = _expand(index.seed_posting[term], np.diff(index.seed_posting)[term])
    item = index.seed_item[post]
    place, text = at[row], words.doc[at][row]
    order = np.lexsort((place, item, text))
    place, item, text = place[order], item[order], text[order]
    reach = 3 * index.length[item]
    a, b = np.maximum(words.first[text], place - reach), np.minimum(words.first[text + 1], place + reach + 1)
    fresh = np.r_[True, (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (a[1:] > b[:-1])] if len(a) else np.zeros(0, bool)
    begin = np.flatnonzero(fresh)  # windows that overlap are one
    a, b, item, text = a[begin], b[np.r_[begin[1:], len(b)] - 1] if len(b) else b, item[begin], text[begin]
    low, high = np.searchsorted(at, a), np.searchsorted(at, b)
    ends = np.cumsum(high - low)
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(ends // (1 << 20))) + 1):
        window, k = _expand(low[part], (high - low)[part])
        key = item[part][window] * len(index.terms) + term[k]
        hit = np.minimum(np.searchsorted(index.pairs, key), len(index.pairs) - 1)
        ok = index.pairs[hit] == key
        seen = np.unique(window[ok] * len(index.pairs) + hit[ok])  # each of the item's words once for a window
        have = np.bincount(seen // len(index.pairs), weights=index.times[seen % len(index.pairs)], minlength=len(part))
        for i in part[have >= index.need[item[part]]].tolist():
            first = int(words.first[text[i]])
            out[int(text[i]), int(item[i])].append((int(a[i]) - first, int(b[i]) - first))
    return out


def _excerpts(index: Items, words: Words) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(text, item) -> windows of words that may hold an excerpt of the item.

    An excerpt leaves ``grams_left`` n-grams of its item within few words of the text. Such places are found by
    counting, a gram once for an item however often the item has it, in parts of about ``PAIRS`` hits; so memory
    does not grow with the product of what a word repeats in the text and in the item."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    h, _ = words.windows(index.n)
    at, gram = index.look_up(h)
    fit = words.fits(index.n)[at]
    at, gram = at[fit], gram[fit]
    total = np.cumsum(np.diff(index.gram_pairs)[gram])
    begin = 0
    while begin < len(at):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, side="right")))
        far = int(np.searchsorted(at, at[stop - 1] + index.excerpt + index.changes - index.n, side="right"))
        _dense(index, words, at[begin:far], gram[begin:far], int(at[stop - 1]), out)
        begin = stop
    for key, spans in out.items():
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out[key] = merged
    return out


def _dense(index: Items, words: Words, at: np.ndarray, gram: np.ndarray, upto: int, out: dict) -> None:
    """Windows around hits (places and their grams), of which those up to place ``upto`` begin an excerpt."""
    row, pair = _expand(index.gram_pairs[gram], np.diff(index.gram_pairs)[gram])
    place, item, text = at[row], index.pair_item[pair], words.doc[at[row]]
    order = np.lexsort((place, item, text))
    place, item, text, pair = place[order], item[order], text[order], pair[order]
    last = np.arange(len(text)) + index.grams_left - 1
    inside = (last < len(text)) & (place <= upto)
    last = np.minimum(last, max(0, len(text) - 1))
    near = index.excerpt + index.changes - index.n
    ok = np.flatnonzero(inside & (text[last] == text) & (item[last] == item) & (place[last] - place <= near))
    if not len(ok):
        return
    new = np.flatnonzero(np.r_[True, ok[1:] > last[ok[:-1]] + 1])
    for lo, hi in zip(ok[new].tolist(), last[ok[np.r_[new[1:] - 1, len(ok) - 1]]].tolist(), strict=True):
        for t, q, i, j in _groups(text, item, lo, hi + 1):
            first, most = int(words.first[t]), int(index.most)
            held = pair[i:j]
            times = index.pair_first[held + 1] - index.pair_first[held]
            if int(times.sum()) > PAIRS:  # the item repeats these grams: all of it may lie anywhere here
                reach = int(index.length[q]) + most
                spans = [(int(place[i]) - first - reach, int(place[j - 1]) - first + index.n + reach)]
            else:
                hit, k = _expand(index.pair_first[held], times)
                diagonal = np.sort(place[i:j][hit] - first - index.offset[k])
                far = np.arange(index.grams_left - 1, len(diagonal))
                begin = np.flatnonzero(diagonal[far] - diagonal[: len(far)] <= 2 * (index.changes + 1))
                spans = [(int(diagonal[x]) - most, int(diagonal[y]) + int(index.length[q]) + most) for x, y in zip(begin.tolist(), far[begin].tolist(), strict=True)]
            out[t, q] += [(max(0, a), min(int(words.count[t]), b)) for a, b in spans]


def _groups(text: np.ndarray, item: np.ndarray, lo: int, hi: int):
    """(text, item, begin, stop) of each group in a range of rows sorted by both."""
    edge = np.flatnonzero((text[lo + 1 : hi] != text[lo : hi - 1]) | (item[lo + 1 : hi] != item[lo : hi - 1])) + lo + 1
    for i, j in zip([lo, *edge.tolist()], [*edge.tolist(), hi], strict=True):
        yield int(text[i]), int(item[i]), i, j


def _count(index):
    def run(batches):
        terms, some_terms = index.value
        total = np.zeros(len(terms), np.int64)
        for batch in slices(batches, 0):
            words = Words(*joined(batch.column(0), GAP), lower=True, gaps=NO_WORD)
            _, term = _look_up(words.hash, terms, some_terms)
            total += np.bincount(term, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["term", "times"])

    return run


def _hits(held: Items, words: Words):
    """(text, item, (matched words, start, stop)) of all copies and excerpts."""
    for t in np.flatnonzero((words.count > 0) & (words.count < held.n)).tolist() if held.short else []:
        n = int(words.count[t])
        for q in held.short.get(tuple(words.hash[words.first[t] : words.first[t + 1]].tolist()), []):
            yield t, q, (n, 0, n)
    copies, excerpts = _copies(held, words), _excerpts(held, words)
    for t, q in sorted(copies.keys() | excerpts.keys()):
        item = held.words[held.first[q] : held.first[q + 1]]
        text = words.hash[words.first[t] : words.first[t + 1]]
        best = (0, 0, 0)
        for a, b in dict.fromkeys(copies.get((t, q), []) + excerpts.get((t, q), [])):
            n, s, e = align(item, text[a:b])
            if n > best[0]:
                best = (n, a + s, a + e)
        if best[0] >= held.need[q] or any(has_excerpt(item, text[a:b], held.excerpt, held.identity) for a, b in excerpts.get((t, q), [])):
            yield t, q, best


def _find(index, types):
    def run(batches):
        held = index.value
        for batch in slices(batches):
            words = Words(*joined(batch.column(1), GAP), lower=True, gaps=NO_WORD)
            rows = [(t, held.ids[q], best[0] / int(held.length[q]), *best) for t, q, best in _hits(held, words)]
            if rows:
                t, q, score, n, s, e = zip(*rows, strict=True)
                yield pa.record_batch([batch.column(0).take(pa.array(t)), pa.array(q, types), pa.array(score), *[pa.array(x, pa.int64()) for x in (n, s, e)]], names=["a", "b", "score", "matched", "start_word", "stop_word"])

    return run


def _keep(index, column: int):
    def run(batches):
        held = index.value
        for batch in slices(batches, column):
            words = Words(*joined(batch.column(column), GAP), lower=True, gaps=NO_WORD)
            clean = np.ones(batch.num_rows, bool)
            clean[[t for t, _, _ in _hits(held, words)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _indices(texts: DataFrame, items: DataFrame, n: int, identity: float, excerpt: int, item_col: str, item_text: str, limit: int):
    """The items' index, broadcast in blocks of ``limit`` bytes of text; one empty block without items."""
    spark = texts.sparkSession
    arrow = items.select(F.col(item_col), F.col(item_text).cast("string")).toLocalIterator()  # a block at a time on the driver
    ids, block, size = [], [], 0

    def made():
        index = Items(ids, block, n, identity, excerpt)
        sent = spark.sparkContext.broadcast((index.terms, index.term_map))
        got = texts.select("text").mapInArrow(_count(sent), "term bigint, times bigint").groupBy("term").agg(F.sum("times").alias("times")).toArrow()  # two numbers for each word of the block at most
        frequency = np.zeros(len(index.terms), np.int64)
        frequency[got["term"].to_numpy()] = got["times"].to_numpy()
        sent.destroy()
        index.choose_seeds(frequency)
        if index.nbytes() > 64 * limit + (1 << (BITS + 2)):
            raise ValueError(f"the index of a block of items takes {index.nbytes()} bytes; lower limit ({limit})")
        return spark.sparkContext.broadcast(index)

    some = False
    for item, text in arrow:
        ids.append(item), block.append(text)
        size += len(text or "") + 16
        if size > limit:
            yield made()
            some, ids, block, size = True, [], [], 0
    if ids or not some:
        yield made()


def contaminated(docs: DataFrame, items: DataFrame, n: int = 3, identity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", limit: int = 8 << 20, excerpt: int = 13) -> DataFrame:
    """(id_col, item_col, score, matched, start_word, stop_word): each text's best copy of each item, or excerpt of so many words."""
    tune(docs.sparkSession)
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"a {kinds[0]}, b {kinds[1]}, score double, matched bigint, start_word bigint, stop_word bigint"
    texts = docs.select(F.col(id_col).alias("a"), F.col(text_col).cast("string").alias("text"))

    import pyspark.sql.pandas.types as arrow_types

    types = arrow_types.to_arrow_type(items.schema[item_col].dataType)
    found = None
    for sent in _indices(texts, items, n, identity, excerpt, item_col, item_text, limit):
        more = texts.mapInArrow(_find(sent, types), schema)
        found = more if found is None else found.union(more)
    return found.select(F.col("a").alias(id_col), F.col("b").alias(item_col), "score", "matched", "start_word", "stop_word")


def decontaminated(docs: DataFrame, items: DataFrame, n: int = 3, identity: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", limit: int = 8 << 20, excerpt: int = 13) -> DataFrame:
    """The rows of docs, with or without id, whose string ``text_col`` holds no copy and no excerpt of an item."""
    tune(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))
    out = docs
    for sent in _indices(texts, items, n, identity, excerpt, item_col, item_text, limit):
        out = out.mapInArrow(_keep(sent, docs.columns.index(text_col)), docs.schema)
    return out


def seeds_needed(m: int, n: int, identity: float) -> int:
    """n-grams of an item of m words that survive when (1 - identity) * m words change and none are inserted."""
    return max(1, math.ceil((m - n + 1) - n * (1 - identity) * m - 1e-9))
