"""Edit distances and similarities of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate in code points; NaN for an empty reference."""
    n = F.length(reference)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(F.levenshtein(reference, hypothesis) / n)


def _distance(a: Sequence, b: Sequence, substitution: int = 1) -> int:
    """Edit distance of sequences with substitutions at 1 or 2. A column of the table of distances is kept as bits of
    integers (Myers; Hyyrö for 2, where the distance is that of the longest common subsequence)."""
    if not a or not b:
        return len(a) + len(b)
    at: dict = {}
    for i, t in enumerate(a):
        at[t] = at.get(t, 0) | 1 << i
    every = (1 << len(a)) - 1
    if substitution == 2:
        open_ = every
        for t in b:
            if t in at:
                hit = open_ & at[t]
                open_ = (open_ + hit | open_ - hit) & every
        return len(b) - len(a) + 2 * open_.bit_count()
    up, down, last, found = every, 0, 1 << len(a) - 1, len(a)
    for t in b:
        same = at.get(t, 0)
        across = ((same & up) + up ^ up) | same
        right, left = down | ~(across | up) & every, up & across
        found += (right & last > 0) - (left & last > 0)
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(same | down | right)) & every, right & (same | down) & every
    return found


@F.pandas_udf(T.DoubleType())
def _wer(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    def one(r, h):
        if r is None or h is None:
            return None
        r, h = r.split(), h.split()
        return _distance(r, h) / len(r) if r else float("nan")

    return pd.Series([one(r, h) for r, h in zip(reference, hypothesis, strict=True)], dtype="object").astype("Float64")


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate; NaN for a reference without words."""
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    r, h = words(reference), words(hypothesis)
    vocabulary = F.array_distinct(F.concat(r, h))
    # Words become code points, so that the JVM's character distance is the word distance.
    coded = lambda ws: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 19967), 8, "0")), "UTF-32")), "")
    small = F.size(vocabulary) < 20_000
    return F.when(F.size(r) == 0, F.lit(float("nan"))).when(small, F.levenshtein(coded(r), coded(h)) / F.size(r)).otherwise(_wer(reference, hypothesis))


def distance_grid(a: Sequence[str], b: Sequence[str], substitution: int = 1) -> np.ndarray:
    """``_distance`` of each of a and each of b. Texts of two lengths are compared at once: a place of the table of
    distances is a step for all of their pairs."""
    out = np.zeros((len(a), len(b)), np.int32)
    by: list[dict[int, list[int]]] = [{}, {}]
    for side, texts in enumerate((a, b)):
        for i, t in enumerate(texts):
            by[side].setdefault(len(t), []).append(i)
    for n, left in by[0].items():
        for m, right in by[1].items():
            if not n or not m or n * m > 2500 or len(left) * len(right) < 16:
                for i in left:
                    out[i, right] = [_distance(a[i], b[j], substitution) for j in right]
                continue
            code = lambda texts, which, k: np.frombuffer("".join(texts[i] for i in which).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, k)
            columns = code(b, right, m)
            part = max(1, (1 << 22) // ((m + 1) * len(right)))
            for at in range(0, len(left), part):
                rows = code(a, left[at : at + part], n)
                line = np.broadcast_to(np.arange(m + 1, dtype=np.int16)[:, None, None], (m + 1, len(rows), len(right))).copy()
                for x in range(n):
                    corner = line[0].copy()
                    line[0] = x + 1
                    for y in range(m):
                        change = corner + substitution * (rows[:, x, None] != columns[None, :, y]).astype(np.int16)
                        corner = line[y + 1].copy()
                        np.minimum(np.minimum(corner, line[y]) + 1, change, out=line[y + 1])
                out[np.ix_(left[at : at + part], right)] = line[m]
    return out


def similarity(a: str, b: str) -> float:
    """100 for equal texts, 0 for texts without a common character: 1 - indel / total length."""
    if a == b:
        return 100.0
    total = len(a) + len(b)
    return 100.0 * (1 - _distance(a, b, 2) / total) if total else 100.0


def best_window(a: str, b: str) -> float:
    """The shorter text's similarity with the best window of its length in the longer, ends included. Of texts of
    one length either may be the shorter one: the larger value counts, so the order of arguments does not matter."""
    if len(a) == len(b):
        return max(_best_window(a, b), _best_window(b, a))
    return _best_window(*sorted((a, b), key=len))


def _best_window(short: str, long: str) -> float:
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, best = len(short), 0.0
    for at in range(1 - n, len(long)):
        best = max(best, similarity(short, long[max(0, at) : at + n]))
    return best


def _codes(texts: Sequence[str]) -> np.ndarray:
    """Code points of texts of one length, a column for each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    small = next(k for k in (np.uint8, np.uint16, np.uint32) if points.max() <= np.iinfo(k).max)
    return np.ascontiguousarray(points.reshape(len(texts), -1).T.astype(small))


def _strands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tiskin's semi-local comparison of pairs of texts (columns of a and b, see ``_codes``): for each place of b the place
    above a at which the strand that leaves there began, -1 for one that came from the left. The longest common
    subsequence of a and b[i:j] leaves out as many of the j - i characters as strands before j began at i or later.
    Cells of a diagonal do not depend on one another and are combed at once."""
    n, m = len(a), len(b)
    kind = next(k for k in (np.int8, np.int16, np.int32) if m <= np.iinfo(k).max)
    down = np.repeat(np.arange(m, dtype=kind)[:, None], b.shape[1], axis=1)
    across, backward = np.full(a.shape, -1, kind), np.ascontiguousarray(a[::-1])
    for d in range(n + m - 1):
        first, end = max(0, d - n + 1), min(m, d + 1)
        rows, columns = slice(n - 1 - d + first, n - 1 - d + end), slice(first, end)
        same, h, v = backward[rows] == b[columns], across[rows], down[columns]
        low, high = np.minimum(h, v), np.maximum(h, v)
        low, high = np.where(same, v, low), np.where(same, h, high)
        across[rows], down[columns] = low, high
    return down


def _combed(a: Sequence[str], b: Sequence[str]) -> Iterator[tuple[list[int], int, np.ndarray]]:
    """(numbers of the pairs, length of their a, their strands): pairs without empty texts, those of the same two lengths
    together, in parts of bounded size."""
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x and y:
            alike.setdefault((len(x), len(y)), []).append(i)
    for (n, m), numbers in alike.items():
        step = max(1, (1 << 17) // max(n, m))
        for at in range(0, len(numbers), step):
            part = numbers[at : at + step]
            yield part, n, _strands(_codes([a[i] for i in part]), _codes([b[i] for i in part]))


def similarities(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``similarity`` of many pairs."""
    out = np.array([0.0 if len(x) + len(y) else 100.0 for x, y in zip(a, b, strict=True)])
    for part, n, strands in _combed(a, b):
        total = n + len(strands)
        out[part] = 100.0 * (1 - (n - len(strands) + 2 * np.count_nonzero(strands >= 0, axis=0)) / total)
    return out


def best_windows(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``best_window`` of many pairs."""
    out = _best_windows(a, b)
    equal = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if len(x) == len(y) and out[i] < 100]
    out[equal] = np.maximum(out[equal], _best_windows([b[i] for i in equal], [a[i] for i in equal]))
    return out


def _best_windows(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    short, long = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)], strict=True) if len(a) else ((), ())
    out = np.array([100.0 if x in y and (x or not y) else 0.0 for x, y in zip(short, long, strict=True)])
    todo = np.flatnonzero(out == 0)
    for part, n, strands in _combed([short[i] for i in todo], [long[i] for i in todo]):
        m, best = len(strands), np.zeros(len(part))
        for at in range(1 - n, m):
            i, j = max(0, at), min(m, at + n)
            left_out = (strands[i:j] >= i).view(np.int8).sum(axis=0, dtype=strands.dtype)
            np.maximum(best, 100.0 * (1 - (n - (j - i) + 2.0 * left_out) / (n + j - i)), out=best)
        out[todo[part]] = best
    return out


class Bigrams:
    """The bigrams of texts as bits, for an upper bound of ``best_window``.

    A common subsequence of k characters of the shorter text (n characters) and a window (w of them, at most n) keeps at
    least 3k - 1 - n - w of the shorter text's bigrams: of k - 1 neighbours in the subsequence at most n - k stand apart in
    the one and w - k in the other. With g bigrams of the shorter text that the longer one holds, no window is therefore more
    similar than 2 (g + 1 + n) / (3n + g + 1). Bits that bigrams share only raise g."""

    BITS = 512

    def __init__(self, texts: Sequence[str]):
        self.length = np.array([len(x) for x in texts], np.int64)
        marks = np.zeros((len(texts), self.BITS // 64), np.uint64)
        step = 1 << 14
        for at in range(0, len(texts), step):
            n = self.length[at : at + step]
            point = np.frombuffer("".join(texts[at : at + step]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            owner = np.repeat(np.arange(len(n)), n)
            both = np.flatnonzero(owner[1:] == owner[:-1])
            bit = ((point[both] * np.uint64(0x9E3779B1) + point[both + 1]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(self.BITS)
            seen = np.zeros((len(n), self.BITS), bool)
            seen[owner[both], bit.astype(np.int64)] = True
            marks[at : at + step] = np.packbits(seen, axis=1).view(np.uint64)
        self.marks = np.ascontiguousarray(marks.T)
        self.repeats = np.maximum(self.length - 1, 0) - np.bitwise_count(marks).sum(axis=1, dtype=np.int64)
        self._part: tuple = (None, None, None, None)

    def part(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marks, repeats, lengths) of those texts; the last ones asked for are kept, as many labels meet the same texts."""
        if self._part[0] is not at:
            self._part = (at, np.ascontiguousarray(self.marks[:, at]), self.repeats[at], self.length[at])
        return self._part[1:]

    def bounds(self, i: int, others: Bigrams, at: np.ndarray) -> np.ndarray:
        """At least ``best_window`` of text i and each of those texts."""
        marks, their_repeats, m = others.part(at)
        n, common = self.length[i], np.zeros(len(at), np.int16)
        for mine, theirs in zip(self.marks[:, i], marks, strict=True):
            common += np.bitwise_count(mine & theirs)
        repeats = np.where(m < n, their_repeats, np.where(m > n, self.repeats[i], np.maximum(self.repeats[i], their_repeats)))
        held, short = common + repeats + 1, np.minimum(n, m)
        return 100.0 * 2 * (held + short) / (3 * short + held) + 1e-9


class Subsequences:
    """Texts by columns of characters, for a closer bound of ``best_window``: a window has no longer subsequence in common
    with a label than a stretch of the text around it. Stretches are half as long again as the label and begin at every half
    of it; windows that an end of the text cuts short are seen through the beginnings that hold them, an eighth of the label
    apart. Labels of more than 64 characters (a subsequence is the bits of one integer) and texts of more than ``LONG`` have
    no bound."""

    LONG = 1000

    def __init__(self, texts: Sequence[str]):
        length = np.array([len(x) if len(x) <= self.LONG else 0 for x in texts], np.int64)
        order = np.argsort(-length, kind="stable")[: np.count_nonzero(length)]
        self.rank = np.full(len(texts), -1)
        self.rank[order] = np.arange(len(order))
        self.length = length[order]
        ordered = "".join([texts[i] for i in order])
        points, codes = np.unique(np.frombuffer(ordered.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        self.number = {p: i for i, p in enumerate(points.tolist())}
        start = np.repeat(np.cumsum(self.length) - self.length, self.length)
        place = np.arange(len(codes)) - start
        end = np.repeat(self.length, self.length) - 1 - place
        self.columns = [np.split(codes[np.argsort(x, kind="stable")].astype(np.int32), np.cumsum(np.bincount(x))[:-1]) for x in (place, end)]

    def _walk(self, label: str, mine: np.ndarray, first: int, stop: int, backward: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(t, length of the longest common subsequence of label and the characters from ``first`` to t) of these texts, longest
        first, for t up to ``stop``; those that have ended keep theirs. Backward label and texts are read from their ends."""
        kind = np.uint32 if len(label) <= 32 else np.uint64
        masks = np.zeros(len(self.number), kind)
        for i, x in enumerate(reversed(label) if backward else label):
            if ord(x) in self.number:
                masks[self.number[ord(x)]] |= kind(1 << i)
        length, every = -self.length[mine], kind((1 << len(label)) - 1)
        open_ = np.full(len(mine), every)
        for t in range(first, stop):
            here = open_[: np.searchsorted(length, -t)]
            if len(here):
                hit = here & masks.take(self.columns[backward][t].take(mine[: len(here)]))
                here[:] = (here + hit | here - hit) & every
            yield t + 1, open_

    def bounds(self, label: str, at: np.ndarray) -> np.ndarray:
        """At least ``best_window`` of the label and each of those texts."""
        n, out = len(label), np.full(len(at), np.inf)
        known = np.flatnonzero(self.rank[at] >= 0)
        if not 0 < n <= 64 or not len(known):
            return out
        known = known[np.argsort(self.rank[at][known])]
        mine = self.rank[at][known]
        length, bound = self.length[mine], np.zeros(len(mine))
        common = lambda open_: n - np.bitwise_count(open_).astype(np.int64)
        longer = np.count_nonzero(length > n)
        half, step = max(1, n // 2), max(1, n // 8)
        for first in range(0, max(1, int(length[0]) - n), half):
            count = np.count_nonzero(length > first + n) if first else longer
            for t, open_ in self._walk(label, mine[:count], first, first + n + half):
                if not first and t < n and (t % step == 0 or t == n - 1):
                    np.maximum(bound[:count], 2 * common(open_) / (n + t - (t - 1) % step), out=bound[:count])
            np.maximum(bound[:count], common(open_) / n, out=bound[:count])
        for t, open_ in self._walk(label, mine[:longer], 0, n - 1, backward=True):
            if t % step == 0 or t == n - 1:
                np.maximum(bound[:longer], 2 * common(open_) / (n + t - (t - 1) % step), out=bound[:longer])
        if longer < len(mine):
            for _, open_ in self._walk(label, mine[longer:], 0, n):
                pass
            k = common(open_)
            bound[longer:] = 2 * k / (np.minimum(length[longer:], n) + k)
        out[known] = 100.0 * bound + 1e-9
        return out


def _of_pairs(score: Callable, a: pd.Series, b: pd.Series) -> pd.Series:
    """Scores of a batch's different pairs, put where they belong; null where a text is null."""
    place: dict = {}
    at = [None if x is None or y is None else place.setdefault((x, y), len(place)) for x, y in zip(a, b, strict=True)]
    found = score([x for x, _ in place], [y for _, y in place]).tolist()
    return pd.Series([None if i is None else found[i] for i in at], dtype="Float64")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_pairs(similarities, a, b)


@F.pandas_udf(T.DoubleType())
def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_pairs(best_windows, a, b)


def ratio(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return _partial(a, b)
