"""Loops inside a text: a stretch of words or characters that is repeated many times in a row, whatever its length.

A run of period p is a stretch in which every element equals the one p places before. Runs that repeat ``times`` times
or more are found octave by octave: one with a period from 2**k to 2**(k+1) holds, every (times - 2) * 2**k places, a place
whose next 2**k elements stand again p places further on. So n / (times - 2) fingerprints are compared in an
octave, n log n in all, and every hit is extended to both sides by comparing elements. Periods below ``SHORT`` are found by
comparing all elements with those so many places before. Several texts are looked at together, with different elements
between them, which no run can cross."""

from __future__ import annotations

import bisect
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\S+")
SHORT = 8  # an octave begins here
TOGETHER = 1 << 18  # characters of texts that are looked at together
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _stretch(same, at: int, limit: int, step: int) -> int:
    """How many places in a row, from ``at`` on in the direction of ``step``, are the same (at most ``limit``)."""
    done, size = 0, 32
    while done < limit:
        size = min(size, limit - done)
        first = at + done * step
        part = same(first, first + size) if step > 0 else same(first - size + 1, first + 1)[::-1]
        if not part.all():
            return done + int(part.argmin())
        done += size
        size *= 2
    return done


def runs(x: np.ndarray, times: int, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(begin, end, period) of maximal runs of ``times`` periods or more, each with its smallest period; ``longest``
    bounds the length of a run that can occur."""
    n, spans = len(x), {}
    for period in range(1, SHORT):
        if times * period > n:
            break
        other = np.flatnonzero(np.r_[True, x[period:] != x[:-period], True])  # between these all are the same
        many = np.flatnonzero(np.diff(other) > (times - 1) * period)
        for i in many.tolist():  # a run of a shorter period is one of its multiples, too
            spans.setdefault((int(other[i]), int(other[i + 1]) - 1 + period), period)
    found = [(b, e, period) for (b, e), period in spans.items()]
    known = sorted(found)  # runs that may cover a hit of a longer period, by their beginnings
    begins = [r[0] for r in known]
    mark = _mixed(x.astype(np.uint64) + np.uint64(1))
    for k in range(SHORT.bit_length() - 1):
        if n > 2 << k:
            mark = _mixed(mark[: n - (2 << k) + 1] * _MIX + mark[1 << k : n - (1 << k) + 1])
    k = SHORT.bit_length() - 1
    while times << k <= min(n, longest or n):
        width, step = 1 << k, (times - 2) << k
        q = np.arange(0, n - 2 * width + 1, step)
        for first in range(0, len(q), max(1, (1 << 20) >> k)):
            part = q[first : first + max(1, (1 << 20) >> k)]
            p = np.arange(width, 2 * width)
            other = part[:, None] + p
            inside = other <= n - width
            hit = (mark[np.minimum(other, n - width)] == mark[part][:, None]) & inside
            for i, j in np.argwhere(hit).tolist():
                at, period = int(part[i]), int(p[j])
                near = bisect.bisect_right(begins, at)
                if any(at + period + width <= b and period % r == 0 for _, b, r in known[max(0, near - 4) : near]):
                    continue
                same = lambda a, b, period=period: x[a:b] == x[a + period : b + period]
                end = at + _stretch(same, at, n - period - at, 1)
                begin = at - _stretch(same, at - 1, at, -1)
                if end - begin + period >= times * period:
                    found.append((begin, end + period, period))
                    place = bisect.bisect_right(begins, begin)
                    known.insert(place, found[-1])
                    begins.insert(place, begin)
        if k + 1 < 63 and n > 2 * width:
            mark = _mixed(mark[: n - 2 * width + 1] * _MIX + mark[width : n - width + 1])
        k += 1
    smallest: dict[tuple[int, int], int] = {}
    for begin, end, period in found:
        if period < smallest.get((begin, end), period + 1):
            smallest[begin, end] = period
    return [(b, e, p) for (b, e), p in smallest.items()]


def _cuts(texts: list[str], times: int, least: int, words: bool) -> list[int | None]:
    """For each text the number of elements that stay, None for all."""
    out: list[int | None] = []
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= TOGETHER or i + 1 == len(texts):
            out += _cuts_together(texts[first : i + 1], times, least, words)
            first, size = i + 1, 0
    return out


def _cuts_together(texts: list[str], times: int, least: int, words: bool) -> list[int | None]:
    codes: dict[str, int] = {}
    parts, begins, at, longest = [], [], 0, 0
    for number, t in enumerate(texts):
        items = np.array([codes.setdefault(w, len(codes)) for w in WORD.findall(t)], np.int64) if words else np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        parts += [items, np.array([-1 - number])]
        begins.append(at)
        at += len(items) + 1
        longest = max(longest, len(items))
    out: list[int | None] = [None] * len(texts)
    best: dict[int, tuple[int, int]] = {}
    for begin, end, period in runs(np.concatenate(parts), times, longest) if parts else []:
        if end - begin >= max(times * period, least):
            doc = int(np.searchsorted(begins, begin, side="right")) - 1
            best[doc] = min(best.get(doc, (begin, period)), (begin, period))
    for doc, (begin, period) in best.items():
        out[doc] = begin - begins[doc] + period
    return out


def cut_text(text: str, kept: int, words: bool) -> str:
    if not words:
        return text[:kept]
    for n, match in enumerate(WORD.finditer(text), 1):
        if n == kept:
            return text[: match.end()]
    return text


def _udf(times: int, least: int, words: bool):
    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        plain = [t or "" for t in texts]
        kept = _cuts(plain, times, least, words)
        return pd.Series([None if t is None else p if n is None else cut_text(p, n, words) for t, p, n in zip(texts, plain, kept, strict=True)], dtype=object)

    return cut


def cut_tandem(c: Column, times: int = 8, least: int = 0, words: bool = True) -> Column:
    """The text up to where a stretch of words (or, with ``words=False``, of characters) begins to stand ``times`` times in a
    row or more, over ``least`` elements or more; the first of them is kept. Of several such places the first counts, there
    the shortest stretch. Words are runs of other characters than white space, compared as they are; what stands between
    them does not matter. Null stays null; a text without such a loop stays as it is. The rule is this library's own."""
    if times < 3:
        raise ValueError("a loop is three times in a row or more")
    return _udf(times, least, words)(c)
