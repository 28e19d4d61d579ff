"""Signed sums in tables: which rows or columns are totals of those before them, some of them subtracted."""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.operators.gathered import flat

SCALE = 100  # figures have two places
MOST_MINUS = 4
CHANCE = 0.01
FEW_ROWS = 12  # tables up to these rows are solved together: at most 2,368 sums each
AT_ONCE = 1 << 21  # sums at once
FOUND = T.ArrayType(T.StructType([T.StructField("axis", T.StringType()), T.StructField("target", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("minus", T.ArrayType(T.IntegerType()))]))


def _few(values: np.ndarray, wanted: np.ndarray, begins: np.ndarray, tolerance: int, m: int) -> tuple[int, tuple[int, ...]] | None:
    """For runs that begin at ``begins`` (nearest first) and what of each is to be subtracted, doubled: the first run, and
    there the first m rows (two at most), whose sums meet it in every column within the tolerance. All runs at once."""
    if m == 0:
        hit = np.flatnonzero((np.abs(wanted) <= tolerance).all(1))
        return (int(hit[0]), ()) if len(hit) else None
    a, b = np.triu_indices(len(values), 1) if m == 2 else (np.arange(len(values)), None)
    sums = 2 * (values[a] + values[b] if m == 2 else values)
    at = np.argwhere((np.abs(sums[None] - wanted[:, None]) <= tolerance).all(-1) & (a[None] >= begins[:, None]))
    if not len(at):
        return None
    run, k = at[0].tolist()
    return run, (int(a[k]), int(b[k])) if m == 2 else (int(a[k]),)


def _subset(values: np.ndarray, wanted: np.ndarray, tolerance: int, m: int) -> tuple[int, ...] | None:
    """The first three or four rows (in lexicographic order) whose doubled sums meet ``wanted`` in every column within the
    tolerance. Four rows are two pairs that meet in the middle: pairs' sums in order, and for each a range of the others."""
    n = len(values)
    near = lambda sums: (np.abs(2 * sums - wanted) <= tolerance).all(-1)
    a, b = np.triu_indices(n, 1)
    pairs = values[a] + values[b]
    if m == 3:
        p, k = np.nonzero(near(pairs[:, None, :] + values[None, :, :]) & (b[:, None] < np.arange(n)))
        return min(zip(a[p].tolist(), b[p].tolist(), k.tolist(), strict=True), default=None)
    order = np.argsort(pairs[:, 0], kind="stable")
    sums = 2 * pairs[order, 0]
    low = np.searchsorted(sums, wanted[0] - tolerance - 2 * pairs[:, 0], side="left")
    high = np.searchsorted(sums, wanted[0] + tolerance - 2 * pairs[:, 0], side="right")
    best = None
    count = high - low
    for part in np.array_split(np.arange(len(a)), int(count.sum()) // (1 << 20) + 1):
        p = np.repeat(part, count[part])
        q = order[np.repeat(low[part] - (np.cumsum(count[part]) - count[part]), count[part]) + np.arange(count[part].sum())]
        ok = np.flatnonzero((b[p] < a[q]) & near(pairs[p] + pairs[q]))
        found = min(zip(a[p[ok]].tolist(), b[p[ok]].tolist(), a[q[ok]].tolist(), b[q[ok]].tolist(), strict=True), default=None)
        best = found if best is None or found is not None and found < best else best
    return best


def _problems(cells: np.ndarray, there: np.ndarray, tolerance: int):
    """(target, rows, values, total, alone) of every line along the first axis that may be a total: its figures, those of the lines
    before it in the same columns, and how likely a sum fits by accident."""
    if len(cells) < 3 or not cells.shape[1]:
        return
    size = np.abs(cells)
    biggest = size.max(0)
    chances = np.minimum(1.0, (2 * tolerance + 1) / (2.0 * biggest + 1))
    if there.all():  # every column of every line counts
        alone, rows = float(np.prod(chances)), np.arange(len(cells))
        for target in (np.flatnonzero(size[2:].max(1) >= 1000 * SCALE) + 2).tolist():
            yield target, rows[:target], cells[:target], cells[target], alone
        return
    for target in range(2, len(cells)):
        columns = np.flatnonzero(there[target])
        if not len(columns) or size[target, columns].max() < 1000 * SCALE:
            continue
        rows = np.flatnonzero(there[:target, columns].any(1))
        alone = float(np.prod(chances[columns]))
        yield target, rows, cells[np.ix_(rows, columns)], cells[target, columns], alone


def _solved(values: np.ndarray, total: np.ndarray, alone: float, tolerance: int, most_minus: int, chance: float) -> tuple[int, tuple[int, ...]] | None:
    """(length, minus) of the sum that counts, if any."""
    after = np.cumsum(values[::-1], axis=0)  # of the last rows, one, two, ...
    n = len(values)
    for m in range(most_minus + 1):
        lengths = [k for k in range(max(2, m + 1), n + 1) if comb(k, m) * n * alone < chance]
        if lengths and m < 3:
            run = np.array(lengths)
            found = _few(values, after[run - 1] - total, n - run, tolerance, m)
            if found:
                return lengths[found[0]], found[1]
        for length in lengths if m >= 3 else ():
            rest = _subset(values[n - length :], after[length - 1] - total, tolerance, m)
            if rest is not None:
                return length, tuple(n - length + k for k in rest)
    return None


@cache
def _candidates(n: int, most_minus: int) -> tuple[list[tuple[int, tuple[int, ...]]], np.ndarray, np.ndarray]:
    """All sums of n rows in the order in which they count: (length, minus), each row's factor in them, and their ``comb``."""
    found = [(k, minus) for m in range(most_minus + 1) for k in range(max(2, m + 1), n + 1) for minus in combinations(range(n - k, n), m)]
    signs = np.zeros((len(found), n), np.int64)
    for at, (k, minus) in enumerate(found):
        signs[at, n - k :] = 1
        signs[at, list(minus)] = -1
    return found, signs, np.array([comb(k, len(minus)) for k, minus in found], float)


def _solved_together(problems: list, tolerance: int, most_minus: int, chance: float) -> list:
    """``_solved`` of many problems (values, total, alone): those of few rows and of one shape try all sums at once."""
    out: list = [None] * len(problems)
    shapes: dict[tuple[int, int], list[int]] = {}
    for at, (values, _, _) in enumerate(problems):
        if len(values) <= FEW_ROWS:
            shapes.setdefault(values.shape, []).append(at)
        else:
            out[at] = _solved(*problems[at], tolerance, most_minus, chance)
    for (n, wide), here in shapes.items():
        found, signs, tries = _candidates(n, most_minus)
        step = max(1, AT_ONCE // max(1, len(found) * wide))
        for part in (here[s : s + step] for s in range(0, len(here), step) if found):
            values, total = (np.stack([problems[at][k] for at in part]) for k in (0, 1))
            alone = np.array([problems[at][2] for at in part])
            fits = tries * (n * alone[:, None]) < chance
            for c in range(wide):
                fits &= np.abs(values[:, :, c] @ signs.T - total[:, c, None]) <= tolerance
            first = fits.argmax(1)
            for at, k, hit in zip(part, first.tolist(), fits[np.arange(len(part)), first].tolist(), strict=True):
                out[at] = found[k] if hit else None
    return out


TABLES = pa.list_(pa.list_(pa.float64()))


def _tables_of(tables: pa.ListArray):
    """(cells, there) of each table: its figures in hundredths, and where there are any."""
    rows = flat(tables)
    lengths = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    figures = pc.fill_null(flat(rows).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    there = np.abs(figures) < 1e13
    cells = np.rint(np.where(there, figures, 0.0) * SCALE).astype(np.int64)
    wide, ends = lengths(rows), np.cumsum(lengths(tables)).tolist()
    places, at = np.concatenate([[0], np.cumsum(wide)]).tolist(), 0
    each = wide.tolist()
    for end in ends:
        sizes = each[at:end]
        width, inside = max(sizes, default=0), slice(places[at], places[end])
        if sizes.count(width) == len(sizes):
            yield cells[inside].reshape(len(sizes), width), there[inside].reshape(len(sizes), width)
        else:
            x, y = np.zeros((len(sizes), width), np.int64), np.zeros((len(sizes), width), bool)
            filled = np.arange(width) < np.array(sizes)[:, None]
            x[filled], y[filled] = cells[inside], there[inside]
            yield x, y
        at = end


def signed_totals_of(tables: pa.ListArray, tolerance: float, most_minus: int, chance: float) -> list[list[tuple[str, int, int, list[int]]]]:
    """``signed_totals`` of each of many tables."""
    limit = round(tolerance * SCALE)
    asked, problems = [], []
    for number, (cells, there) in enumerate(_tables_of(tables)):
        for axis, x, y in (("rows", cells, there), ("columns", cells.T, there.T)):
            for target, rows, *problem in _problems(x, y, limit):
                asked.append((number, axis, target, rows))
                problems.append(problem)
    out: list[list] = [[] for _ in tables]
    for (number, axis, target, rows), hit in zip(asked, _solved_together(problems, limit, most_minus, chance), strict=True):
        if hit:
            out[number].append((axis, target, int(rows[len(rows) - hit[0]]), [int(rows[k]) for k in hit[1]]))
    return out


def signed_totals(table: list[list[float | None]], tolerance: float = 1.0, most_minus: int = MOST_MINUS, chance: float = CHANCE) -> list[tuple[str, int, int, list[int]]]:
    """(axis, target, first, minus): lines of a table that are totals. Axis "rows": the row ``target`` is the sum of the rows
    from ``first`` on to the one before it, those in ``minus`` subtracted; "columns": likewise of columns from the left.

    It has to hold, within the tolerance, in every column in which the target has a figure (a missing component adds
    nothing; rows without any figure there are no components), one of which is a thousand or more. At least two components, at
    least one of them added, at most ``most_minus`` subtracted. *Against chance hits*: with so many sums to try, by run and
    subtracted components, fewer than ``chance`` would fit by accident if sums were spread evenly over the range of the columns'
    figures; longer runs or more minus signs are not looked at. Of several sums the one with the fewest minus signs counts, of
    these the shortest, of these the first. A figure that is no finite number below 10**13 is a missing one."""
    good = lambda v: float(v) if isinstance(v, int | float) else None
    return signed_totals_of(pa.array([[[good(v) for v in r or ()] for r in table]], TABLES), tolerance, most_minus, chance)[0]


def relations_with_signs(values: Column, tolerance: float = 1.0) -> Column:
    """``signed_totals`` of a table, given as an array of rows of figures; the tables of a batch together."""

    @F.arrow_udf(FOUND)
    def find(tables: pa.Array) -> pa.Array:
        found = signed_totals_of(tables, tolerance, MOST_MINUS, CHANCE)
        names = ("axis", "target", "first", "minus")
        out = [None if not t else [dict(zip(names, f, strict=True)) for f in here] for t, here in zip(tables.is_valid().to_pylist(), found, strict=True)]
        return pa.array(out, pa.list_(pa.struct([("axis", pa.string()), ("target", pa.int32()), ("first", pa.int32()), ("minus", pa.list_(pa.int32()))])))

    return find(values)
