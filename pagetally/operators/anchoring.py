"""Anchored and suspect figures, and repairs over several totals, from the relations that hold and fail."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor, isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.operators.reconcile import decimals, edits
from pagetally.operators.relating import Related, arguments, gathered, listed, with_marks

REPAIR = T.ArrayType(T.StructType([T.StructField("col", T.StringType()), T.StructField("row_id", T.StringType()), T.StructField("old", T.DoubleType()), T.StructField("new", T.DoubleType()), T.StructField("mended", T.IntegerType())]))


def anchored(cells: DataFrame, links: DataFrame, keys: Sequence[str], tolerance: float = 1.0) -> DataFrame:
    """(keys, row_id, col, value, holding, failing, anchored, suspect) of every figure.

    A relation is a total with its printed components in one column. A figure is *anchored* if a relation that holds
    has it, since the others there fix its value. A figure of a failing relation is *suspect* unless it is anchored; where
    all figures of a failing relation are anchored they contradict each other, and all are suspect. A figure in no
    relation is neither. cells: keys, row_id, col, value; links: ``reconcile.edges``."""
    figures = gathered(cells.where("value IS NOT NULL").select(*keys, "row_id", "col", "value"), links, keys)
    out = with_marks(figures, keys, _anchors(tolerance))
    return out.select(*keys, "row_id", "col", "value", "mark.holding", "mark.failing", (F.col("mark.holding") > 0).alias("anchored"), "mark.suspect")


def _anchors(tolerance: float) -> Column:
    """Of a gathered statement's cells the relations that hold and fail, and whether each is suspect."""

    @F.arrow_udf("array<struct<holding: bigint, failing: bigint, suspect: boolean>>")
    def find(row: pa.Array, col: pa.Array, value: pa.Array, total: pa.Array, ref: pa.Array, sign: pa.Array) -> pa.Array:
        figures = Related(row, col, value, total, ref, sign)
        totals, held, missed, members = figures.checked(tolerance)
        # a printed total is a member of its own relation, once
        printed = np.flatnonzero(held | missed)
        pairs = np.concatenate([members[(held | missed)[members[:, 0]]], np.stack([printed, totals[printed]], 1)])
        relation, cell = np.unique(pairs, axis=0).T
        cells, place = np.unique(cell, return_inverse=True)
        holding, failing = (np.bincount(place, flags[relation], minlength=len(cells)).astype(np.int64) for flags in (held, missed))
        loose = missed[relation]
        open_ = np.zeros(len(totals), bool)  # failing relations with a figure that nothing anchors
        open_[relation[loose & (holding[place] == 0)]] = True
        clash = np.zeros(len(cells), bool)
        clash[place[loose & ~open_[relation]]] = True
        at = np.minimum(np.searchsorted(cells, figures.cell), max(len(cells) - 1, 0))
        known = (cells[at] == figures.cell) & (figures.cell >= 0) if len(cells) else np.zeros(len(at), bool)
        take = lambda x: np.where(known, x[at], 0) if len(cells) else np.zeros(len(at), np.int64)
        n, bad = take(holding), take(failing)
        suspect = (bad > 0) & ((n == 0) | (take(clash) > 0))
        return pa.ListArray.from_arrays(listed(row), pa.StructArray.from_arrays([pa.array(n), pa.array(bad), pa.array(suspect)], ["holding", "failing", "suspect"]))

    return find(*arguments())


def repairs(values: dict[str, float], links: dict[str, list[tuple[str, int]]], tolerance: float) -> list[tuple[str, float, float, int]]:
    """(row_id, old, new, totals mended) for each group of failing totals of one column that one edit mends.

    Failing totals that share a figure are one group. The edit is of one figure that all of them have, by one digit
    (substituted, left out or inserted), and makes every relation of that figure hold; a group with no such edit, or
    with several, is left alone. links: total to (component, sign)."""
    checked = {t: there for t, parts in links.items() if t in values and (there := [p for p in parts if p[0] in values])}
    slope = {t: {t: 1} for t in checked}
    for t, parts in checked.items():
        for name, sign in parts:
            slope[t][name] = slope[t].get(name, 0) - sign
    gap = {t: sum(s * values[x] for x, s in slope[t].items()) for t in checked}
    # of any other figure than a finite one nothing can be said
    failing = [t for t in checked if not abs(gap[t]) <= tolerance and isfinite(gap[t])]
    member: dict[str, list[str]] = {}
    for t in checked:
        for name, s in slope[t].items():
            if s:
                member.setdefault(name, []).append(t)
    group: dict[str, int] = {}
    for n, t in enumerate(failing):
        if t in group:
            continue
        queue = [t]
        while queue:
            here = queue.pop()
            if here not in group:
                group[here] = n
                queue += [other for name in slope[here] if slope[here][name] for other in member[name] if other in failing and other not in group]
    out = []
    for n in sorted(set(group.values())):
        broken = [t for t in failing if group[t] == n]
        common = set.intersection(*[{x for x, s in slope[t].items() if s} for t in broken])
        found = set()
        for name in common:
            old = values[name]
            places = decimals(old)
            scale = 10**places
            figure, sign = round(abs(old) * scale), -1 if old < 0 else 1
            s = slope[broken[0]][name]
            middle, reach = sign * (old - gap[broken[0]] / s) * scale, (tolerance + 1e-6) / abs(s) * scale
            for number in edits(figure, max(len(str(figure)), places + 1), floor(middle - reach) - 1, ceil(middle + reach) + 1):
                new = number / scale * sign
                if new != old and all(abs(gap[t] + slope[t][name] * (new - old)) <= tolerance + 1e-6 for t in member[name]):
                    found.add((name, old, new))
        if len(found) == 1:
            out.append((*found.pop(), len(broken)))
    return sorted(out)


def _mended(tolerance: float) -> Column:
    """Of a gathered statement the repairs of its columns in which a total fails."""

    @F.arrow_udf(REPAIR)
    def find(row: pa.Array, col: pa.Array, value: pa.Array, total: pa.Array, ref: pa.Array, sign: pa.Array) -> pa.Array:
        figures = Related(row, col, value, total, ref, sign)
        totals, _, missed, _ = figures.checked(tolerance)
        failing = np.flatnonzero(np.isin(figures.cell, totals[missed]))
        broken: dict[int, set] = {}
        columns = col.flatten()
        for k in failing.tolist():
            broken.setdefault(int(figures.owner[k]), set()).add(columns[k].as_py())
        begin, begin_link = (listed(x).to_numpy() for x in (row, total))
        names, values, totals, refs, signs = (x.flatten() for x in (row, value, total, ref, sign))
        out = []
        for k in range(len(row)):
            found: list[dict] = []
            if k in broken:
                here, there = slice(begin[k], begin[k + 1]), slice(begin_link[k], begin_link[k + 1])
                links: dict[str, list] = {}
                parts = zip(totals[there].to_pylist(), refs[there].to_pylist(), signs[there].to_pylist(), strict=True)
                for t, x, s in sorted((t, x, int(s)) for t, x, s in parts if None not in (t, x, s)):
                    links.setdefault(t, []).append((x, s))
                lines = sorted((r, v, c) for r, v, c in zip(names[here].to_pylist(), values[here].to_pylist(), columns[here].to_pylist(), strict=True) if r is not None and v is not None and isfinite(v) and c in broken[k])
                for name in sorted(broken[k]):
                    mended = repairs({r: v for r, v, c in lines if c == name}, links, tolerance)
                    found += [dict(zip(("col", "row_id", "old", "new", "mended"), (name, *r), strict=True)) for r in mended]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("col", pa.string()), ("row_id", pa.string()), ("old", pa.float64()), ("new", pa.float64()), ("mended", pa.int32())])))

    return find(*arguments())


def repair_groups(cells: DataFrame, links: DataFrame, keys: Sequence[str], tolerance: float = 1.0) -> DataFrame:
    """(keys, col, row_id, old, new, mended): ``repairs`` of every column in which a total fails. A statement is gathered once, with
    its links (it has a few dozen rows), and only its columns with a failing total are looked at one by one."""
    kind = dict(cells.dtypes)["col"]
    found = gathered(cells.select(*keys, "row_id", "col", "value"), links, keys).select(*keys, F.inline(_mended(tolerance)))
    return found.withColumn("col", F.col("col").cast(kind))
