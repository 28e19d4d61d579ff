"""Totals and their components: reconciliation, coverage, diagnosis, one-digit repair."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor, isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.functions.text import signed_reference
from pagetally.operators.relating import covering, gathered, with_marks


def edges(rows: DataFrame, keys: Sequence[str], row: str = "row_id", refs: str = "sum_of") -> DataFrame:
    """(keys, total, ref, sign): one row for each component; ``-id`` subtracts."""
    e = rows.select(*keys, F.col(row).alias("total"), F.explode(refs).alias("r"))
    ref, sign = signed_reference(F.col("r"))
    return e.select(*keys, "total", ref.alias("ref"), sign.alias("sign"))


def reconcile(cells: DataFrame, links: DataFrame, keys: Sequence[str], tolerance: float = 1.0) -> DataFrame:
    """(keys, total, col, printed, summed, components, reconciles) for every printed total.
    cells: keys, row_id, col, value (null: blank, adds nothing)."""
    part = cells.select(*keys, F.col("row_id").alias("ref"), "col", F.col("value").alias("part"))
    total = cells.select(*keys, F.col("row_id").alias("total"), "col", F.col("value").alias("printed")).where("printed IS NOT NULL")
    summed = links.join(part, [*keys, "ref"]).groupBy(*keys, "total", "col").agg(F.sum(F.col("sign") * F.col("part")).alias("summed"), F.count("part").alias("components"))
    out = total.join(summed.where("components > 0"), [*keys, "total", "col"])
    return out.select(*keys, "total", "col", "printed", "summed", "components", (F.abs(F.col("printed") - F.col("summed")) <= tolerance).alias("reconciles"))


def diagnose(checked: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Adds ``diagnosis`` to totals: reconciles, rounding gap, sign flipped, digits dropped, or unexplained."""
    printed, summed = F.col("printed"), F.col("summed")
    gap = F.abs(printed - summed)
    text = lambda c: F.format_string("%.0f", F.abs(c))
    shorter = F.startswith(text(summed), text(printed)) & (F.length(text(printed)) < F.length(text(summed)))
    kind = (
        F.when(gap <= tolerance, F.when(gap == 0, "reconciles").otherwise("rounding gap"))
        .when(F.abs(printed + summed) <= tolerance, "sign flipped")
        .when(shorter, "digits dropped")
        .otherwise("unexplained")
    )
    return checked.withColumn("diagnosis", kind)


def covered(cells: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """cells with ``covered``: non-blank, and a total or a component of a total printed in its column. A statement is gathered once."""
    marked = with_marks(gathered(cells, links, keys), keys, covering()).withColumnRenamed("mark", "covered")
    return marked.select(*keys, "row_id", "col", *[c for c in cells.columns if c not in (*keys, "row_id", "col")], "covered")


def validation_totals(statements: DataFrame, group: str, **counted) -> DataFrame:
    """(group, statements, one column for each of ``counted``): a row for each group and a grand total whose group is null."""
    return statements.rollup(group).agg(F.count(F.lit(1)).alias("statements"), *[c.alias(k) for k, c in counted.items()])


def coverage(marked: DataFrame, group: str) -> DataFrame:
    """(group, figures, covered, share) with a grand total in the row whose group is null."""
    total = marked.where("value IS NOT NULL").rollup(group).agg(F.count(F.lit(1)).alias("figures"), F.sum(F.col("covered").cast("bigint")).alias("covered"))
    return total.withColumn("share", F.col("covered") / F.col("figures"))


def promote(drafts: DataFrame, approved: DataFrame, key: str, approver: str, date: str) -> DataFrame:
    """Drafts without errors that are not approved yet, stamped. drafts: key, n_errors, ..."""
    stamp = F.lit(f"{approver} {date}")
    return drafts.where("n_errors = 0").join(approved.select(key), key, "left_anti").withColumn("verified_by", stamp)


def decimals(value: float) -> int:
    """Places behind the point that a figure of two places at most needs."""
    return next((k for k in (0, 1) if round(value, 2) == round(value, k)), 2)


def edits(figure: int, length: int, low: int, high: int) -> set[int]:
    """The numbers from low to high (0 at least) that a figure of so many digits becomes by one substitution, deletion or
    insertion of a digit. For each place the digits that lead there are computed, not tried."""
    low, out = max(low, 0), set()

    def digits(rest: int, step: int) -> None:
        for d in range(max(0, -((rest - low) // step)), min(9, (high - rest) // step) + 1):
            out.add(rest + d * step)

    step = 1
    for i in range(length + 1):
        upper, lower = divmod(figure, step)
        if i < length:
            short = upper // 10 * step + lower
            digits(short + upper // 10 * 9 * step, step)
            if length > 1 and low <= short <= high:
                out.add(short)
        digits(upper * 10 * step + lower, step)
        step *= 10
    return out


def _repaired(values: dict[str, float], links: dict[str, list[tuple[str, int]]], tolerance: float) -> tuple[str, float, float] | None:
    """(row_id, old, new) of the one edit that mends a column's one failing total; links: total to (component, sign)."""
    checked = {t: there for t, parts in links.items() if t in values and (there := [p for p in parts if p[0] in values])}
    fails = lambda v: [t for t, parts in checked.items() if abs(v[t] - sum(s * v[x] for x, s in parts)) > tolerance]
    broken = fails(values)
    if len(broken) != 1:
        return None
    total = broken[0]
    gap = values[total] - sum(s * values[x] for x, s in checked[total])
    found = set()
    for name in dict.fromkeys([total, *[x for x, _ in checked[total]]]):
        old = values[name]
        slope = 1 if name == total else -sum(s for x, s in checked[total] if x == name)
        if not slope or not isfinite(old) or not isfinite(gap):
            continue
        places = decimals(old)
        scale = 10**places
        figure, sign = round(abs(old) * scale), -1 if old < 0 else 1
        middle, reach = sign * (old - gap / slope) * scale, (tolerance + 1e-6) / abs(slope) * scale
        for n in edits(figure, max(len(str(figure)), places + 1), floor(middle - reach) - 1, ceil(middle + reach) + 1):
            new = n / scale * sign
            if new != old and abs(gap + slope * (new - old)) <= tolerance + 1e-6 and not fails(values | {name: new}):
                found.add((name, old, new))
                if len(found) > 1:
                    return None
    return found.pop() if found else None


def _repairs(tolerance: float):
    """Of each column's cells and its statement's links: a list of the repair, or an empty one."""

    @F.arrow_udf("array<struct<row_id: string, old: double, new: double>>")
    def one(row_id: pa.Array, value: pa.Array, total: pa.Array, ref: pa.Array, sign: pa.Array) -> pa.Array:
        cut = lambda a: np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        names, figures, totals, refs, signs = (a.flatten().to_pylist() for a in (row_id, value, total, ref, sign))
        out, at, from_link = [], 0, 0
        for end, to_link in zip(cut(row_id), cut(total), strict=True):
            values = {k: v for k, v in zip(names[at:end], figures[at:end], strict=True) if v is not None and v == v}
            links: dict[str, list] = {}
            for t, x, s in zip(totals[from_link:to_link], refs[from_link:to_link], signs[from_link:to_link], strict=True):
                links.setdefault(t, []).append((x, s))
            mended = _repaired(values, links, tolerance)
            out.append([dict(zip(("row_id", "old", "new"), mended, strict=True))] if mended else [])
            at, from_link = end, to_link
        return pa.array(out, pa.list_(pa.struct([("row_id", pa.string()), ("old", pa.float64()), ("new", pa.float64())])))

    return one


def repair(cells: DataFrame, links: DataFrame, keys: Sequence[str], tolerance: float = 1.0) -> DataFrame:
    """(keys, col, row_id, old, new): of each column in which exactly one total fails, the figure of that total
    or its components whose one-digit edit makes every total of the column hold; columns with none or
    several such edits are left alone. A figure's point keeps its place from the right; one that is not finite has no edits.
    Works on whole columns: a statement has a few dozen rows."""
    listed = lambda *names: F.array_sort(F.collect_list(F.struct(*names)))
    # Dealt by statement, columns and links meet without another exchange.
    columns = cells.repartition(*keys).groupBy(*keys, "col").agg(listed(F.col("row_id").cast("string").alias("row_id"), F.col("value").cast("double").alias("value")).alias("c"))
    wanted = links.groupBy(*keys).agg(listed(F.col("total").cast("string").alias("total"), F.col("ref").cast("string").alias("ref"), "sign").alias("l"))
    mended = _repairs(tolerance)(*[F.col(c) for c in ("c.row_id", "c.value", "l.total", "l.ref", "l.sign")])
    return columns.join(wanted, list(keys)).select(*keys, "col", F.inline(mended))
