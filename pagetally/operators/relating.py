"""Figures of statements and the totals that they belong to, a batch of gathered statements at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.operators.gathered import codes, owners, places, ranges


def gathered(cells: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cells, links) of every statement: lists of all columns of its cells but the keys, and of (total, ref, sign). Where both
    inputs are dealt by keys (``dealt``) they meet without another exchange."""
    inner = F.collect_list(F.struct(*[c for c in cells.columns if c not in keys]))
    link = F.struct(F.col("total").cast("string").alias("total"), F.col("ref").cast("string").alias("ref"), F.col("sign").cast("double").alias("sign"))
    return cells.groupBy(*keys).agg(inner.alias("cells")).join(links.groupBy(*keys).agg(F.collect_list(link).alias("links")), list(keys), "left")


def arguments() -> list[Column]:
    """Of a gathered statement: its cells' row, column and value, its links' total, component and sign."""
    text = lambda name: F.transform("cells", lambda c: c[name].cast("string"))
    return [text("row_id"), text("col"), F.transform("cells", lambda c: c["value"].cast("double")), F.col("links.total"), F.col("links.ref"), F.col("links.sign")]


class Related:
    """The batch's figures, numbered in order, and its links, each with the figures of its component and of its total.

    ``cell``: a number for the statement, row and column of a figure, -1 where it has no value or no name;
    ``of_ref``: pairs (link, figure of its component); ``whole``: of each pair the ``cell`` of the link's total in that column."""

    def __init__(self, row: pa.ListArray, col: pa.ListArray, value: pa.ListArray, total: pa.ListArray, ref: pa.ListArray, sign: pa.ListArray):
        self.owner = owners(row)
        self.names, total, ref = codes(row.flatten(), total.flatten(), ref.flatten())
        (columns,) = codes(col.flatten())
        self.value = pc.fill_null(value.flatten(), 0.0).to_numpy(zero_copy_only=False)
        there = value.flatten().is_valid().to_numpy(zero_copy_only=False) & (self.names >= 0) & (columns >= 0)
        kinds, wide = max(x.max(initial=0) for x in (self.names, total, ref)) + 1, columns.max(initial=0) + 1
        self.wide = wide
        key = self.owner * kinds + self.names
        self.cell = np.where(there, key * wide + columns, -1)
        self.columns = columns
        figure = np.flatnonzero(there)
        self.figure = figure[np.argsort(key[figure], kind="stable")]
        self.keys = key[self.figure]
        owner = owners(sign)
        self.total = np.where(total >= 0, owner * kinds + total, -1)
        self.ref = np.where(ref >= 0, owner * kinds + ref, -1)
        self.sign = pc.fill_null(sign.flatten(), 0.0).to_numpy(zero_copy_only=False)
        self.signed = sign.flatten().is_valid().to_numpy(zero_copy_only=False)

    def met(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (link, figure) of links' names with their figures."""
        link, at = ranges(*places(names, self.keys))
        return link, self.figure[at]

    def covered(self) -> np.ndarray:
        """Whether a figure is a total, or a component of a total with a figure in its column."""
        link, figure = self.met(self.total)
        part = np.where(self.ref[link] >= 0, self.ref[link] * self.wide + self.columns[figure], -1)
        return np.isin(self.cell, np.union1d(self.cell[figure], part)) & (self.cell >= 0)

    def checked(self, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(totals, held, missed, members): the cells of printed totals with components in their column, in order, whether a
        figure there is their sum, whether one is not; and pairs (place of a total, cell of a component)."""
        link, figure = self.met(self.ref)
        keep = self.total[link] >= 0
        link, figure = link[keep], figure[keep]
        whole = self.total[link] * self.wide + self.columns[figure]
        summed, place = np.unique(whole, return_inverse=True)
        sums = np.zeros(len(summed))
        with np.errstate(invalid="ignore", over="ignore"):
            np.add.at(sums, place, np.where(self.signed[link], self.sign[link] * self.value[figure], 0.0))
            printed = np.flatnonzero(np.isin(self.cell, summed) & (self.cell >= 0))
            at = np.searchsorted(summed, self.cell[printed])
            ok = np.abs(self.value[printed] - sums[at]) <= tolerance
        held, missed = np.zeros(len(summed), bool), np.zeros(len(summed), bool)
        held[at[ok]] = True
        missed[at[~ok]] = True
        return summed, held, missed, np.unique(np.stack([place, self.cell[figure]], 1), axis=0)


def covering() -> Column:
    """Of a gathered statement's cells whether each is ``covered``."""

    @F.arrow_udf("array<boolean>")
    def find(row: pa.Array, col: pa.Array, value: pa.Array, total: pa.Array, ref: pa.Array, sign: pa.Array) -> pa.Array:
        marks = Related(row, col, value, total, ref, sign).covered()
        return pa.ListArray.from_arrays(listed(row), pa.array(marks))

    return find(*arguments())


def listed(lists: pa.ListArray) -> pa.Array:
    """Offsets for the flattened elements of lists."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())


def with_marks(statements: DataFrame, keys: Sequence[str], marks: Column) -> DataFrame:
    """(keys, every column of the cells, ``mark``), a row for each cell."""
    names = [f.name for f in statements.schema["cells"].dataType.elementType]
    each = statements.select(*keys, F.explode(F.arrays_zip("cells", marks.alias("mark"))).alias("_c"))
    return each.select(*keys, *[F.col(f"_c.cells.{n}").alias(n) for n in names], F.col("_c.mark").alias("mark"))
