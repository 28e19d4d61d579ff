"""Similarity of tables as grids of cells (GriTS, content), by the published factored alignment.

Rows are aligned by a dynamic programme whose reward for two rows is the best alignment of their cells;
columns likewise; the cells where an aligned row pair and an aligned column pair meet are compared.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.functions.distance import distance_grid, similarity

Grid = list[list[str]]
#: Pairs of cells from which on arrays pay; pairs of different cells up to which grids are compared; entries of a part.
FEW_CELLS, MOST_CELLS, PART = 2_000, 40_000_000, 1 << 23


def _table(reward: list[list[float]]) -> list[list[float]]:
    """The largest total reward of an order-preserving pairing, for each beginning of the rows and of the columns."""
    best = [[0.0] * (len(reward[0]) + 1)]
    for gains in reward:
        above, left, row = best[-1], 0.0, [0.0]
        for j, gain in enumerate(gains):
            take = above[j] + gain
            if take > left:
                left = take
            if above[j + 1] > left:
                left = above[j + 1]
            row.append(left)
        best.append(row)
    return best


def _aligned(reward: list[list[float]]) -> list[tuple[int, int]]:
    """The order-preserving pairing of rows with columns that has the largest total reward."""
    best = _table(reward)
    pairs, i, j = [], len(reward), len(reward[0])
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def _alike(a: str, b: str, known: dict) -> float:
    """1 for equal cells, else the share of characters in their longest common subsequence."""
    if a == b:
        return 1.0
    if (a, b) not in known:
        known[a, b] = similarity(a, b) / 100
    return known[a, b]


def _tables(gain, n: int, m: int, shape: tuple[int, int]) -> np.ndarray:
    """The last entry of ``_table`` for a whole matrix of pairs: gain(i, j) has the rewards of row i with column j for all of them."""
    best = np.zeros((m + 1, *shape))
    for i in range(n):
        above, left = best[0].copy(), best[0]
        for j in range(m):
            left = np.maximum(np.maximum(left, above + gain(i, j)), best[j + 1])
            above, best[j + 1] = best[j + 1].copy(), left
    return best[m]


def large_grid_similarity(a: Grid, b: Grid) -> float:
    """``grid_similarity`` of large grids of one width each: different cells are compared once, and the alignments of all
    pairs of rows, then of all pairs of columns, are found together. Memory: 4 bytes for each pair of different cells, and 8
    for each pair of rows and column of b, in parts."""
    known: list[dict[str, int]] = [{}, {}]
    x, y = (np.array([[k.setdefault(c, len(k)) for c in r] for r in g]) for g, k in zip((a, b), known, strict=True))
    if len(known[0]) * len(known[1]) > MOST_CELLS:
        raise ValueError(f"tables of {len(known[0])} and {len(known[1])} different cells are too large to compare")
    total = np.add.outer(*[[len(c) for c in k] for k in known])
    alike = np.where(total > 0, 100.0 * (1 - distance_grid(list(known[0]), list(known[1]), 2) / np.maximum(total, 1)) / 100, 1.0)
    (n, wide), (m, broad) = x.shape, y.shape
    step = max(1, PART // (m * (broad + 1)))
    rows = np.concatenate([_tables(lambda k, c, s=s: alike[np.ix_(x[s : s + step, k], y[:, c])], wide, broad, (min(step, n - s), m)) for s in range(0, n, step)])
    columns = _tables(lambda i, j: alike[np.ix_(x[i], y[j])], n, m, (wide, broad))
    pairs, kept = _aligned(rows.tolist()), _aligned(columns.tolist())
    return 2 * sum(float(alike[x[i, k], y[j, c]]) for i, j in pairs for k, c in kept) / (x.size + y.size)


def grid_similarity(truth: Grid, output: Grid) -> float:
    """GriTS: 1 for equal grids, 0 for nothing in common; cells of both in the denominator."""
    rectangle = lambda g: [r + [""] * (max(map(len, g)) - len(r)) for r in g]
    a, b = (rectangle(g) if g and any(g) else [] for g in (truth, output))
    size = sum(map(len, a)) + sum(map(len, b))
    if not size:
        return 1.0
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if len(a) * len(a[0]) * len(b) * len(b[0]) > FEW_CELLS:
        return large_grid_similarity(a, b)
    known: dict = {}
    cells = [[[[_alike(x, y, known) for y in rb] for x in ra] for rb in b] for ra in a]  # row a, row b, cell a, cell b
    rows = _aligned([[_table(grid)[-1][-1] for grid in row] for row in cells])
    columns = _aligned([[_table([[grid[k][c] for grid in row] for row in cells])[-1][-1] for c in range(len(b[0]))] for k in range(len(a[0]))])
    return 2 * sum(cells[i][j][k][c] for i, j in rows for k, c in columns) / size


@F.pandas_udf(T.DoubleType())
def _grids(truth: pd.Series, output: pd.Series) -> pd.Series:
    clean = lambda text: [[c or "" for c in row] for row in json.loads(text)]
    return pd.Series([None if t is None or o is None else grid_similarity(clean(t), clean(o)) for t, o in zip(truth, output, strict=True)], dtype="Float64")


def grits(truth: Column, output: Column) -> Column:
    """Of two tables given as arrays of rows of cells."""
    return _grids(F.to_json(truth), F.to_json(output))
