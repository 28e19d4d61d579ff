"""Sampling, bounds and rank correlations."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagetally.operators.ranks import ranked
from pagetally.tables import checkpointed


def stratified_draw(filings: DataFrame, strata: Sequence[str], seed, key: str = "filing_id", stratum: str = "format", exclude: Iterable[str] = ()) -> list[tuple[str, str]]:
    """(stratum, filing): one filing for each stratum that has one, from a single seeded generator that goes through the strata
    in order. Filings are ranked by key within their stratum over all tasks; the driver gets the strata's counts, draws a
    rank for each, and fetches the filings of these ranks. ``strata`` and ``exclude`` are lists that a person gives."""
    left = filings.select(F.col(key).alias("key"), F.col(stratum).alias("stratum")).where(F.col(stratum).isin(list(strata)) & F.col(key).isNotNull()).distinct()
    taken = list(exclude)
    left = left.where(~F.col("key").isin(taken)) if taken else left
    placed = checkpointed(ranked(left, ["stratum"], [F.col("key").asc()]))
    sizes = dict(placed.groupBy("stratum").agg(F.max("total")).collect())
    generator = random.Random(seed)
    drawn = [(s, generator.choice(range(sizes[s]))) for s in strata if s in sizes]
    wanted = F.create_map(*[F.lit(x) for pair in drawn for x in pair]) if drawn else None
    found = dict(placed.where(F.col("rank") == F.element_at(wanted, F.col("stratum"))).select("stratum", "key").collect()) if drawn else {}
    return [(s, found[s]) for s, _ in drawn]


def upper_bound(errors: int, n: int, level: float = 0.95) -> float:
    """Exact one-sided upper bound of an error rate: the rate at which so few errors have probability 1 - level."""
    if n <= 0 or errors >= n:
        return 1.0
    if errors == 0:
        return 1 - (1 - level) ** (1 / n)
    low, high = errors / n, 1.0
    ways = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(errors + 1)]
    for _ in range(200):
        p = (low + high) / 2
        if p in (low, high):  # no double lies between them
            break
        there, not_there = math.log(p), math.log1p(-p)
        tail = sum(math.exp(w + k * there + (n - k) * not_there) for k, w in enumerate(ways))
        low, high = (p, high) if tail > 1 - level else (low, p)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def _bound(errors: pd.Series, n: pd.Series, level: pd.Series) -> pd.Series:
    """A row at a time, the batch's different ones once."""
    known: dict = {}
    out = []
    for e, m, p in zip(errors, n, level, strict=True):
        if e is None or m is None or e != e or m != m:
            out.append(None)
            continue
        one = int(e), int(m), float(p)
        if one not in known:
            known[one] = upper_bound(*one)
        out.append(known[one])
    return pd.Series(out, dtype="Float64")


def error_bound(errors: Column, n: Column, level: float = 0.95) -> Column:
    """``upper_bound`` as a column; rows without errors stay built-in expressions."""
    return F.when(n <= 0, 1.0).when(errors >= n, 1.0).when(errors == 0, zero_error_bound(n, level)).otherwise(_bound(errors, n, F.lit(level)))


def zero_error_bound(n: Column, level: float = 0.95) -> Column:
    return F.lit(1.0) - F.pow(F.lit(1 - level), F.lit(1.0) / n)


def ranks(c: str, within: Sequence[str] = ()) -> Column:
    """Average ranks."""
    order = Window.partitionBy(*within).orderBy(c)
    ties = Window.partitionBy(*within, c)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2


def spearman(df: DataFrame, a: str, b: str, within: Sequence[str] = ()) -> DataFrame:
    """Correlation of average ranks; one row, or one for each group. Ranks need each group in order."""
    ranked = df.select(*within, ranks(a, within).alias("ra"), ranks(b, within).alias("rb"))
    return ranked.groupBy(*within).agg(F.corr("ra", "rb").alias("spearman"))


def inversions(values: np.ndarray) -> int:
    """Pairs whose earlier value is larger, bit by bit of the values' ranks: no pair is looked at."""
    _, rank = np.unique(values, return_inverse=True)
    total = 0
    for bit in range(max(1, int(rank.max(initial=0)).bit_length())):
        group, high = rank >> (bit + 1), (rank >> bit) & 1
        order = np.argsort(group, kind="stable")
        group, high = group[order], high[order]
        ones = np.cumsum(high)
        first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
        before = np.maximum.accumulate(np.where(first, ones - high, 0)) if len(group) else ones
        total += int((ones - before)[high == 0].sum())
    return total


def tau_b(a: np.ndarray, b: np.ndarray) -> float | None:
    """Kendall's rank correlation with ties; null where one side does not vary."""
    n = len(a)
    ties = lambda *x: sum(k * (k - 1) // 2 for k in np.unique(np.stack(x, 1), axis=0, return_counts=True)[1].tolist())
    pairs, ta, tb, both = n * (n - 1) // 2, ties(a), ties(b), ties(a, b)
    if pairs in (ta, tb):
        return None
    discordant = inversions(b[np.lexsort((b, a))])
    return (pairs - ta - tb + both - 2 * discordant) / math.sqrt((pairs - ta) * (pairs - tb))


def kendall(df: DataFrame, a: str, b: str, within: Sequence[str] = (), most: int = 5_000_000) -> DataFrame:
    """(within, kendall): tau-b of the rows of each group with both values. A group is sorted in one task, in time
    n log n; one of more than ``most`` rows is an error. Without ``within`` there is one row."""
    keys = [F.col(k) for k in within] or [F.lit(1).alias("_all")]
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    names = [f.name for f in rows.schema.fields[:-2]]
    size = F.count(F.lit(1)).alias("_n")
    largest = rows.groupBy(*names).agg(size).agg(F.max("_n")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a group has {largest} rows, more than {most}")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        out = {k: [group[k].iloc[0]] for k in names}
        return pd.DataFrame({**out, "kendall": [tau_b(group["_a"].to_numpy(), group["_b"].to_numpy())]})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]) + ", kendall double"
    return rows.groupBy(*names).applyInPandas(one, schema).select(*within, "kendall")


def stratum_counts(df: DataFrame, *strata: str) -> DataFrame:
    """(strata, n): rows of each stratum, with subtotals and a grand total in the rows whose strata are null."""
    return df.rollup(*strata).agg(F.count(F.lit(1)).alias("n"))
