"""Multisets of values as long tables (key..., value, n)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, keys: Sequence[str], values: str, absolute: bool = False) -> DataFrame:
    """(keys, value, n) of an array column; keys with an empty array have no rows."""
    value = F.explode(values)
    rows = df.select(*keys, value.alias("value"))
    return rows.groupBy(*keys, (F.abs("value") if absolute else F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value, na, nb): every value of either side."""
    left, right = a.withColumnRenamed("n", "na"), b.withColumnRenamed("n", "nb")
    both = left.join(right, [*keys, "value"], "full")
    return both.select(*keys, "value", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), [*keys, "value"]).select(*keys, "value", F.least("na", "nb").alias("n"))


def union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return aligned(a, b, keys).select(*keys, "value", F.greatest("na", "nb").alias("n"))


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a has more of than b."""
    return aligned(a, b, keys).where("na > nb").select(*keys, "value", (F.col("na") - F.col("nb")).alias("n"))


def recall_precision(truth: DataFrame, output: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, matched, in_truth, in_output, recall, precision); empty sides count as one."""
    total = aligned(truth, output, keys).groupBy(*keys).agg(F.sum(F.least("na", "nb")).alias("matched"), F.sum("na").alias("in_truth"), F.sum("nb").alias("in_output"))
    share = lambda n: F.col("matched") / F.greatest(F.lit(1), F.col(n))
    return total.select("*", share("in_truth").alias("recall"), share("in_output").alias("precision"))


def jaccard(a: DataFrame, b: DataFrame, keys: Sequence[str], pages: DataFrame) -> DataFrame:
    """(keys, jaccard) for every key of ``pages``: shared over united multiplicities, 1 where both are empty."""
    total = aligned(a, b, keys).groupBy(*keys).agg((F.sum(F.least("na", "nb")) / F.sum(F.greatest("na", "nb"))).alias("j"))
    return pages.select(*keys).distinct().join(total, list(keys), "left").select(*keys, F.coalesce("j", F.lit(1.0)).alias("jaccard"))


def mean_jaccard(pages: DataFrame, by: Sequence[str] = (), jaccard: str = "jaccard") -> DataFrame:
    """(by, pages, parity): the mean over pages; 0 without pages."""
    return pages.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), (F.coalesce(F.sum(jaccard), F.lit(0.0)) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("parity"))


def concatenated(*lists: DataFrame) -> DataFrame:
    """All records of all lists, repeats too."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out


def united(*sets: DataFrame) -> DataFrame:
    """Each different record once."""
    return concatenated(*sets).distinct()


def medoid(readings: DataFrame, page: str, run: str, order: str) -> DataFrame:
    """(page, run, score) of the reading that shares most with the others; its own size breaks ties by
    a thousandth, then the order of runs. readings: (page, run, order, value, n)."""
    a = readings.select(page, run, order, "value", "n")
    shared_with_all = a.groupBy(page, "value").agg(F.collect_list(F.struct(F.col(run).alias("r"), F.col("n").alias("k"))).alias("others"))  # a row for each run at most
    total = F.aggregate("others", F.lit(0).cast("bigint"), lambda s, o: s + F.when(o["r"] != F.col(run), F.least(o["k"], F.col("n"))).otherwise(0))
    score = a.join(shared_with_all, [page, "value"]).groupBy(page, run, order).agg((F.sum(total) + 0.001 * F.sum("n")).alias("score"))
    best = F.max_by(F.struct(run, "score"), F.struct("score", -F.col(order)))
    return score.groupBy(page).agg(best.alias("b")).select(page, F.col(f"b.{run}").alias(run), "b.score")
