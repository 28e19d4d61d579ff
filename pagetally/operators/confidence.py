"""Confidence tiers, threshold sweeps, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.functions.text import number_text


def floor_probability(p: Column) -> Column:
    """The smallest token probability; missing and zero both count as one."""
    return F.coalesce(F.nullif(p, F.lit(0.0)), F.lit(1.0))


def tier(p: Column, anchored: Column, suspect: Column, agreed: Column) -> Column:
    """LOW, MEDIUM or HIGH; a mark that is null counts as not set."""
    anchored, suspect, agreed = (F.coalesce(c, F.lit(False)) for c in (anchored, suspect, agreed))
    low = suspect | (~agreed & ~anchored) | (floor_probability(p) < 0.95)
    return F.when(low, "LOW").when(anchored & agreed, "HIGH").otherwise("MEDIUM")


def sweep(records: DataFrame, thresholds: Sequence[float] = (0.99, 0.95, 0.90, 0.80)) -> DataFrame:
    """(threshold, flagged_correct, flagged_wrong): share of correct and number of wrong values below it, among
    values with a probability; null without correct ones. A correct value is compared as it is, so one of 0 is flagged;
    a wrong value's 0 counts as one, as in ``floor_probability``."""
    below = F.when(F.col("correct"), F.col("p_min")).otherwise(floor_probability(F.col("p_min"))) < F.col("threshold")
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    known = records.where("p_min IS NOT NULL").select("p_min", "correct", at)
    share = F.count_if(below & F.col("correct")) / F.nullif(F.count_if("correct"), F.lit(0))
    return known.groupBy("threshold").agg(share.alias("flagged_correct"), F.count_if(below & ~F.col("correct")).alias("flagged_wrong"))


def agreement_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if("agreed").alias("agreed"), F.count_if("anchored").alias("anchored"), F.count_if(F.col("agreed") & F.col("anchored")).alias("both"))


def probe(outputs: DataFrame, group: str) -> DataFrame:
    """(group, passed, items): outputs that contain all their true figures; digits and separators of either script count
    as ASCII ones on both sides, and all else is dropped. outputs: group, output, truths."""
    normal = outputs.select(group, number_text(F.col("output")).alias("_output"), F.transform("truths", number_text).alias("_truths"))
    ok = F.forall("_truths", lambda t: F.contains(F.col("_output"), t))
    return normal.groupBy(group).agg(F.count_if(ok).alias("passed"), F.count(F.lit(1)).alias("items"))


def matrix(scores: DataFrame, row: str, run: str, runs: Sequence[str], value: str) -> DataFrame:
    return scores.groupBy(row).pivot(run, list(runs)).agg(F.sum(value))


def gate(scores: DataFrame, floors: dict[str, float], run: str = "run", recall: str = "recall") -> DataFrame:
    """(run, recall, floor, passes): a run without a score counts as 0."""
    floor = scores.sparkSession.createDataFrame([(k, float(v)) for k, v in floors.items()], f"{run} string, floor double")
    got = floor.join(scores.select(run, F.col(recall).alias("recall")), run, "left").withColumn("recall", F.coalesce("recall", F.lit(0.0)))
    return got.select(run, "recall", "floor", (F.col("recall") >= F.col("floor")).alias("passes"))
