"""Numbers of rows in sorted order, found by all tasks together: no window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetally.tables import checkpointed


def ranked(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """rows with ``rank`` (from 0 on in its group) and ``total`` (rows of the group).

    Rows are sorted by ranges of (groups, order), which also split one group that has most rows; a range's rows are
    numbered as they lie, and what a group has in earlier ranges is added. Only (range, group) counts meet in windows.
    Null is a group like others and comes first. Rows that the order leaves equal get different ranks, in the order of
    the input; a range may end between them. ``rows`` is read twice, so what is dear is to be stored before. The names
    rank, total, _tie, _part, _mid and _first are taken."""
    keys = [F.col(g).asc_nulls_first() for g in groups] + order + [F.col("_tie").asc()]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    laid = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    laid = checkpointed(laid.withColumn("_part", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    parts = laid.groupBy(*groups, "_part").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*groups)
    earlier = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [f"_g{k}" for k in range(len(groups))]
    parts = parts.select(*[F.col(g).alias(k) for g, k in zip(groups, names, strict=True)], F.col("_part").alias("_p"), "_first", earlier.alias("_earlier"), F.sum("_n").over(group).alias("total"))
    same = F.col("_part") == F.col("_p")
    for g, k in zip(groups, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(k))
    rank = (F.col("_earlier") + F.col("_mid") - F.col("_first")).alias("rank")
    return laid.join(parts, same).select(*rows.columns, rank, "total")
