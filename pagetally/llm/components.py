"""Connected components of a graph given by its links, by alternating large and small stars.

Each round replaces the links by links to smaller neighbours: a shuffle by node with a minimum that
is combined before it, and a join of the links with these minima. Nodes that hold more than a
thousandth of all link ends (so at most a thousand of them) are joined by broadcast, so a node on which very many
others hang is dealt to no single task. Rounds end with a reliable checkpoint; their number grows
with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import checkpointed

HUBS = 1000


def _with_least(ends: DataFrame, ends_count: int) -> DataFrame:
    """ends (u, v) with m, the smallest v of each u."""
    least = ends.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    hub = F.col("degree") > max(HUBS, ends_count // HUBS)
    hubs = least.where(hub).select("u", F.col("m").alias("hub_m"))  # at most HUBS rows
    marked = ends.join(F.broadcast(hubs), "u", "left")
    rest = marked.where("hub_m IS NULL").select("u", "v").join(least.where(~hub).select("u", "m"), "u")
    return rest.union(marked.where("hub_m IS NOT NULL").select("u", "v", "hub_m"))


def _large_star(links: DataFrame, count: int) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * count).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(links: DataFrame, count: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    moved = _with_least(down, count).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (u, v) -> (id, component): the smallest id reachable, for every id that is not its own.
    Links may repeat, run either way or from a node to itself; no links give no rows."""
    state = None
    now = links.select("u", "v")
    count = now.count()
    for _ in range(rounds):
        large = checkpointed(_large_star(now, count))
        now = checkpointed(_small_star(large, large.count()))
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state, count = tuple(got), got[0]
    raise ValueError(f"components did not settle in {rounds} rounds")
