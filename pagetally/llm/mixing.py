"""Mixing sources to target weights: capped water-filling and seeded repetitions.

1. *Sizes.* Texts are read once; a row's size is its number of words. A checkpoint keeps ids, sources, sizes and a
   seeded key: a number from SHA-256 of the seed and the id.
2. *Targets.* Sources in the order of their code points (null last) have the weights in turn. A source gets level *
   weight words, but at most ``epochs`` times its size; sources above that are clamped, and what they leave is shared by
   the weights of the others until none is above. The clamped sources follow from the level alone and it only rises, so
   a round is one aggregate over the table of sources, and the driver holds one number.
3. *Whole repetitions.* Each row of a source is taken floor(target / size) times.
4. *The fraction.* What is left goes to the rows with the smallest keys: each once more as a whole, and the row at the
   boundary in part, so a source's words differ from its target by rounding alone. The boundary is an order
   statistic: sums by 256 ranges of keys (combined before the shuffle) name the range where it lies, then 256 parts of
   that range, and so on; only rows with the last range's key prefix meet in a window. No source, whatever
   its share, is sorted or gathered.

Defined results: words are runs of other characters than ASCII white space; null, empty and blank texts have size 0 and
are taken 0 words; a text of any length is counted whole. A null source is a source. Rows without id share one key. Rows with
equal key, id and size are taken alike: where the boundary falls among m of them each gets the m-th part, rounded down, so
there up to m words are missing. A source without words has the target 0. Columns but id, text and source are ignored.
An empty table gives an empty result. The same rows and seed give the same result in whatever order or partition they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetally.llm.common import checkpointed
from pagetally.operators.ranks import ranked

BITS, STEPS, KEY = 8, 4, 60  # of a key: looked at in a step; steps; all
SMALL = 8 << 20


def sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, key)"""
    key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, KEY // 4), 16, 10).cast("bigint")
    words = F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("bigint").alias("size"), key.alias("key"))


def water_level(sources: DataFrame, budget: float) -> float:
    """sources (weight, cap): the level at which the words of all, least(cap, level * weight), come to ``budget``; infinite
    if every source is clamped. Sources above their caps are clamped, and the rest is shared again until none is above."""
    level = 0.0
    while True:
        free = F.col("cap") > F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(free, F.col("weight"))).alias("weight"), F.sum(F.when(~free, F.col("cap"))).alias("cap")).first()
        if not row.weight:
            return float("inf")
        new = (budget - (row.cap or 0)) / row.weight
        if new <= level:
            return level
        level = new


def targets(totals: DataFrame, weights: list[int], share: float, epochs: int) -> DataFrame:
    """totals (source, source_size) -> with target, in words. ``share`` of all words are wanted."""
    rows = ranked(totals, [], [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    rows = checkpointed(rows.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("cap")))
    budget = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level = water_level(rows, budget)
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")) if level != float("inf") else F.col("cap").cast("double")
    return rows.select("source", "source_size", target.alias("target"))


def _small(sources: DataFrame):
    """How tables with a row for each source meet the documents: they are sent to all tasks if their names come to
    ``SMALL`` bytes at most, at 100 bytes a row beside; more sources are joined by a shuffle, whose hot keys adaptive execution splits."""
    row = sources.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 100).alias("bytes")).first()
    return F.broadcast if (row.bytes or 0) <= SMALL else lambda table: table


def _boundaries(rows: DataFrame, wanted: DataFrame, sent) -> DataFrame:
    """wanted (source, rest): words to take in the order of (key, id, size). The place where they end: (source,
    at_key, at_id, at_size, part), each row there giving ``part`` words; a source whose rest is 0 has no place."""
    state = wanted.where("rest > 0").select(F.col("source").alias("_s"), F.lit(0).cast("bigint").alias("prefix"), "rest")
    left = KEY
    for _ in range(STEPS):
        left -= BITS
        here = rows.join(sent(state), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("key", left + BITS) == F.col("prefix")))
        sums = here.groupBy("source", F.shiftright("key", left).alias("cell"), "rest").agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        cells = sums.select("source", "cell", "rest", "size", upto.alias("upto")).where("upto >= rest AND upto - size < rest")
        state = checkpointed(cells.select(F.col("source").alias("_s"), F.col("cell").alias("prefix"), (F.col("rest") - (F.col("upto") - F.col("size"))).alias("rest")))
    here = rows.join(sent(state), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("key", left) == F.col("prefix")))
    alike = here.groupBy("source", "key", "id", "size", "rest").agg(F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    last = alike.withColumn("upto", F.sum(F.col("size") * F.col("m")).over(order)).where("upto >= rest AND upto - size * m < rest")
    part = F.expr("(rest - (upto - size * m)) div m")
    return last.select("source", F.col("key").alias("at_key"), F.col("id").alias("at_id"), F.col("size").alias("at_size"), part.alias("part"))


def mix(docs: DataFrame, weights: list[int], share: float = 1.0, epochs: int = 3, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, source, size, source_size, target, whole, taken): ``whole`` times each row's words are in the mix, and
    those that make up ``taken`` words beside."""
    if not weights or min(weights) <= 0 or epochs < 1 or share < 0:
        raise ValueError("weights must be positive, epochs one or more, and the share not negative")
    rows = checkpointed(sized(docs, seed, id_col, text_col, source_col))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = plan.withColumn("whole", whole)
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("bigint")
    plan = checkpointed(plan.withColumn("rest", rest))
    sent = _small(plan)
    ends = _boundaries(rows.where("size > 0"), plan.select("source", "rest"), sent)
    plan = plan.join(ends.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_s")
    place, end = (F.struct(F.col(p + "key").alias("k"), F.col(p + "id").isNull().alias("none"), F.col(p + "id").alias("id"), F.col(p + "size").alias("size")) for p in ("", "at_"))
    more = F.when(F.col("at_key").isNull(), F.lit(0)).when(place < end, F.col("size")).when(place.eqNullSafe(end), F.col("part")).otherwise(F.lit(0))
    out = rows.join(sent(plan), F.col("source").eqNullSafe(F.col("_s")))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "whole", (F.col("whole") * F.col("size") + more).cast("bigint").alias("taken"))
