"""Nearest matches in sorted order, and where labels of a page stand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetally.operators.facts import offset_class


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, carry: Sequence[str] = ()) -> DataFrame:
    """left with ``distance`` to the nearest right row of its keys (right's ``at`` less left's; null if there is none) and
    right's ``carry`` columns there. Of two that are equally near the one before counts; of right rows at one place the one with
    the smallest carried values. Both sides stand in one sorted sequence, in which the last right row before and
    the first one from there on are carried along: no row meets all others of its keys. A null place is nowhere."""
    names = left.columns
    what = F.struct(F.col(at).cast("bigint").alias("_at"), *carry)
    there = right.where(F.col(at).isNotNull()).groupBy(*keys, F.col(at).cast("bigint").alias("_pos")).agg(F.min(what).alias("_there"))
    mine = left.select("*", F.col(at).cast("bigint").alias("_pos"))
    none = F.lit(None).cast(there.schema["_there"].dataType)
    both = mine.withColumns({"_there": none, "_mine": F.lit(True)}).unionByName(there.withColumn("_mine", F.lit(False)), allowMissingColumns=True)
    group = Window.partitionBy(*keys).orderBy("_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rest = Window.partitionBy(*keys).orderBy("_pos").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    seen = both.withColumns({"_before": F.last("_there", ignorenulls=True).over(group), "_after": F.first("_there", ignorenulls=True).over(rest)}).where("_mine")
    gap = lambda side: F.abs(F.col(f"{side}._at") - F.col("_pos"))
    known = F.col("_pos").isNotNull()
    pick = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.coalesce("_after", "_before"))
    chosen = seen.withColumn("_pick", F.when(known, pick))
    return chosen.select(*names, (F.col("_pick._at") - F.col("_pos")).alias("distance"), *[F.col(f"_pick.{c}").alias(c) for c in carry])


def misplaced_offsets(misplaced: DataFrame, lines: DataFrame, statement: Sequence[str], filing: Sequence[str]) -> DataFrame:
    """misplaced with ``distance`` and ``place``: where the label of a figure in a wrong row points.

    misplaced: statement, row (the figure's true line), label (what the output has beside it); lines: statement, row, label,
    heading (boolean). The nearest line of the statement with that label counts (of two equally near the one
    before). A label that only another statement of the filing has is "other statement"; one that no line of the filing
    has, a null one, or the figure's own line is "other cell"."""
    spot = nearest(misplaced, lines.where("label IS NOT NULL").select(*statement, "label", "row", "heading"), [*statement, "label"], "row", ["heading"])
    elsewhere = lines.where("label IS NOT NULL").select(*filing, "label").distinct().withColumn("_known", F.lit(True))
    out = spot.join(elsewhere, [*filing, "label"], "left")
    place = F.when(F.col("distance").isNull() & F.col("_known").isNull(), F.lit("other cell")).otherwise(offset_class(F.col("distance"), F.coalesce("heading", F.lit(False)) & (F.col("distance") != 0)))
    return out.select(*misplaced.columns, "distance", place.alias("place"))


def label_places(labels: DataFrame, cells: DataFrame, lines: DataFrame, page: Sequence[str]) -> DataFrame:
    """(page, labels_in_tables, labels_outside, labels_absent): of each page's true labels those that its tables hold, those
    that only other lines hold, and the rest. labels, cells, lines: page, label (keys of labels; of table cells; of lines)."""
    once = lambda t, name: t.where("label IS NOT NULL").select(*page, "label").distinct().withColumn(name, F.lit(True))
    found = labels.select(*page, "label").join(once(cells, "_cell"), [*page, "label"], "left").join(once(lines, "_line"), [*page, "label"], "left")
    inside, outside = F.col("_cell").isNotNull(), F.col("_cell").isNull() & F.col("_line").isNotNull()
    return found.groupBy(*page).agg(F.count_if(inside).alias("labels_in_tables"), F.count_if(outside).alias("labels_outside"), F.count_if(~inside & ~outside).alias("labels_absent"))


def overlaps(boxes: DataFrame, lines: DataFrame, page: Sequence[str], cell: float = 64.0) -> DataFrame:
    """(page, box, line, share): pairs of a page that overlap, and the share of the line's area in the box.

    boxes: page, box, x0, y0, x1, y1; lines: page, line, x0, y0, x1, y1. Both are dealt to the squares of ``cell``
    that they touch and meet by page and square, so a page with very many of them is split; a pair that shares several
    squares counts in the one of the upper left corner of its overlap. Boxes without area or with a null or infinite side overlap nothing."""
    sides = ["x0", "y0", "x1", "y1"]

    def dealt(t: DataFrame, name: str, mark: str) -> DataFrame:
        good = F.lit(True)
        for s in sides:
            good = good & F.col(s).isNotNull() & (F.abs(F.col(s).cast("double")) < float("inf")) & ~F.isnan(F.col(s).cast("double"))
        real = t.where(good & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
        upto = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("bigint"), (F.ceil(F.col(b) / cell) - 1).cast("bigint"))
        row = real.select(*page, F.col(name), *[F.col(s).cast("double").alias(mark + s) for s in sides], F.explode(upto("x0", "x1")).alias("_cx"), F.struct("y0", "y1").alias("_y"))
        return row.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_y.y0") / cell).cast("bigint"), (F.ceil(F.col("_y.y1") / cell) - 1).cast("bigint")))).drop("_y")

    met = dealt(boxes, "box", "b").join(dealt(lines, "line", "l"), [*page, "_cx", "_cy"])
    left, top = F.greatest("bx0", "lx0"), F.greatest("by0", "ly0")
    wide, tall = F.least("bx1", "lx1") - left, F.least("by1", "ly1") - top
    own = (F.floor(left / cell) == F.col("_cx")) & (F.floor(top / cell) == F.col("_cy"))
    area = (F.col("lx1") - F.col("lx0")) * (F.col("ly1") - F.col("ly0"))
    return met.where((wide > 0) & (tall > 0) & own).select(*page, "box", "line", (wide * tall / area).alias("share"))
