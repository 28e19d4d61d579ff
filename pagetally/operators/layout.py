"""Page geometry: blocks from stored outputs, bands of blocks, rows of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetally.functions.text import strip_tags

# The form of positioned divisions, and of a block in a list.
BLOCK = "struct<bbox: array<double>, category: string, text: string>"
DIV = r'(?s)<div\s+data-bbox="(\d+)\s+(\d+)\s+(\d+)\s+(\d+)"\s+data-label="([^"]+)">(.*?)</div>'
# Label spellings of one producer and their common form.
SPELLING = {"Section-Header": "Section-header", "Page-Header": "Page-header", "Page-Footer": "Page-footer"}


def blocks(raw: Column) -> Column:
    """Blocks of an output: a JSON list, else at least two positioned divisions, else null."""
    inside = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    from_list = F.from_json(F.when(inside != "", inside), f"array<{BLOCK}>")
    from_list = F.when(F.size(from_list) > 0, from_list)
    parts = F.regexp_extract_all(raw, F.lit(DIV), F.lit(0))

    def block(d):
        part = lambda k: F.regexp_extract(d, DIV, k)
        label = part(5)
        for a, b in SPELLING.items():
            label = F.replace(label, F.lit(a), F.lit(b))
        return F.struct(F.array(*[part(k).cast("double") for k in range(1, 5)]).alias("bbox"), label.alias("category"), part(6).alias("text"))

    return F.coalesce(from_list, F.when(F.size(parts) >= 2, F.transform(parts, block)))


def exploded(pages: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, ord, x0, y0, x1, y1, category, text), one row a block; pages without blocks have none."""
    b = pages.select(key, F.posexplode(blocks(F.col(raw))).alias("ord", "b"))
    box = [F.get("b.bbox", k).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
    return b.select(key, "ord", *box, F.col("b.category").alias("category"), F.col("b.text").alias("text"))


def bands(rows: DataFrame, key: str, tolerance: float = 0.6) -> DataFrame:
    """Adds ``band``: blocks go on in a band while the centre lies within tolerance of the smaller of
    their own and the preceding block's height, and neither is a table. rows: as ``exploded``."""
    down = Window.partitionBy(key).orderBy("cy", "ord")
    placed = rows.withColumns({"cy": (F.col("y0") + F.col("y1")) / 2, "h": F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))})
    before = lambda c: F.lag(c).over(down)
    table = lambda c: F.coalesce(c == "Table", F.lit(False))
    joins = (F.abs(F.col("cy") - before("cy")) < tolerance * F.least("h", before("h"))) & ~table(F.col("category")) & ~table(before("category"))
    flagged = placed.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return flagged.withColumn("band", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def render(rows: DataFrame, key: str) -> DataFrame:
    """(key, text): bands below each other; a band's blocks from right to left, two blanks between; a lone table as it is."""
    cells = F.array_sort(F.collect_list(F.struct((-F.col("x0")).alias("x"), F.col("cy"), F.col("ord"), F.coalesce("text", F.lit("")).alias("t"), F.col("category").alias("c"))))
    band = rows.groupBy(key, "band").agg(cells.alias("cells"))
    lone = (F.size("cells") == 1) & F.coalesce(F.get("cells", 0)["c"] == "Table", F.lit(False))
    line = F.when(lone, F.get("cells", 0)["t"]).otherwise(F.array_join(F.transform("cells", lambda b: strip_tags(b["t"])), "  "))
    lines = F.array_sort(F.collect_list(F.struct("band", line.alias("line"))))
    return band.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def merged_pages(pages: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, text): every page's merged rendering; a page without blocks keeps its raw text."""
    text = render(bands(exploded(pages, key, raw), key), key).withColumnRenamed("text", "merged")
    return pages.select(key, raw).join(text, key, "left").select(key, F.coalesce("merged", raw).alias("text"))


def cluster_rows(boxes: Column, tolerance: float = 0.6) -> Column:
    """Lines from text boxes (array of struct x0, y0, x1, y1, t), cells from right to left between bars.
    The row's centre moves half-way to each box that joins it, so this is a fold and not a window."""
    height = F.array_sort(F.transform(boxes, lambda b: b["y1"] - b["y0"]))
    n = F.size(height)
    middle = (F.get(height, F.floor((n - 1) / 2).cast("int")) + F.get(height, F.floor(n / 2).cast("int"))) / 2
    ordered = F.array_sort(F.transform(boxes, lambda b, i: F.struct(((b["y0"] + b["y1"]) / 2).alias("c"), i.alias("i"), b["x0"].alias("x"), b["t"].alias("t"))))
    cell = "struct<x: double, c: double, i: int, t: string>"
    start = F.struct(F.lit(None).cast("double").alias("cy"), F.array().cast(f"array<array<{cell}>>").alias("rows"))

    def step(state, b):
        one = F.struct((-b["x"]).cast("double").alias("x"), b["c"].cast("double").alias("c"), b["i"].alias("i"), b["t"].alias("t"))
        near = state["cy"].isNotNull() & (F.abs(b["c"] - state["cy"]) <= tolerance * middle)
        rows = state["rows"]
        grown = F.concat(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), F.array(F.array_append(F.get(rows, F.size(rows) - 1), one)))
        return F.struct(
            F.when(near, (state["cy"] + b["c"]) / 2).otherwise(b["c"]).cast("double").alias("cy"),
            F.when(near, grown).otherwise(F.array_append(rows, F.array(one))).alias("rows"),
        )

    rows = F.aggregate(ordered, start, step)["rows"]
    return F.transform(rows, lambda r: F.array_join(F.transform(F.array_sort(r), lambda x: x["t"]), " | "))


def polygon_box(xs: Column, ys: Column) -> Column:
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def crop_box(rows: DataFrame, key: str, height: str, margin: int = 30) -> DataFrame:
    """(key, top, bottom) from the first table down to the last table or text above the pictures of the
    lower half. rows: key, height, label, y0, y1. Pages without a table have no row."""
    cy = (F.col("y0") + F.col("y1")) / 2
    at = rows.withColumn("cy", cy)
    first = at.groupBy(key).agg(
        F.min(F.when(F.col("label") == "table", F.col("y0"))).alias("top"),
        F.min(F.when((F.col("label") == "picture") & (F.col("cy") > F.col(height) * 0.5), F.col("cy"))).alias("picture"),
        F.max(height).alias("page_height"),
    )
    limits = first.where("top IS NOT NULL").withColumn("cut", F.coalesce("picture", F.col("page_height") * 0.97))
    inside = at.join(limits, key).where(F.col("label").isin("table", "text") & (F.col("cy") >= F.col("top")) & (F.col("cy") < F.col("cut")))
    low = inside.groupBy(key).agg(F.max("y1").alias("low"))
    out = limits.join(low, key)
    return out.select(key, F.greatest(F.lit(0.0), F.col("top") - margin).cast("int").alias("top"), F.least(F.col("page_height"), F.col("low") + margin).cast("int").alias("bottom"))


def fit_pixels(width: Column, height: Column, most: int, least: int, grid: int = 28) -> Column:
    """Page size in whole cells of a grid, within a pixel range: struct(width, height).

    The page is scaled to the range, each side rounded to cells (half to even), and while the cells are still too
    many, the side goes down by one whose loss changes the ratio of the sides less; a side of one cell stays."""
    ratio, area = width / height, width * height
    scale = F.when(area > most, F.sqrt(F.lit(float(most)) / area)).when(area < least, F.sqrt(F.lit(float(least)) / area)).otherwise(1.0)
    cells = lambda x: F.greatest(F.lit(1), F.bround(x * scale / grid).cast("int"))
    start = F.struct(cells(width).alias("w"), cells(height).alias("h"))

    def down(state, _):
        w, h = state["w"], state["h"]
        fit = F.lit(most // (grid * grid))  # of a side that alone can go down
        w, h = F.when(h == 1, F.least(w, F.greatest(fit, F.lit(1)))).otherwise(w), F.when(w == 1, F.least(h, F.greatest(fit, F.lit(1)))).otherwise(h)
        over = (w * h * grid * grid > most) & ((w > 1) | (h > 1))
        loses_width = (h == 1) | (w > 1) & (F.abs((w - 1) / h - ratio) < F.abs(w / F.nullif(h - 1, F.lit(0)) - ratio))
        return F.struct(F.when(over & loses_width, w - 1).otherwise(w).alias("w"), F.when(over & ~loses_width, h - 1).otherwise(h).alias("h"))

    # rounding up both sides adds at most half a cell to each, so no more steps than a side has are needed; 64 are
    # more than pages of up to a thousand cells a side take
    end = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, down)
    return F.struct((end["w"] * grid).alias("width"), (end["h"] * grid).alias("height"))
