"""Tables in page text: parsing, structure flags, column headers. Cells are in compatibility composition."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Sequence
from html.parser import HTMLParser
from math import isfinite

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.functions.figures import figures, row_years, upper_median, years
from pagetally.functions.text import lines_of
from pagetally.operators.gathered import flat

# What HTML takes larger spans for.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
GRID = T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))


class _Grid(HTMLParser):
    """Tables of an HTML text as full grids: a cell that spans rows or columns is repeated where it reaches."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"rows": [], "row": None, "cell": None, "down": {}})
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                self._row(t)
                t["row"] = []
            elif tag in ("td", "th"):
                self._cell(t)
                span = {k: int(v) for k, v in attrs if k in ("rowspan", "colspan") and v and v.isdigit()}
                t["cell"] = ([], max(1, min(span.get("colspan", 1), MOST_COLUMNS)), max(1, min(span.get("rowspan", 1), MOST_ROWS)))
                if t["row"] is None:
                    t["row"] = []
            elif tag == "br" and t["cell"]:
                t["cell"][0].append(" ")

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][0].append(data)

    def handle_endtag(self, tag):
        if not self.open:
            return
        t = self.open[-1]
        if tag in ("td", "th"):
            self._cell(t)
        elif tag == "tr":
            self._row(t)
        elif tag == "table":
            self._row(t)
            self.open.pop()
            if t["rows"]:
                self.tables.append(t["rows"])

    def _fill(self, t):
        while t["down"].get(len(t["row"]), (0, ""))[0] > 0:
            left, text = t["down"][len(t["row"])]
            t["down"][len(t["row"])] = (left - 1, text)
            t["row"].append(text)

    def _cell(self, t):
        if not t["cell"]:
            return
        parts, wide, tall = t["cell"]
        t["cell"] = None
        text = " ".join("".join(parts).split())
        self._fill(t)
        for _ in range(wide):
            if tall > 1:
                t["down"][len(t["row"])] = (tall - 1, text)
            t["row"].append(text)

    def _row(self, t):
        self._cell(t)
        if t["row"] is not None:
            self._fill(t)
            t["rows"].append(t["row"])
            t["row"] = None


# Plain tables: whole tags of these names, attributes in quotes or without, no entities, comments or other marks.
_ATTRIBUTE = r"""\s+([a-zA-Z]+)=(?:'([^'<>&]*)'|"([^"<>&]*)"|([^\s'"<>&=`/]+))"""
_TOKEN = re.compile(r"""<(/?)(table|thead|tbody|tr|td|th|br)((?:\s+[a-zA-Z]+=(?:'[^'<>&]*'|"[^"<>&]*"|[^\s'"<>&=`/]+))*)>|([^<&]+)""", re.IGNORECASE)


def _plain_grid(text: str) -> _Grid | None:
    """The grid of a text with plain tags alone, read tag by tag; None where the parser has to read it."""
    if "&" in text:
        return None
    tokens = _TOKEN.finditer(text)
    grid, at = _Grid(), 0
    start, end, data = grid.handle_starttag, grid.handle_endtag, grid.handle_data
    for token in tokens:
        if token.start() != at:
            return None
        at = token.end()
        closing, tag, attributes, words = token.groups()
        if words is not None:
            data(words)
        elif closing:
            if attributes:
                return None
            end(tag.lower())
        else:
            start(tag.lower(), [(k.lower(), a or b or c) for k, a, b, c in re.findall(_ATTRIBUTE, attributes)] if attributes else ())
    return grid if at == len(text) else None


def parse_tables(text: str) -> list[list[list[str]]]:
    """HTML tables, or else runs of lines with bars (a rule of dashes is no row, emphasis marks go)."""
    if "<table" in text.lower():
        grid = _plain_grid(text)
        if grid is None:
            grid = _Grid()
            grid.feed(text)
            grid.close()
        while grid.open:  # an output may break off inside a table
            grid.handle_endtag("table")
        return grid.tables
    out: list[list[list[str]]] = []
    run: list[list[str]] = []
    for line in [*text.split("\n"), ""]:
        cells = [c.strip().strip("*").strip() for c in line.strip().strip("|").split("|")]
        if "|" in line and (len(cells) > 1 or line.strip().startswith("|")):
            if not all(re.fullmatch(r":?-{2,}:?|", c) for c in cells):
                run.append(cells)
        elif run:
            out.append(run)
            run = []
    return out


def table_cells(pages: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, table_no, row_no, col_no, cell) of all tables of all pages. Cells leave Python as rows, not as nested
    arrays. Tables that span rows and columns repeat the cell."""
    kinds = dict(pages.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in key) + "table_no int, row_no int, col_no int, cell string"
    names = [*key, "table_no", "row_no", "col_no", "cell"]

    def run(batches):
        for batch in batches:
            page, at, cells = [], [], []
            for i, value in enumerate(batch.column(len(key)).to_pylist()):
                for t, grid in enumerate(parse_tables(unicodedata.normalize("NFKC", value)) if value else []):
                    for r, row in enumerate(grid):
                        for c, cell in enumerate(row):
                            page.append(i), at.append((t, r, c)), cells.append(cell)
            place = np.array(at, np.int32).reshape(-1, 3)
            taken = pa.array(page, pa.int64())
            yield pa.record_batch([*[batch.column(k).take(taken) for k in range(len(key))], *[pa.array(x) for x in place.T.copy()], pa.array(cells, pa.string())], names=names)

    return pages.select(*key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def _nested(sizes: list[list[int]], flat: pa.Array) -> pa.Array:
    """Lists of lists of ... of the flat values; sizes from the outermost level on."""
    for lengths in reversed(sizes):
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]), pa.int32()), flat)
    return flat


@F.arrow_udf(GRID)
def tables(text: pa.Array) -> pa.Array:
    page, table, row, cells = [], [], [], []  # flat, as nested objects take many times their memory
    for t in text.to_pylist():
        grids = [] if t is None else parse_tables(unicodedata.normalize("NFKC", t))
        page.append(len(grids))
        for grid in grids:
            table.append(len(grid))
            for r in grid:
                row.append(len(r))
                cells += r
    return _nested([page, table, row], pa.array(cells, pa.string()))


def cell_value(cell: Column) -> Column:
    """A cell's figure if it holds exactly one, else null. Cells are composed text."""
    one = F.transform(F.array(figures(cell, compose=False)), lambda found: F.when(F.size(found) == 1, F.get(found, 0)))  # looked for once
    return F.get(one, 0)


# The texts of the flags.
LOSS = "column_loss(median %d value cols, %d periods, %d rows)"
NO_STRUCTURE = "no_structure(%d figures, %d numeric rows)"


def structure_flags(text: Column, grids: Column) -> Column:
    """struct(years, expected, figures, table_rows, flags) of a text in compatibility composition (``nfkc``) and its tables.

    ``column_loss``: of a table of five rows or more, the rows with large values have fewer of them (upper
    median) than the page has periods. ``no_structure``: no table, thirty or more large values, but fewer
    rows with two of them than a quarter of their number."""
    lines = lines_of(text)
    found = years(text)
    expected = F.when(F.size(found) >= 2, 2).otherwise(1)
    big = lambda c: F.filter(figures(c, compose=False), lambda v: F.abs(v) >= 1000)
    large = F.flatten(F.transform(lines, big))
    tall = F.filter(grids, lambda t: F.size(t) >= 5)
    in_row = lambda r: F.size(F.filter(r, lambda c: F.coalesce(F.abs(cell_value(c)) >= 1000, F.lit(False))))
    per_table = F.transform(tall, lambda t: F.struct(upper_median(F.filter(F.transform(t, in_row), lambda n: n > 0)).alias("median"), F.size(t).alias("rows")))
    lost = F.filter(per_table, lambda t: t["median"] < expected)
    loss = F.transform(lost, lambda t: F.format_string(LOSS, t["median"], expected, t["rows"]))
    wide_lines = F.size(F.filter(lines, lambda s: F.size(big(s)) >= 2))
    loose = (F.size(grids) == 0) & (F.size(large) >= 30) & (wide_lines < F.size(large) / 4)
    none = F.when(loose, F.array(F.format_string(NO_STRUCTURE, F.size(large), wide_lines))).otherwise(F.array().cast("array<string>"))
    rows = F.aggregate(tall, F.lit(0), lambda s, t: s + F.size(t))
    return F.struct(found.alias("years"), expected.alias("expected"), F.size(large).alias("figures"), rows.alias("table_rows"), F.concat(loss, none).alias("flags"))


def blank_header(cols: Column) -> Column:
    """There is a header and all of its cells are blank."""
    return (F.size(cols) > 0) & ~F.exists(cols, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")


def table_years(page_years: Column, rows: Column) -> Column:
    """The page's first two years, else those of the first of four rows that has nothing but two or more."""
    in_rows = F.filter(F.transform(F.slice(rows, 1, 4), row_years), lambda y: F.size(y) >= 2)
    return F.when(F.size(page_years) >= 2, F.slice(page_years, 1, 2)).otherwise(F.transform(F.slice(F.coalesce(F.get(in_rows, 0), F.array().cast("array<double>")), 1, 2), lambda y: y.cast("int")))


# Header words of the reports (item, note, the two currencies).
ITEM, NOTE, RIYAL, DOLLAR = "البند", "إيضاح", "ريال", "دولار"


def year_headers(cols: Column, rows: Column, two_years: Column, dual: Column) -> Column:
    """struct(cols, rows): a table without header gets item, note and its years in turn; with two currencies
    and four value columns or more the years come once for each. Rows of nothing but years go. Tables with
    a header, under three columns or without years keep theirs (a blank header becomes null)."""
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    values = F.greatest(width - 2, F.lit(0))
    y = F.transform(two_years, lambda v: v.cast("string"))
    plain = F.transform(F.sequence(F.lit(0), F.greatest(values - 1, F.lit(0))), lambda k: F.get(y, k % 2))
    in_currency = lambda name: F.transform(y, lambda v: F.concat(v, F.lit(" " + name)))
    four = F.concat(in_currency(RIYAL), in_currency(DOLLAR))
    heads = F.when(dual & (values >= 4), F.slice(four, 1, F.least(values, F.lit(4)))).otherwise(F.slice(plain, 1, values))
    made = F.concat(F.array(F.lit(ITEM), F.lit(NOTE)), heads, F.array_repeat(F.lit(""), values - F.size(heads)))
    missing = cols.isNull() | (F.size(cols) == 0) | blank_header(cols)
    ready = missing & (width >= 3) & (F.size(two_years) >= 2)
    kept = F.filter(rows, lambda r: F.size(row_years(r)) == 0)
    return F.struct(F.when(ready, made).when(~missing, cols).alias("cols"), F.when(ready, kept).otherwise(rows).alias("rows"))


def count_relations(table: list[list[float | None]], tolerance: float = 1.0) -> int:
    """Cells of a thousand or more that are the sum of two or more cells directly above them in their column,
    however many. The rule is this library's own: a page that was read well shows more of its totals. The sums
    of a column's beginnings are kept in order, so each total is one search among them."""
    width = max(map(len, table), default=0)
    found = 0
    for c in range(width):
        before: list[float] = []  # sums of the figures above, without the last two, in order
        last: list[float] = [0.0]  # sums of the figures so far, in the column's order
        for row in table:
            value = row[c] if c < len(row) else None
            if value is None:
                continue
            if len(last) > 2:
                bisect.insort(before, last[-3])
            if abs(value) >= 1000 and before:
                # the figures from some beginning on add up to value
                at = bisect.bisect_left(before, last[-1] - value - tolerance)
                found += at < len(before) and before[at] <= last[-1] - value + tolerance
            last.append(last[-1] + value)
    return found


@F.arrow_udf(T.LongType())
def _relations(values: pa.Array) -> pa.Array:
    grids = flat(values)
    rows = flat(grids)
    figures = flat(rows).cast(pa.float64()).to_pylist()
    lengths = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
    out, at = [], 0
    wide = iter(lengths(rows))
    tall = iter(lengths(grids))
    for count in lengths(values):
        found = 0
        for _ in range(count):
            table = []
            for _ in range(next(tall)):
                width = next(wide)
                table.append([None if v is None or not isfinite(v) else v for v in figures[at : at + width]])
                at += width
            found += count_relations(table)
        out.append(found)
    return pa.array(out, pa.int64())


def relations(values: Column) -> Column:
    """Relations of all of a page's tables, given as arrays of rows of values."""
    return _relations(values)


def grid_values(grids: Column) -> Column:
    """Tables of cells as tables of figures; null where a cell has none."""
    return F.transform(grids, lambda t: F.transform(t, lambda r: F.transform(r, cell_value)))
