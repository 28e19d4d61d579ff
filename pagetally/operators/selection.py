"""Choosing between readings of a page."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.functions.figures import distinct_figures, figures, financial
from pagetally.functions.text import lines_of, nfkc
from pagetally.operators.gathered import codes, flat, owners, places, ranges
from pagetally.operators.tables import grid_values, relations, tables


def best_reading(readings: DataFrame, key: Sequence[str], scores: Sequence[str], order: str, payload: Sequence[str]) -> DataFrame:
    """For each key the payload with the lexicographically largest scores; the first in order on ties."""
    top = F.max_by(F.struct(*payload), F.struct(*scores, (-F.col(order)).alias("_first")))
    return readings.groupBy(*key).agg(top.alias("b")).select(*key, *[F.col(f"b.{p}").alias(p) for p in payload])


def page_features(pages: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """(key, relations, rows, figures) of each reading: sums that hold in its tables, lines with two numbers or more,
    and different amounts that are large or have decimals."""
    composed = pages.select(*key, nfkc(F.col(text)).alias("_text"))
    per_line = F.transform(lines_of(F.col("_text")), lambda s: figures(s, compose=False))
    read = composed.select(*key, relations(grid_values(tables(F.col("_text")))).alias("relations"), per_line.alias("_lines"))
    return read.select(*key, "relations", F.size(F.filter("_lines", lambda v: F.size(v) >= 2)).alias("rows"), distinct_figures(financial(F.flatten("_lines"))).alias("figures"))


def best_by_features(pages: DataFrame, key: Sequence[str], run: str, order: str, text: str = "text") -> DataFrame:
    """(key, run): of each page's readings the one with most relations, then rows, then figures; the first in order on ties."""
    features = page_features(pages, [*key, run, order], text)
    return best_reading(features, key, ["relations", "rows", "figures"], order, [run])


PAIRS = 1 << 20  # pairs of rows and lines that are compared at once


def _held(rows: pa.ListArray, times: pa.ListArray, lines: pa.ListArray) -> np.ndarray:
    """Of each page, how many of its rows some line holds whole. rows, lines: lists of multisets, as lists of (value, n); times: how
    often each row stands for. A row meets the lines that hold the rarest of its values there."""
    page, row_of, wanted = owners(rows), owners(flat(rows)), flat(flat(rows))
    line_page, line_of, given = owners(lines), owners(flat(lines)), flat(flat(lines))
    (value, n), (line_value, line_n) = wanted.flatten(), given.flatten()
    value, line_value = codes(value, line_value)
    n, line_n = (pc.fill_null(x, null).to_numpy(zero_copy_only=False) for x, null in ((n, np.iinfo(np.int64).max), (line_n, 0)))
    kinds = max(value.max(initial=0), line_value.max(initial=0)) + 1
    there = line_value >= 0
    line_of, line_value, line_n = line_of[there], line_value[there], line_n[there]
    by_page = np.argsort(line_page[line_of] * kinds + line_value, kind="stable")
    begin, often = places(np.where(value < 0, -1, page[row_of] * kinds + value), (line_page[line_of] * kinds + line_value)[by_page])
    rarest = np.lexsort((often, row_of))
    first = np.searchsorted(row_of, np.arange(len(page)))  # entries stand row by row
    begin, often = begin[rarest[first]], often[rarest[first]]
    size = np.bincount(row_of, minlength=len(page))
    by_line = np.argsort(line_of * kinds + line_value, kind="stable")
    keys, enough = (line_of * kinds + line_value)[by_line], line_n[by_line]
    found = np.zeros(len(page), bool)
    cuts = np.searchsorted(np.cumsum(often * size), np.arange(1, int((often * size).sum()) // PAIRS + 1) * PAIRS)
    for part in np.split(np.arange(len(page)), cuts):
        row, at = ranges(begin[part], often[part])
        row, line = part[row], line_of[by_page[at]]
        pair, entry = ranges(first[row], size[row])
        place, held = places(line[pair] * kinds + value[entry], keys)
        short = (value[entry] < 0) | (held == 0)
        short[~short] = enough[place[~short]] < n[entry[~short]]
        found[row[np.bincount(pair[short], minlength=len(row)) == 0]] = True
    hits = np.zeros(len(rows), np.int64)
    np.add.at(hits, page, found * times.flatten().to_numpy(zero_copy_only=False))
    return hits


def best_by_truth(rows: DataFrame, readings: DataFrame, key: Sequence[str], run: str, order: str) -> DataFrame:
    """(key, run, hits): of each page's readings the one whose lines hold most of the page's true rows.
    rows: key, row_id, value, n; readings: key, run, order, line_no, value, n (a reading without figures has no rows).

    A page's different rows, and a reading's different lines, are gathered into one row. Where both inputs are dealt by key
    (``dealt``) they meet without another exchange."""

    @F.arrow_udf("bigint")
    def hits(row: pa.Array, times: pa.Array, line: pa.Array) -> pa.Array:
        return pa.array(_held(row, times, line), pa.int64())

    kinds = dict(rows.dtypes)["value"], dict(readings.dtypes)["value"]
    value = F.col("value") if kinds[0] == kinds[1] else F.col("value").cast("double")
    pattern = F.array_sort(F.collect_list(F.struct(value.alias("value"), F.col("n").cast("bigint").alias("n"))))
    different = rows.groupBy(*key, "row_id").agg(pattern.alias("p")).groupBy(*key, "p").agg(F.count(F.lit(1)).alias("times"))
    wanted = different.groupBy(*key).agg(F.collect_list(F.struct("p", "times")).alias("_rows"))
    lines = readings.groupBy(*key, run, order, "line_no").agg(pattern.alias("p")).groupBy(*key, run, order).agg(F.collect_set("p").alias("_lines"))
    found = lines.join(wanted, list(key)).select(*key, run, order, hits(F.col("_rows.p"), F.col("_rows.times"), F.col("_lines")).alias("hits"))
    return best_reading(found, key, ["hits"], order, [run, "hits"])


def retry_ladder(originals: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """(key, chosen, figures): the original where it has no flags; else the first attempt by seed without
    flags; else the attempt with most figures, if more than the original's; else the original.
    originals: key, n_flags, figures; attempts: key, seed, n_flags, figures (null figures: no output)."""
    usable = attempts.where("figures IS NOT NULL")
    clean = usable.groupBy(key).agg(
        F.min_by(F.struct("seed", "figures"), F.when(F.col("n_flags") == 0, F.col("seed"))).alias("clean"),
        F.max_by(F.struct("seed", "figures"), F.struct("figures", -F.col("seed"))).alias("most"),
    )
    both = originals.join(clean, key, "left")
    flagged = F.col("n_flags") > 0
    chosen = F.when(flagged & F.col("clean").isNotNull(), F.struct(F.col("clean.seed").cast("string").alias("chosen"), F.col("clean.figures").alias("figures")))
    chosen = chosen.when(flagged & (F.col("most.figures") > F.col("figures")), F.struct(F.col("most.seed").cast("string").alias("chosen"), F.col("most.figures").alias("figures")))
    return both.select(key, chosen.otherwise(F.struct(F.lit("original").alias("chosen"), F.col("figures"))).alias("c")).select(key, "c.chosen", "c.figures")


def first_match(rows: DataFrame, key: Sequence[str], condition: str, order: str, payload: str) -> DataFrame:
    """(key, payload) of the first row in order that meets the condition."""
    return rows.where(condition).groupBy(*key).agg(F.min_by(payload, order).alias(payload))


def precedence(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """One row for each key: the one from the folder with the smallest rank."""
    names = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*names), F.col(rank))
    return rows.groupBy(key).agg(first.alias("f")).select(key, *[F.col(f"f.{c}").alias(c) for c in names])


def candidates(runs: DataFrame, rows: int = 173, figs: int = 366) -> DataFrame:
    """Runs that beat a baseline of rows, or tie it with enough figures; each name once, at its first place."""
    good = runs.where((F.col("rows") > rows) | (F.col("rows") == rows) & (F.col("figs") >= figs))
    return good.groupBy("name").agg(F.min("pos").alias("pos"))
