"""Rows of truth against lines of output, and table-level joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.functions.distance import Bigrams, Subsequences, best_windows, distance_grid, similarities
from pagetally.functions.text import normalise

UNLABELED = "unlabeled line"  # fixed value: a row's status


def with_truth(outputs: DataFrame, truth: DataFrame, key: Sequence[str]) -> DataFrame:
    """Outputs beside their truth; documents that only one side has go."""
    return outputs.join(truth, list(key))


def aligned_runs(first: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """Pages of the first run, with a column for each other run: its row (key aside) as a struct, null where it
    has no such page."""
    out = first
    for name, run in others.items():
        row = F.struct(*[c for c in run.columns if c != key]).alias(name)
        out = out.join(run.select(key, row), key, "left")
    return out


def in_line(figures: Column, line: Column) -> Column:
    """All figures occur in the line, however often."""
    return F.forall(figures, lambda f: F.array_contains(line, f))


def contained(rows: DataFrame, lines: DataFrame, group: Sequence[str], row: str = "row_id", line: str = "line_no") -> DataFrame:
    """(group, row, found): some single line holds all the row's values with their multiplicities.
    rows: group, row, value, n; lines: group, line, value, n. Each different row of a group meets only the lines
    that hold its rarest value there, and is compared with those as a whole."""
    pattern = lambda df, by: df.groupBy(*group, by).agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("pattern"))
    wanted, given = pattern(rows, row), pattern(lines, line)
    # Rows and lines with the same multiset behave alike: compare each multiset of a group once.
    need, have = (df.select(*group, "pattern").distinct() for df in (wanted, given))
    held = have.select(*group, "pattern", F.explode("pattern").alias("p")).select(*group, "p.value", F.col("pattern").alias("line"))
    often = held.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("often"))
    asked = need.select(*group, "pattern", F.explode("pattern").alias("p")).select(*group, "pattern", "p.value").join(often, [*group, "value"], "left")
    rarest = asked.groupBy(*group, "pattern").agg(F.min_by("value", F.struct(F.coalesce("often", F.lit(0)), "value")).alias("value"))
    counts = F.map_from_entries(F.transform("line", lambda x: F.struct(x["value"], x["n"])))
    holds = F.forall("pattern", lambda x: F.coalesce(F.try_element_at("counts", x["value"]) >= x["n"], F.lit(False)))
    full = rarest.join(held, [*group, "value"]).withColumn("counts", counts).where(holds).select(*group, "pattern").distinct()
    return wanted.join(full.withColumn("found", F.lit(True)), [*group, "pattern"], "left").select(*group, row, F.coalesce("found", F.lit(False)).alias("found"))


def _counted(values: pa.ListArray, codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, times) of each list's different values; nulls are left out."""
    owner = np.repeat(np.arange(len(values)), pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False))
    key, times = np.unique((owner * base + codes)[codes >= 0], return_counts=True)
    return key // base, key % base, times


#: Rows that so many lines may win are compared with all of them; with more, bounds tell which lines can win.
FEW_LINES = 64


def _ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of all places of ranges."""
    entry = np.repeat(np.arange(len(count)), count)
    return entry, np.arange(len(entry)) + np.repeat(begin - (np.cumsum(count) - count), count)


class _Closest:
    """The closest lines of rows, found so far: a row's line with the most similar text, the first of equal ones."""

    def __init__(self, labels: list[str], texts: list[str], pairs: int):
        self.labels, self.texts, self.pairs = labels, texts, pairs
        self.at, self.alike = np.full(len(labels), -1), np.zeros(len(labels))

    def _scores(self, owner: np.ndarray, line: np.ndarray) -> np.ndarray:
        place: dict[tuple[str, str], int] = {}
        which = [place.setdefault((self.labels[r], self.texts[k]), len(place)) for r, k in zip(owner.tolist(), line.tolist(), strict=True)]
        return best_windows([x for x, _ in place], [y for _, y in place])[which]

    def compare(self, owner: np.ndarray, line: np.ndarray) -> None:
        """Takes these pairs as all that the owners have."""
        if not len(owner):
            return
        score = self._scores(owner, line)
        best = np.lexsort((line, -score, owner))
        best = best[np.append(True, np.diff(owner[best]) > 0)]
        self.at[owner[best]], self.alike[owner[best]] = line[best], score[best]

    @cached_property
    def _bigrams(self) -> tuple[Bigrams, Bigrams]:
        return Bigrams(self.labels), Bigrams(self.texts)

    @cached_property
    def _text(self) -> np.ndarray:
        """A number for each line's text."""
        return pa.array(self.texts, pa.large_string()).dictionary_encode().indices.to_numpy()

    def different(self, lines: np.ndarray) -> np.ndarray:
        """The first lines of each text among lines in order."""
        return np.sort(lines[np.unique(self._text[lines], return_index=True)[1]])

    @cached_property
    def _subsequences(self) -> Subsequences:
        return Subsequences(self.texts)

    def search(self, owners: list[int], lines: list[np.ndarray]) -> None:
        """As ``compare`` of each owner and its different lines, without those that cannot win: whose bound by bigrams, or by
        common subsequences if many are left, is below the similarity of the lines with the highest bounds."""
        mine, theirs = self._bigrams
        likely = np.array([at[mine.bounds(r, theirs, at).argmax()] for r, at in zip(owners, lines, strict=True)])
        floor = self._scores(np.array(owners), likely)
        waiting, held = [], 0
        for k, (r, at) in enumerate(zip(owners, lines, strict=True)):
            at = at[mine.bounds(r, theirs, at) >= floor[k]]
            bound = self._subsequences.bounds(self.labels[r], at) if len(at) > FEW_LINES else np.full(len(at), np.inf)
            near = bound >= floor[k]
            waiting.append((r, at[near], bound[near]))
            held += np.count_nonzero(near)
            if held > self.pairs or k == len(owners) - 1:
                self._settle(waiting)
                waiting, held = [], 0

    def _settle(self, waiting: list[tuple[int, np.ndarray, np.ndarray]], first: int = 4) -> None:
        """Each owner's lines with the highest bounds, then those whose bound is no lower than the best of these."""
        top = [at[np.argpartition(-bound, first)[:first]] if len(at) > first else at for _, at, bound in waiting]
        pairs = lambda lines: (np.repeat([r for r, _, _ in waiting], [len(x) for x in lines]), np.concatenate(lines))
        self.compare(*pairs(top))
        self.compare(*pairs([at[bound >= self.alike[r]] for r, at, bound in waiting]))


def _against_lines(line_type: T.DataType, missed: bool, pairs: int = 1_000_000, few: int = FEW_LINES):
    """Of each group's rows and lines, these in order: every row's closest line, and whether a line holds the whole row. With
    ``missed`` texts are compared for rows that no line holds. A row meets the lines that share a value with it; of those that
    share most, or of all if none does, the text decides. So many pairs of row and line are looked at together."""
    found_type = T.StructType([T.StructField("held", T.BooleanType()), T.StructField("line", line_type), T.StructField("total", T.IntegerType()), T.StructField("present", T.LongType()), T.StructField("shared", T.IntegerType()), T.StructField("similarity", T.DoubleType())])

    @F.arrow_udf(T.ArrayType(found_type))
    def closest(label: pa.Array, wanted: pa.Array, line: pa.Array, text: pa.Array, given: pa.Array) -> pa.Array:
        n, m = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (label, line))
        group, line_group = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
        labels, texts, lines, wanted, given = label.flatten().to_pylist(), text.flatten().to_pylist(), line.flatten(), wanted.flatten(), given.flatten()
        figures = [x.flatten() for x in (wanted, given)]
        if pa.types.is_floating(figures[0].type):
            figures = [pc.add(x, 0.0) for x in figures]  # no negative zeros
        coded = pa.concat_arrays(figures).dictionary_encode()
        codes, base = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary) + 1
        row, code, times = _counted(wanted, codes[: len(figures[0])], base)
        in_line, line_code, line_times = _counted(given, codes[len(figures[0]) :], base)
        total = pc.list_value_length(wanted)
        size = pc.fill_null(total, 0).to_numpy(zero_copy_only=False)
        # What the lines of a group hold, by value: each of a row's values meets just those.
        where = line_group[in_line] * base + line_code
        order = np.argsort(where, kind="stable")
        where, in_line, line_times = where[order], in_line[order], line_times[order]
        asked = group[row] * base + code
        begin, end = np.searchsorted(where, asked), np.searchsorted(where, asked, "right")
        held_before = np.append(0, np.cumsum(line_times))
        present = np.bincount(row, np.minimum(times, held_before[end] - held_before[begin]), len(group)).astype(np.int64)
        shared, held = np.zeros(len(group), np.int32), np.zeros(len(group), bool)
        each, first_line = m[group], (np.cumsum(m) - m)[group]
        met = np.bincount(row, end - begin, len(group)).astype(np.int64)
        alone = met == 0  # rows that share nothing
        here = _Closest(labels, texts, pairs)
        part = np.cumsum(np.where(alone & (each <= few), each, met)) // pairs
        for rows in np.split(np.arange(len(group)), np.flatnonzero(np.diff(part)) + 1):
            if not len(rows):
                continue
            mine = slice(np.searchsorted(row, rows[0]), np.searchsorted(row, rows[-1], "right"))
            entry, there = _ranges(begin[mine], (end - begin)[mine])
            pair = row[mine][entry] * len(lines) + in_line[there]
            order = np.argsort(pair, kind="stable")
            pair, same = pair[order], np.minimum(times[mine][entry], line_times[there])[order]
            first = np.flatnonzero(np.append(True, np.diff(pair) > 0)[: len(pair)])
            pair, same = pair[first], np.add.reduceat(same, first) if len(first) else same
            owner, its_line = pair // max(1, len(lines)), pair % max(1, len(lines))
            np.maximum.at(shared, owner, same.astype(np.int32))
            held[rows] = (shared[rows] == size[rows]) & (shared[rows] > 0)
            tied = same == shared[owner]
            if missed:
                tied &= ~held[owner]
            owner, its_line = owner[tied], its_line[tied]
            wide = np.bincount(owner - rows[0], minlength=len(rows))[owner - rows[0]] > few
            begins = np.flatnonzero(np.append(True, np.diff(owner[wide]) > 0)[: wide.sum()])
            if len(begins):
                here.search(owner[wide][begins].tolist(), [here.different(x) for x in np.split(its_line[wide], begins[1:])])
            rest = rows[alone[rows] & (each[rows] <= few)]
            other, place = _ranges(first_line[rest], each[rest])
            here.compare(np.append(owner[~wide], rest[other]), np.append(its_line[~wide], place))
        # Rows that share nothing in groups of many lines: each label of a group once.
        asked_for: dict[tuple[int, str], list[int]] = {}
        for r in np.flatnonzero(alone & (each > few)).tolist():
            asked_for.setdefault((int(group[r]), labels[r]), []).append(r)
        if asked_for:
            ends = np.cumsum(m)
            of_group = {g: here.different(np.arange(ends[g] - m[g], ends[g])) for g in {g for g, _ in asked_for}}
            here.search([rows[0] for rows in asked_for.values()], [of_group[g] for g, _ in asked_for])
            for rows in asked_for.values():
                here.at[rows], here.alike[rows] = here.at[rows[0]], here.alike[rows[0]]
        at, alike = here.at, here.alike
        columns = [pa.array(held), lines.take(pa.array(at, mask=at < 0)), total.cast(pa.int32()), pa.array(present), pa.array(shared), pa.array(alike)]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.StructArray.from_arrays(columns, found_type.names))

    return closest


#: Pairs of a row and a line that one task compares; the rows of a group with more are split.
TASK_PAIRS = 50_000_000


def _rows_and_lines(rows: DataFrame, lines: DataFrame, group: Sequence[str], row: str, line: str, missed: bool) -> DataFrame:
    """(group, row, f): every row and what ``_against_lines`` finds. Rows and lines of a group meet in one place; the rows of a group
    of more than ``TASK_PAIRS`` pairs are dealt over several, each of which has all of the group's lines."""
    clean = lambda c: normalise(F.coalesce(c, F.lit(""))).alias(c)
    held = lines.dropna(subset=list(group))
    count = lambda df, name: df.groupBy(*group).agg(F.count(F.lit(1)).alias(name))
    pairs = count(rows, "_rows").join(count(held, "_lines"), list(group)).where(F.col("_rows") * F.col("_lines") > TASK_PAIRS)
    large = pairs.select(*group, F.ceil(F.col("_rows") * F.col("_lines") / TASK_PAIRS).cast("int").alias("_parts"))  # few: each stands for so many pairs
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(row), F.col("_parts"))).otherwise(0).cast("int").alias("_part")
    left = rows.join(large, list(group), "left").select(*group, part, F.struct(row, clean("label"), "values").alias("a"))
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part")
    right = held.join(large, list(group), "left").select(*group, parts, F.struct(line, clean("text"), "values").alias("b"))
    met = left.unionByName(right, allowMissingColumns=True).groupBy(*group, "_part").agg(F.collect_list("a").alias("a"), F.array_sort(F.collect_list("b")).alias("b"))
    found = _against_lines(lines.schema[line].dataType, missed)(*[F.col(c) for c in ("a.label", "a.values", f"b.{line}", "b.text", "b.values")])
    zipped = met.withColumn("f", found).select(*group, F.explode(F.arrays_zip(F.col(f"a.{row}").alias(row), F.col("f").alias("f"))).alias("z"))
    return zipped.select(*group, F.col(f"z.{row}").alias(row), "z.f")


def closest_line(rows: DataFrame, lines: DataFrame, group: Sequence[str], row: str = "row_id", line: str = "line_no") -> DataFrame:
    """(group, row, line, shared, similarity): the line with most shared values; similarity of the normalised label,
    then the first line break ties. rows: group, row, label, values; lines: group, line, text, values.
    Pairs are formed within a group only (a table and its pages); texts are compared where values tie."""
    f = _rows_and_lines(rows, lines, group, row, line, False).where("f.line IS NOT NULL")
    return f.select(*group, row, F.col("f.line").alias(line), "f.shared", "f.similarity")


def missed_rows(rows: DataFrame, lines: DataFrame, group: Sequence[str], row: str = "row_id", line: str = "line_no") -> DataFrame:
    """(group, row, line, total, present, shared, similarity, kind) of the rows that no line holds: how many figures they
    have, how many of them the group's lines hold together, and what that and the closest line say of the miss.
    rows and lines as in ``closest_line``; a row whose group has no lines is not found (line is null)."""
    f = _rows_and_lines(rows, lines, group, row, line, True).where("NOT f.held")
    out = f.select(*group, row, F.col("f.line").alias(line), *[f"f.{c}" for c in ("total", "present", "shared", "similarity")])
    return out.withColumn("kind", miss_class("total", "present", "shared", "similarity"))


def miss_class(total: str, present: str, shared: str, label_similarity: str):
    """Why a row was missed, in this order: its figures are all on the page but not in one line; some are
    missing from a line whose label fits; the label fits only; the row is not there."""
    fits = F.col(label_similarity) >= 80
    return (
        F.when((F.col(present) == F.col(total)) & (F.col(shared) < F.col(total)), "row split")
        .when((F.col(present) < F.col(total)) & fits & (F.col(shared) >= 1), "figure misread or dropped")
        .when(fits, "figures wrong or missing")
        .otherwise("row not found")
    )


def near_misses(missing: DataFrame, output: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, value, read_as): output values whose digits differ from a missing value's in one place.
    The join is on every digit string with one place masked, so no value meets all others."""
    digits = lambda c: F.format_string("%.0f", F.abs(c))
    masks = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.lit("?"), F.substring(c, i + 1, F.length(c))))
    a = missing.select(*group, "value", digits(F.col("value")).alias("d")).select(*group, "value", "d", F.explode(masks(F.col("d"))).alias("mask"))
    b = output.select(*group, F.col("value").alias("read_as"), digits(F.col("value")).alias("e")).select(*group, "read_as", "e", F.explode(masks(F.col("e"))).alias("mask"))
    return a.join(b, [*group, "mask"]).where("d <> e").select(*group, "value", "read_as").distinct()


def miss_report(misses: DataFrame, keys: Sequence[str], run: str) -> DataFrame:
    """(keys, missed, runs): how often and in which runs a row was missed, most often first."""
    return misses.groupBy(*keys).agg(F.count(F.lit(1)).alias("missed"), F.array_sort(F.collect_set(run)).alias("runs")).orderBy(F.desc("missed"), *keys)


def rescore(items: DataFrame, cells: DataFrame, tolerance: float) -> DataFrame:
    """(item, fact, unlabeled_line, header_changed): each checked item found again by page, label and absolute value;
    of several cells one with the same verdict goes first, else one on an unlabelled line; then the same header, then
    ord. A cell without status, verdict or header has none that equals another's, but two without header agree.
    items: item, page, label, value, header, old_fact; cells: page, label, value, header, fact, row_status, ord.
    Values meet in buckets as wide as the tolerance, so an item meets only cells near its own value."""
    c = cells.select("page", "label", F.col("value").alias("cell_value"), F.col("header").alias("cell_header"), "fact", "row_status", "ord")
    bucket = lambda v: F.floor(v / tolerance) if tolerance > 0 else v
    b = bucket(F.abs("value"))
    nearby = items.withColumn("bucket", F.explode(F.array(b - 1, b, b + 1)) if tolerance > 0 else b)
    near = nearby.join(c.withColumn("bucket", bucket(F.col("cell_value"))), ["page", "label", "bucket"]).where(F.abs(F.col("cell_value") - F.abs("value")) <= tolerance)
    same = F.col("fact").eqNullSafe(F.col("old_fact"))
    unlabeled = F.col("row_status").eqNullSafe(F.lit(UNLABELED))
    other_header = ~F.col("cell_header").eqNullSafe(F.col("header"))
    order = F.struct((~same).alias("a"), (same | ~unlabeled).alias("b"), other_header.alias("c"), "ord")
    first = F.min_by(F.struct("fact", unlabeled.alias("unlabeled_line"), other_header.alias("header_changed")), order)
    return near.groupBy("item").agg(first.alias("b")).select("item", "b.fact", "b.unlabeled_line", "b.header_changed")


def paired(alike: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The order-preserving pairing of rows and columns with the largest sum of similarities of at least threshold; of
    equally good ones that which leaves later rows and columns alone."""
    worth = [[x if x >= threshold else 0.0 for x in row] for row in alike.tolist()]
    n, m = alike.shape
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, gain = best[i], best[i + 1], worth[i]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + gain[j])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if worth[i][j] > 0 and best[i][j] == best[i + 1][j + 1] + worth[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def paired_sparsely(a: Sequence[str], b: Sequence[str], threshold: float, pairs: int = 500_000, most: int = 20_000_000) -> list[tuple[int, int]]:
    """``paired`` for long tables: of the table of best sums only the places where labels are similar enough are kept.

    From the last row up, so many pairs of labels at a time are compared, and a row of best sums follows from the row below
    at once. A place (i, j) that is part of a best pairing is found again by its own best sum: the walk of ``paired`` leaves a
    state (i, j) at the first row that pairs with j at that sum, or else at the last row that reaches it, with its
    first column. Memory: 8 bytes for each column, and 24 for each place; more than ``most`` places raise."""
    places: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    below = np.zeros(len(b) + 1)
    step, held = max(1, pairs // max(1, len(b))), 0
    width = np.array([len(x or "") for x in b])
    for stop in range(len(a), 0, -step):
        first = max(0, stop - step)
        total = np.array([len(x or "") for x in a[first:stop]])[:, None] + width[None, :]
        alike = 100.0 * (1 - distance_grid([x or "" for x in a[first:stop]], [x or "" for x in b], 2) / np.maximum(total, 1))
        alike[[not x for x in a[first:stop]]] = 0
        alike[:, width == 0] = 0
        for i in range(stop - 1, first - 1, -1):
            worth = alike[i - first]
            columns = np.flatnonzero(worth >= max(threshold, np.nextafter(0, 1)))
            sums = below[columns + 1] + worth[columns]
            held += len(columns)
            if held > most:
                raise ValueError(f"more than {most} pairs of similar labels in one table")
            places.append((np.full(len(columns), i), columns, sums))
            here = below.copy()
            here[columns] = np.maximum(here[columns], sums)
            below = np.maximum.accumulate(here[::-1])[::-1]
    rows, columns, sums = (np.concatenate(x) if x else np.zeros(0) for x in zip(*places, strict=True)) if places else (np.zeros(0),) * 3
    order = np.lexsort((columns, rows, sums))
    rows, columns, sums = rows[order], columns[order], sums[order]
    out, i, j, best = [], 0, 0, below[0]
    while best > 0:
        low, high = np.searchsorted(sums, best), np.searchsorted(sums, best, "right")
        r, c = rows[low:high], columns[low:high]
        ok = (r >= i) & (c >= j)
        r, c = r[ok], c[ok]
        straight = np.flatnonzero(c == j)
        k = straight[0] if len(straight) else np.flatnonzero(r == r.max())[0]
        out.append((int(r[k]), int(c[k])))
        i, j = out[-1][0] + 1, out[-1][1] + 1
        after = np.flatnonzero((rows >= i) & (columns >= j))
        best = sums[after].max() if len(after) else 0.0
    return out


def _pairs_of_labels(threshold: float, pairs_at_once: int = 500_000):
    """Of each table's labels, left and right in order: for each left row the right row that it pairs with, or -1."""

    @F.arrow_udf("array<int>")
    def pairs(left: pa.Array, right: pa.Array) -> pa.Array:
        a, b = left.flatten().to_pylist(), right.flatten().to_pylist()
        n, m = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, right))
        from_a, from_b = np.cumsum(n) - n, np.cumsum(m) - m
        found = np.full(len(a), -1, np.int32)
        # So many tables at a time that their pairs stay few; a table's pairs are its labels' product.
        long = np.flatnonzero(n * m > pairs_at_once)
        for t in long.tolist():
            for i, j in paired_sparsely(a[from_a[t] : from_a[t] + n[t]], b[from_b[t] : from_b[t] + m[t]], threshold, pairs_at_once):
                found[from_a[t] + i] = j
        m[long] = 0
        part = np.cumsum(n * m) // pairs_at_once
        for tables in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
            each = (n * m)[tables]
            table = np.repeat(tables, each)
            cell = np.arange(len(table)) - np.repeat(np.cumsum(each) - each, each)
            x, y = (from_a[table] + cell // m[table]).tolist(), (from_b[table] + cell % m[table]).tolist()
            # A row without label is like nothing.
            labelled = [k for k, (i, j) in enumerate(zip(x, y, strict=True)) if a[i] and b[j]]
            alike = np.zeros(len(table))
            alike[labelled] = similarities([a[x[k]] for k in labelled], [b[y[k]] for k in labelled])
            for t, grid in zip(tables.tolist(), np.split(alike, np.cumsum(each)[:-1]), strict=False):
                for i, j in paired(grid.reshape(n[t], m[t]), threshold):
                    found[from_a[t] + i] = j
        return pa.ListArray.from_arrays(pa.array(np.append(from_a, len(a)), pa.int32()), pa.array(found))

    return pairs


def merge_halves(left: DataFrame, right: DataFrame, key: Sequence[str], threshold: float = 70.0) -> DataFrame:
    """(key, ord, text): two halves of a wide table, their rows paired in order by the similarity of their labels.
    A pair is one line, a bar between; rows of one half alone are kept, the right half's after all of the left's.
    left, right: key, ord, label, text. Rows without label pair with nothing. A table of many rows is paired sparsely
    (``paired_sparsely``), with the same result."""
    sides = [df.select(*key, F.lit(side).alias("side"), F.struct("ord", "label", "text").alias("row")) for side, df in enumerate((left, right))]
    held = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("row"))))
    tables = sides[0].union(sides[1]).groupBy(*key).agg(held(0).alias("a"), held(1).alias("b"))
    tables = tables.withColumn("pair", _pairs_of_labels(threshold)(F.col("a.label"), F.col("b.label")))
    words = lambda row: F.coalesce(row["text"], F.lit(""))
    both = lambda row, i: F.when(F.get("pair", i) >= 0, F.concat(words(row), F.lit(" | "), words(F.get("b", F.get("pair", i))))).otherwise(row["text"])
    alone = F.transform(F.filter("b", lambda _, j: ~F.array_contains("pair", j)), lambda row: row["text"])
    return tables.select(*key, F.posexplode(F.concat(F.transform("a", both), alone)).alias("ord", "text"))


def fill_missing(outputs: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Outputs, and the source's rows for keys that have none."""
    return outputs.unionByName(source.join(outputs.select(key), key, "left_anti"))


def remaining(pages: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Pages whose output is missing or empty."""
    return pages.join(done.where(F.length("text") > 0).select(key), key, "left_anti")


def agreement(first: DataFrame, second: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """(key, first, second, agrees) over both annotators' cells."""
    both = first.select(*key, F.col(value).alias("first")).join(second.select(*key, F.col(value).alias("second")), list(key), "full")
    return both.withColumn("agrees", F.col("first").eqNullSafe(F.col("second")))


def keep_decisions(adjudication: DataFrame, earlier: DataFrame, key: Sequence[str]) -> DataFrame:
    """A new list of differences with the decisions that were entered before."""
    old = earlier.select(*key, F.col("decision").alias("earlier"), F.col("correct_value").alias("earlier_value"))
    return adjudication.join(old, list(key), "left").select(*[c for c in adjudication.columns if c not in ("decision", "correct_value")], F.coalesce("earlier", "decision").alias("decision"), F.coalesce("earlier_value", "correct_value").alias("correct_value"))


def looked_up(rows: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """Rows with their inventory columns; a key without entry fails the job, as a missing key should."""
    known = inventory.withColumn("_known", F.lit(True))
    out = rows.join(known, key, "left")
    return out.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not in the inventory: "), F.col(key).cast("string"))).cast(dict(rows.dtypes)[key]))).drop("_known")
