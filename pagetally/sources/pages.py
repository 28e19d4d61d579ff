"""Stored outputs, truth files, inventories and run logs as DataFrames, and the sinks for results."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetally.operators.ranks import ranked
from pagetally.tables import dealt

# Fixed value: <run>/<filing>_p<page>.md
PATH = r"(?:^|/)([^/]+)/([^/]+)_p(\d+)\.[a-z]+$"
CELLS = "map<string, double>"
ROWS = f"array<struct<id: string, label: string, kind: string, sum_of: array<string>, values: {CELLS}>>"
TRUTH = f"filing_id string, annotator string, verified_by string, statements array<struct<type: string, pages: array<int>, rows: {ROWS}>>"
TIMING = "page string, secs double, seconds double, chars bigint, error boolean, backend string, finish string, provider string, billed double, prompt_tokens bigint, gen_tokens bigint, reasoning_tokens bigint, cost_usd double, lines int"
RETRIES = "page string, flags array<string>, attempts array<struct<seed: int, result: string, flags: array<string>, figures: bigint>>, chosen string"


def path_parts(path: Column) -> list[Column]:
    """run, filing_id, page_no of an output's path."""
    return [F.regexp_extract(path, PATH, 1).alias("run"), F.regexp_extract(path, PATH, 2).alias("filing_id"), F.regexp_extract(path, PATH, 3).try_cast("int").alias("page_no")]


def read_outputs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(run, filing_id, page_no, text), one row an output file (.md or .mmd, named as ``PATH`` has it), read whole. Other
    files of the folder (token logs, timings) are not read."""
    raw = spark.read.option("pathGlobFilter", "*.{md,mmd}").text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return raw.where(F.col("path").rlike(PATH)).select(*path_parts(F.col("path")), F.col("value").alias("text"))


def read_truth(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """One row a filing; where several folders have it, the first one's."""
    from pagetally.operators.selection import precedence

    found = None
    for rank, folder in enumerate(folders):
        one = spark.read.schema(TRUTH).json(folder, multiLine=True).withColumn("rank", F.lit(rank))
        found = one if found is None else found.unionByName(one)
    return precedence(dealt(found, "filing_id"), "filing_id", "rank").drop("rank")


def statements(truth: DataFrame) -> DataFrame:
    return truth.select("filing_id", F.posexplode("statements").alias("stmt_no", "s")).select("filing_id", "stmt_no", "s.type", "s.pages", "s.rows")


def truth_rows(truth: DataFrame) -> DataFrame:
    r = statements(truth).select("filing_id", "stmt_no", "type", F.posexplode("rows").alias("pos", "r"))
    return r.select("filing_id", "stmt_no", "type", "pos", F.col("r.id").alias("row_id"), "r.label", "r.kind", "r.sum_of", "r.values")


def truth_cells(truth: DataFrame) -> DataFrame:
    """(filing_id, stmt_no, row_id, col, value); a blank cell's value is null."""
    return truth_rows(truth).select("filing_id", "stmt_no", "row_id", F.explode("values").alias("col", "value"))


def markdown_truth(texts: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """(key, table_no, row_no, label, figs) of reference tables kept as Markdown: a row's first cell is its
    label, the figures of the others its values; rows without figures are headings and go."""
    from pagetally.functions.figures import figures
    from pagetally.operators.tables import tables

    t = texts.select(*key, F.posexplode(tables(F.col(text))).alias("table_no", "t"))
    r = t.select(*key, "table_no", F.posexplode("t").alias("row_no", "r"))
    values = F.flatten(F.transform(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), lambda c: figures(c, compose=False)))
    return r.select(*key, "table_no", "row_no", F.get("r", 0).alias("label"), values.alias("figs")).where(F.size("figs") > 0)


def shares_of_work(pages: DataFrame, key: str, workers: int) -> DataFrame:
    """Pages with the ``worker`` (0 to workers - 1) that takes each; the same page always falls to the same."""
    return pages.withColumn("worker", F.pmod(F.xxhash64(key), F.lit(workers)).cast("int"))


def finished_cleanly(timing: DataFrame, page: str) -> bool:
    """Whether a trial page ended by itself and without error: the gate before a whole run."""
    return not timing.where((F.col("page") == page) & (F.col("finish") == "stop") & ~F.coalesce("error", F.lit(False))).isEmpty()


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The CSV of filings, all strings; the byte order mark goes from the first column's name."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    return df.toDF(*[c.replace("﻿", "") for c in df.columns])


def read_timing(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Run logs under one schema; seconds under either of the names that writers use."""
    return spark.read.schema(TIMING).json(path).withColumn("secs", F.coalesce("secs", "seconds")).drop("seconds")


def read_retries(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``chosen`` is a seed or a word, hence a string."""
    return spark.read.schema(RETRIES).json(path, multiLine=True)


# Fixed value: a status line.
LOG = r"(\S+) rows (\d+)/(\d+) figs (\d+)/(\d+) \(([\d.]+) min\)"


def log_results(lines: DataFrame, text: str = "value", pos: str = "pos") -> DataFrame:
    """(name, rows, rows_total, figs, figs_total, minutes): each name's last line."""
    part = lambda k, t: F.regexp_extract(text, LOG, k).cast(t)
    found = lines.where(F.col(text).rlike(LOG)).select(pos, part(1, "string").alias("name"), *[part(k, "int").alias(n) for k, n in zip(range(2, 6), ("rows", "rows_total", "figs", "figs_total"), strict=True)], part(6, "double").alias("minutes"))
    last = F.max_by(F.struct("rows", "rows_total", "figs", "figs_total", "minutes"), F.col(pos))
    return found.groupBy("name").agg(last.alias("l")).select("name", "l.*")


def with_layout(pages: DataFrame, layout: DataFrame, key: str) -> DataFrame:
    """Pages with their detector's blocks; an empty list where it has none."""
    blocks = layout.select(key, "blocks")
    kind = dict(layout.dtypes)["blocks"]
    return pages.join(blocks, key, "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(kind)))


def archived(responses: DataFrame, text: str = "response") -> DataFrame:
    """Raw responses as variants, so that any producer's fields can be asked for."""
    return responses.withColumn(text, F.try_parse_json(text))


def pages_of(manifest: DataFrame) -> DataFrame:
    """(filing_id, page_no) of a map filing -> pages."""
    return manifest.select(F.explode("pages").alias("filing_id", "p")).select("filing_id", F.explode("p").alias("page_no"))


# -- sinks -----------------------------------------------------------------------------------
def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_pages(df: DataFrame, path: str) -> None:
    """Texts by run; one file for each page only where a consumer needs it."""
    df.repartition("run").write.mode("overwrite").partitionBy("run").parquet(path)


def write_page_files(df: DataFrame, path: str, most: int = 10_000) -> None:
    """One file <run>/<filing>_p<page>.md for each row, closed by a line break, for consumers that need files. df: run, filing_id, page_no,
    text. Spark writes a folder for each page; its part is then renamed, one by one, so more than ``most`` rows are
    an error: ``write_pages`` is for those."""
    from pagetally.functions.text import page_key

    spark = df.sparkSession
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} pages; write_pages has no such limit")
    named = df.select("run", page_key(F.col("filing_id"), F.col("page_no")).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    named.repartition("run", "page").write.mode("overwrite").partitionBy("run", "page").text(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for run in fs.listStatus(root):
        if not run.isDirectory():
            continue
        to = spark._jvm.org.apache.hadoop.fs.Path(root, run.getPath().getName().split("=", 1)[1])
        fs.mkdirs(to)
        for page in fs.listStatus(run.getPath()):
            for part in fs.listStatus(page.getPath()):
                fs.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(to, page.getPath().getName().split("=", 1)[1] + ".md"))
        fs.delete(run.getPath(), True)


def write_truth(truth: DataFrame, path: str, filings: int = 1000) -> None:
    """Filings as JSON lists of at most so many each, a compressed file for each list: ``read_truth`` reads a file's first value
    only. Lists are made where the filings lie, so nothing is counted, moved or gathered; a partition's last list may be short."""

    def lists(batches):  # a batch in, a batch out: sent one by one, each list waits for the worker's socket
        for b in batches:
            joined = ["[" + ",".join(some) + "]" for some in batched(b.column(0).to_pylist(), filings)]
            yield pa.RecordBatch.from_arrays([pa.array(joined, pa.string())], ["value"])

    one = truth.select(F.to_json(F.struct(*truth.columns)).alias("value"))
    one.mapInArrow(lists, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path, compression="gzip")


def write_summary(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report table, for aggregates: one of more than ``limit`` rows is an error, not a shorter report."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows; aggregate it or raise limit")
    cell = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    body = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(r) + " |" for r in body)


def fixed_width(df: DataFrame, widths: Sequence[int]) -> DataFrame:
    """(line) for a console report: cells left-aligned to their widths."""
    return df.select(F.rtrim(F.concat(*[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in zip(df.columns, widths, strict=True)])).alias("line"))


def joined_text(pages: DataFrame, key: Sequence[str], order: Sequence[str], text: str = "text", between: str = " ") -> DataFrame:
    """(key, text): pages' texts in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_t"))))
    return pages.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["_t"]), between).alias(text))


def numbered_lines(pages: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """(key, line_no, text) of non-blank lines."""
    from pagetally.functions.text import lines_of

    return pages.select(*key, F.posexplode(lines_of(F.col(text))).alias("line_no", "text"))


def distinct_sets(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, value): each key's different values, sorted."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set(value)).alias(value))


def score_totals(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, rows_hit, rows_tot, fig_hit, fig_tot) added up over tables."""
    return scores.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("rows_hit", "rows_tot", "fig_hit", "fig_tot")])


def category_counts(rows: DataFrame, category: str, pos: str) -> DataFrame:
    """(category, n, place): most common first, ties by first appearance; places are counted over all tasks."""
    n = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    placed = ranked(n, [], [F.col("n").desc(), F.col("first").asc_nulls_first()])
    return placed.select(category, "n", (F.col("rank") + 1).cast("int").alias("place"))
