"""Round trips of sources and sinks: what is written is read again. Files go under the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagetally.plans.registry import query
from pagetally.sources import pages
from pagetally.tables import dealt, table


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pagetally")
    return f"{root}/{name}-{uuid.uuid4().hex}"


@query("SELECT 'benchmark' AS run, 'b' || (item_id // 50) AS filing_id, CAST(item_id % 50 AS INTEGER) AS page_no, coalesce(text, '') || chr(10) AS text FROM benchmark")
def a01_page_files(spark, sf):
    """Test items as one file each, read back by their names; other files beside them are not read."""
    path = scratch(spark, "a01")
    item = F.col("item_id")
    one = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("run"), F.concat(F.lit("b"), F.floor(item / 50).cast("string")).alias("filing_id"), (item % 50).cast("int").alias("page_no"), "text")
    pages.write_page_files(one, path)
    one.select(F.to_json(F.struct("filing_id", "page_no"))).write.mode("append").text(f"{path}/benchmark")  # logs beside the outputs
    return pages.read_outputs(spark, f"{path}/benchmark")


ORD = "CAST(l_linenumber * 10000000000 + l_partkey * 100000 + round(l_quantity) * 1000 + round(l_discount * 100) AS BIGINT)"


def _truth(spark, sf):
    """Orders as filings. Lines move as plain columns; the rows of a filing are built when they are together."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.expr(ORD).alias("ord"), "l_returnflag", "l_extendedprice")
    g = dealt(lines, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct("ord", "l_returnflag", "l_extendedprice")).alias("lines"))
    row = lambda x: F.struct(F.concat(F.lit("r"), x["ord"].cast("string")).alias("id"), x["l_returnflag"].alias("label"), F.lit("item").alias("kind"), F.array().cast("array<string>").alias("sum_of"), F.create_map(F.lit("v"), x["l_extendedprice"]).alias("values"))
    statement = F.array(F.struct(F.lit("income").alias("type"), F.array(F.lit(1)).alias("pages"), F.transform("lines", row).alias("rows")))
    return _filings(g, statement)


def _filings(orders, statements):
    return orders.select(F.concat(F.lit("f"), "l_orderkey").alias("filing_id"), F.lit("x").alias("annotator"), F.lit("").alias("verified_by"), statements.alias("statements"))


@query("SELECT 'f' || l_orderkey AS filing_id, 'r' || CAST(l_linenumber * 10000000000 + l_partkey * 100000 + round(l_quantity) * 1000 + round(l_discount * 100) AS BIGINT) AS row_id, l_extendedprice AS value FROM lineitem")
def a02_truth_files(spark, sf):
    """Orders as truth files; a second folder has the same filings, whose copies give way."""
    path = scratch(spark, "a02")
    pages.write_truth(_truth(spark, sf), f"{path}/gt")
    orders = table(spark, sf, "lineitem").select("l_orderkey").distinct()  # a draft has no statements, so lines need not move for it
    pages.write_truth(_filings(orders, F.array().cast(pages.TRUTH.split("statements ")[1])), f"{path}/drafts")
    return pages.truth_cells(pages.read_truth(spark, [f"{path}/gt", f"{path}/drafts"])).select("filing_id", "row_id", "value")


@query(f"SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORD}) AS INTEGER) AS row_no, l_returnflag AS label, l_quantity AS first, CAST(l_linenumber AS DOUBLE) AS second FROM lineitem")
def a03_markdown_truth(spark, sf):
    row = F.concat(F.lit("| "), "l_returnflag", F.lit(" | "), F.col("l_quantity").cast("string"), F.lit(" | "), F.col("l_linenumber").cast("string"), F.lit(" |"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.expr(ORD).alias("ord"), row.alias("r")))).alias("s"))
    text = F.concat(F.lit("# t\n| item | a | b |\n|---|---|---|\n"), F.array_join(F.transform("s", lambda s: s["r"]), "\n"))
    read = pages.markdown_truth(g.select("l_orderkey", text.alias("text")), ["l_orderkey"])
    return read.select("l_orderkey", "row_no", "label", F.get("figs", 0).alias("first"), F.get("figs", 1).alias("second"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def a04_inventory(spark, sf):
    """Suppliers as a CSV whose first name begins with a byte order mark."""
    path = scratch(spark, "a04")
    table(spark, sf, "supplier").select(F.col("s_suppkey").alias("\ufeffs_suppkey"), "s_name", "s_nationkey").write.csv(path, header=True)
    return pages.read_inventory(spark, path)


@query("SELECT CAST(event_id AS VARCHAR) AS page, value AS secs FROM events UNION ALL SELECT CAST(event_id AS VARCHAR), value FROM events")
def a05_timing_log(spark, sf):
    """Events appended to a log twice, seconds under either name."""
    path = scratch(spark, "a05")
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("page"), F.col("value").alias("secs"))
    pages.append_log(e, path)
    pages.append_log(e.withColumnRenamed("secs", "seconds"), path)
    return pages.read_timing(spark, path).select("page", "secs")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def a06_summary(spark, sf):
    path = scratch(spark, "a06")
    pages.write_summary(table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("lang string, n bigint").json(path)


@query("SELECT source AS run, doc_id, md5(coalesce(text, '')) AS text FROM documents")
def a07_page_sink(spark, sf):
    path = scratch(spark, "a07")
    pages.write_pages(table(spark, sf, "documents").select(F.col("source").alias("run"), "doc_id", "text"), path)
    return spark.read.schema("doc_id bigint, text string, run string").parquet(path).select("run", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text"))


@query("SELECT '| ' || lang || ' | ' || format('{:,}', count(*)) || ' |' AS line FROM documents GROUP BY lang UNION ALL SELECT '| lang | n |' UNION ALL SELECT '| --- | --- |'")
def a08_markdown_report(spark, sf):
    counted = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(x,) for x in pages.markdown(counted).split("\n")], "line string")


@query("SELECT rtrim(rpad(s_name, 30, ' ') || rpad(CAST(s_nationkey AS VARCHAR), 4, ' ')) AS line FROM supplier")
def a09_console_report(spark, sf):
    return pages.fixed_width(table(spark, sf, "supplier").select("s_name", "s_nationkey"), [30, 4])


RUN_EVENTS = """e AS (
  SELECT 'run' || o_custkey AS name, 0 AS kind, CAST(NULL AS INTEGER) AS rc, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS second FROM orders WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT 'run' || o_custkey, 1, CAST(o_orderkey % 3 AS INTEGER), CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 + CAST(floor(o_totalprice / 2) AS BIGINT) FROM orders WHERE o_orderkey % 7 <> 0)"""


@query(
    f"""WITH {RUN_EVENTS}, n AS (SELECT *, lead(kind) OVER w AS nk, lead(rc) OVER w AS nr, lead(second) OVER w AS ns, lag(kind) OVER w AS lk, lag(second) OVER w AS ls FROM e WINDOW w AS (PARTITION BY name ORDER BY second, kind, rc))
    SELECT name, second AS started, CASE WHEN nk = 1 AND ns <= second + 86400 THEN ns END AS ended, CASE WHEN nk = 1 AND ns <= second + 86400 THEN nr END AS rc,
           CASE WHEN NOT coalesce(nk = 1 AND ns <= second + 86400, false) THEN 'never ended' WHEN nr = 0 THEN 'finished' ELSE 'failed' END AS status FROM n WHERE kind = 0
    UNION ALL SELECT name, NULL, second, rc, 'end without start' FROM n WHERE kind = 1 AND NOT coalesce(lk = 0 AND second <= ls + 86400, false)"""
)
def n01_run_queue(spark, sf):
    """Orders as runs of their customers: their log is written in the queue's form and goes through the stateful stream. Some
    have no START, some no END, some end too late. A last line lets the log go on until every run is decided. Its
    files are in no order of time, so they are one trigger: lines of later triggers would be late."""
    from pagetally.streaming.runqueue import paired_stream, queue_events, stream_queue

    path = scratch(spark, "n01")
    o = table(spark, sf, "orders").withColumn("begun", F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86400)
    line = lambda kind, name, at: F.concat(F.lit(f"=== {kind}  "), name, F.lit("  "), F.from_unixtime(at, "yyyy-MM-dd HH:mm:ss"))
    name = F.concat(F.lit("run"), "o_custkey")
    starts = o.where("o_orderkey % 11 <> 0").select(F.col("begun").alias("at"), line("START", name, F.col("begun")).alias("value"))
    over = (F.col("begun") + F.floor(F.col("o_totalprice") / 2)).cast("bigint")
    code = F.concat(name, F.lit("  rc="), (F.col("o_orderkey") % 3).cast("string"))
    ends = o.where("o_orderkey % 7 <> 0").select(over.alias("at"), line("END", code, over).alias("value"))
    log = starts.union(ends)
    log.select("value").write.text(f"{path}/log")
    done = log.agg((F.max("at") + 10 * 86400).alias("at")).where("at IS NOT NULL").select(line("START", F.lit("ALL_DONE"), F.col("at")).alias("value"))
    done.write.mode("append").text(f"{path}/log")
    runs = paired_stream(queue_events(stream_queue(spark, f"{path}/log", files_per_trigger=1_000_000)), limit=86400, lateness="1 hour")
    q = runs.writeStream.format("parquet").option("path", f"{path}/runs").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("name string, started bigint, ended bigint, rc int, status string").parquet(f"{path}/runs").where("name <> 'ALL_DONE'")
