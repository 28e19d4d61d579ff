import contextlib
import gzip
import io
import json
import uuid

import pytest
from pyspark.sql import functions as F

from pagetally.plans import catalog
from pagetally.sources import pages
from pagetally.streaming.runlog import progress, sessions, stream_timing


def test_outputs_and_sinks(spark, tmp_path):
    run = tmp_path / "in" / "sys_a_s0"
    run.mkdir(parents=True)
    (run / "some_co_FY2024_p07.md").write_text("line\nنص", encoding="utf-8")
    (run / "some_co_FY2024_p08.mmd").write_text("more")
    for side in ("some_co_FY2024_p07.tok.json", "_timing.jsonl", "notes.md", "some_co_FY2024_p09.txt"):
        (run / side).write_text("{}")
    assert {(r.filing_id, r.page_no) for r in pages.read_outputs(spark, str(run)).collect()} == {("some_co_FY2024", 7), ("some_co_FY2024", 8)}
    got = pages.read_outputs(spark, str(run)).orderBy("page_no").first()
    assert (got.run, got.filing_id, got.page_no, got.text) == ("sys_a_s0", "some_co_FY2024", 7, "line\nنص")
    pages.write_pages(pages.read_outputs(spark, str(run)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().run == "sys_a_s0"


def test_truth_and_precedence(spark, tmp_path):
    def put(folder, fid, value):
        (tmp_path / folder).mkdir(exist_ok=True)
        row = {"id": "r1", "label": "x", "kind": "subtotal", "sum_of": ["r2", "-r3"], "values": {"2024": value, "2023": None}}
        (tmp_path / folder / f"{fid}.json").write_text(json.dumps({"filing_id": fid, "statements": [{"type": "income", "pages": [3], "rows": [row]}]}, indent=1))

    put("gt", "a", 1.5), put("drafts", "a", 9.0), put("drafts", "b", 2.0)
    truth = pages.read_truth(spark, [str(tmp_path / "gt"), str(tmp_path / "drafts")])
    cells = {(r.filing_id, r.col): r.value for r in pages.truth_cells(truth).collect()}
    assert cells == {("a", "2024"): 1.5, ("a", "2023"): None, ("b", "2024"): 2.0, ("b", "2023"): None}
    assert pages.truth_rows(truth).first().sum_of == ["r2", "-r3"]


def test_truth_of_many_lists(spark, tmp_path):
    """However the lists lie in partitions, every filing is read again."""
    truth = spark.range(0, 400, 1, 8).selectExpr("concat('f', id) AS filing_id", "'x' AS annotator", "'' AS verified_by").withColumn("statements", F.array().cast(pages.TRUTH.split("statements ")[1]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages.write_truth(truth, str(tmp_path / "gt"), filings=10)
        assert {r.filing_id for r in pages.read_truth(spark, [str(tmp_path / "gt")]).collect()} == {f"f{i}" for i in range(400)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def stages_of(spark, run):
    """Stages of the jobs that ``run`` starts, one for each shuffle and one for each job's end; those skipped do not count."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    return {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds if status.getStageInfo(s) and status.getStageInfo(s).numCompletedTasks}


def test_truth_is_written_where_it_lies_and_compressed(spark, tmp_path):
    """No count, no shuffle; lists of at most so many filings, odd texts among them."""
    odd = "نص \"q\" \\ \n , [ ] \U0001f600"
    kind = pages.TRUTH.split("statements ")[1]
    truth = spark.range(0, 103, 1, 4).select(F.concat(F.lit("f"), "id").alias("filing_id"), F.when(F.col("id") % 2 == 0, F.lit(odd)).alias("annotator"), F.lit("").alias("verified_by"), F.array().cast(kind).alias("statements"))
    assert len(stages_of(spark, lambda: pages.write_truth(truth, str(tmp_path / "gt"), filings=10))) == 1
    lists = [json.loads(gzip.decompress(f.read_bytes())) for f in (tmp_path / "gt").iterdir() if f.name.endswith(".gz")]
    assert sum(map(len, lists)) == 103 and max(map(len, lists)) == 10 and len(lists) <= 103 // 10 + 4
    assert {(r.filing_id, r.annotator) for r in pages.read_truth(spark, [str(tmp_path / "gt")]).collect()} == {(f"f{i}", None if i % 2 else odd) for i in range(103)}
    pages.write_truth(truth.limit(0), str(tmp_path / "none"))
    assert pages.read_truth(spark, [str(tmp_path / "none")]).count() == 0


def test_truth_is_read_in_small_shares(spark, tmp_path):
    """Filings are compared over eight times the partitions of shuffles, in one exchange."""
    out = io.StringIO()
    (tmp_path / "gt").mkdir(), (tmp_path / "gt" / "a.json").write_text('{"filing_id": "a", "statements": []}')
    with contextlib.redirect_stdout(out):
        pages.read_truth(spark, [str(tmp_path / "gt")]).explain("simple")
    moved = [line for line in out.getvalue().splitlines() if "Exchange" in line]
    assert len(moved) == 1 and "hashpartitioning(filing_id" in moved[0] and ", 32), REPARTITION_BY_NUM" in moved[0]


def test_truth_files_move_lines_once(spark, sf):
    """Written: the lines and the different orders, one exchange each; the rest reads tables' footers and lists files."""
    with_shuffle = stages_of(spark, lambda: catalog.QUERIES["a02_truth_files"](spark, sf))
    assert len(with_shuffle) <= 6


def test_inventory_without_its_mark(spark, tmp_path):
    (tmp_path / "i.csv").write_text("﻿filing_id,entity\na,b\n", encoding="utf-8")
    assert pages.read_inventory(spark, str(tmp_path / "i.csv")).first().asDict() == {"filing_id": "a", "entity": "b"}


def test_logs(spark, tmp_path):
    log = tmp_path / "log"
    pages.append_log(spark.createDataFrame([("p1", 1.5)], "page string, secs double"), str(log))
    pages.append_log(spark.createDataFrame([("p2", 2.5)], "page string, seconds double"), str(log))
    assert {(r.page, r.secs) for r in pages.read_timing(spark, str(log)).collect()} == {("p1", 1.5), ("p2", 2.5)}
    (tmp_path / "r.json").write_text('[{"page": "p", "chosen": 2}, {"page": "q", "chosen": "original kept"}]')
    assert {r.chosen for r in pages.read_retries(spark, str(tmp_path / "r.json")).collect()} == {"2", "original kept"}
    lines = spark.createDataFrame([(0, "x rows 1/175 figs 2/371 (0.5 min)"), (1, "noise"), (2, "x rows 3/175 figs 4/371 (1.5 min)")], "pos int, value string")
    assert tuple(pages.log_results(lines).first()) == ("x", 3, 175, 4, 371, 1.5)


def test_markdown_truth_and_work(spark):
    text = "# Income\n| item | 2024 |\n|---|---|\n| sales | (1,234) |\n| heading | |\n\n| x | 5 | 6 |"
    rows = pages.markdown_truth(spark.createDataFrame([("d", text)], "doc string, text string"), ["doc"]).collect()
    assert [(r.table_no, r.row_no, r.label, r.figs) for r in rows] == [(0, 0, "item", [2024.0]), (0, 1, "sales", [-1234.0]), (1, 0, "x", [5.0, 6.0])]
    shares = pages.shares_of_work(spark.range(100).select(F.col("id").cast("string").alias("page")), "page", 4)
    assert {r.worker for r in shares.collect()} == {0, 1, 2, 3}
    log = spark.createDataFrame([("p", "stop", None), ("q", "length", False), ("r", "stop", True)], "page string, finish string, error boolean")
    assert [pages.finished_cleanly(log, k) for k in "pqrs"] == [True, False, False, False]


def test_reports(spark):
    df = spark.createDataFrame([("a", 1234), (None, 1)], "k string, n int")
    assert pages.markdown(df) == "| k | n |\n| --- | --- |\n| a | 1,234 |\n|  | 1 |"
    with pytest.raises(ValueError, match="more than 1 rows"):
        pages.markdown(df, limit=1)
    assert pages.fixed_width(df, [4, 6]).first().line == "a   1234"
    pages_ = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, None)], "k string, n int, text string")
    assert pages.joined_text(pages_, ["k"], ["n"]).first().text == "a b "
    assert pages.archived(spark.createDataFrame([("{broken",)], "response string")).first().response is None


def test_streaming_progress(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"page": "p", "secs": 2, "error": false}\n{"page": "q", "seconds": 3, "error": true}\n')
    q = progress(stream_timing(spark, str(tmp_path / "s"))).writeStream.format("memory").queryName("prog").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    row = spark.table("prog").first()
    assert (row.pages, row.failed, row.secs) == (2, 1, 5.0)


def test_sessions(spark):
    ev = spark.createDataFrame([("u", 0), ("u", 600), ("u", 9000)], "u string, s bigint").select("u", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r.n for r in sessions(ev, "u", "ts").collect()) == [1, 2]
