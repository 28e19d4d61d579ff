"""Queries of logs, predicates, facts, confidence, statistics and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetally.functions import predicates, text
from pagetally.operators import confidence, cost, facts, reconcile, statistics, trees
from pagetally.plans.registry import query
from pagetally.sources import pages
from pagetally.tables import spread, table


@query("SELECT name, rows, figs, minutes FROM (SELECT event_type AS name, CAST(event_id % 175 AS INTEGER) AS rows, CAST(event_id % 371 AS INTEGER) AS figs, CAST(1.5 AS DOUBLE) AS minutes, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def a10_log_results(spark, sf):
    e = table(spark, sf, "events")
    line = F.format_string("%s rows %d/175 figs %d/371 (1.5 min)", "event_type", F.col("event_id") % 175, F.col("event_id") % 371)
    return pages.log_results(e.select(line.alias("value"), F.col("event_id").alias("pos"))).select("name", "rows", "figs", "minutes")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS n FROM documents LEFT JOIN labels USING (doc_id)")
def a11_missing_layout(spark, sf):
    layout = table(spark, sf, "labels").select("doc_id", F.array("quality").alias("blocks"))
    return pages.with_layout(table(spark, sf, "documents").select("doc_id"), layout, "doc_id").select("doc_id", F.size("blocks").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def a12_archived_json(spark, sf):
    return pages.archived(table(spark, sf, "events"), "props").select("event_id", F.try_variant_get("props", "$.k", "bigint").alias("k"))


@query("SELECT 'f' || l_orderkey AS filing_id, unnest(list_sort(list(CAST(l_linenumber AS INTEGER)))) AS page_no FROM lineitem GROUP BY l_orderkey")
def a13_manifest_pages(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("f"), "l_orderkey").alias("f")).agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))).alias("p"))
    return pages.pages_of(m.select(F.create_map("f", "p").alias("pages")))


@query(
    """SELECT l_orderkey, l_linenumber, l_returnflag IN ('A', 'N') AS listed, contains(l_returnflag || l_linestatus, 'O') AS part, coalesce(l_quantity, 0) <> 0 AND abs(l_extendedprice) >= 1000 AS large,
    coalesce(nullif(l_discount, 0), 1) < 0.05 AS below, abs(l_quantity - abs(l_linenumber)) <= 1 AS near FROM lineitem"""
)
def c01_c08_predicates(spark, sf):
    f = F.col
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        predicates.listed(f("l_returnflag"), ["A", "N"]).alias("listed"),
        predicates.listed_in_part(F.concat("l_returnflag", "l_linestatus"), ["O"]).alias("part"),
        (predicates.large_value(f("l_extendedprice")) & (f("l_quantity") != 0)).alias("large"),
        (confidence.floor_probability(f("l_discount")) < 0.05).alias("below"),
        predicates.close_to(f("l_quantity"), f("l_linenumber"), 1).alias("near"),
    )


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g')) <> '')) AS INTEGER) AS lines, length(text) > 0 AS complete, length(text) > 100 AS longer FROM documents")
def c03_c10_lines_and_completeness(spark, sf):
    from pagetally.functions.text import lines_of

    return table(spark, sf, "documents").select("doc_id", F.size(lines_of(F.col("text"))).alias("lines"), predicates.complete(F.col("text")).alias("complete"), predicates.complete(F.col("text"), 100).alias("longer"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS blank FROM orders")
def c09_blank_header(spark, sf):
    from pagetally.operators.tables import blank_header

    cols = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(""), F.lit(" "))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("x"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "orders").select("o_orderkey", blank_header(cols).alias("blank"))


@query("SELECT 'f' || l_orderkey AS document, count(*) AS pages FROM lineitem GROUP BY 1")
def e03_pages_by_document(spark, sf):
    page = text.page_key(F.concat(F.lit("f"), "l_orderkey"), F.col("l_linenumber"))
    return table(spark, sf, "lineitem").groupBy(text.document_of(page).alias("document")).agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT lang, n, CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS place FROM (SELECT lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1)")
def e04_category_counts(spark, sf):
    return pages.category_counts(table(spark, sf, "documents"), "lang", "doc_id")


@query("SELECT o_orderstatus AS part, count(*) AS statements, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)::BIGINT AS large, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus)")
def e06_validation_totals(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "part")
    return reconcile.validation_totals(o, "part", large=F.count_if(F.col("o_totalprice") > 100000), total=F.round(F.sum("o_totalprice"), 2))


@query("SELECT l_returnflag AS run, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS rows_hit, count(*) AS rows_tot, sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END)::BIGINT AS fig_hit, sum(l_linenumber)::BIGINT AS fig_tot FROM lineitem GROUP BY 1")
def e14_score_totals(spark, sf):
    hit = F.col("l_linestatus") == "F"
    tables = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("run")).agg(F.count_if(hit).alias("rows_hit"), F.count(F.lit(1)).alias("rows_tot"), F.sum(F.when(hit, F.col("l_linenumber")).otherwise(0)).alias("fig_hit"), F.sum("l_linenumber").alias("fig_tot"))
    return pages.score_totals(tables, ["run"])


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY 1")
def e15_distinct_sets(spark, sf):
    return pages.distinct_sets(table(spark, sf, "documents"), ["source"], "lang").select("source", F.array_join("lang", ",").alias("langs"))


@query("SELECT quality AS old_fact, toxic AS fact, count(*) AS n FROM labels WHERE quality <> toxic GROUP BY 1, 2")
def e16_change_matrix(spark, sf):
    return facts.change_matrix(table(spark, sf, "labels").select(F.col("quality").alias("old_fact"), F.col("toxic").alias("fact")))


# -- facts -----------------------------------------------------------------------------------------
def _outcomes(spark, sf):
    """A line item's outcome under the 'system' that shipped it."""
    name = F.when(F.col("l_linenumber") % 4 == 0, "complete").when(F.col("l_linenumber") % 4 == 1, "unresolved row").when(F.col("l_linenumber") % 4 == 2, "misplaced row").otherwise("misread")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_returnflag").alias("system"), name.alias("outcome")).dropDuplicates(["cell", "system", "outcome"])


OUTCOMES = "o AS (SELECT DISTINCT l_orderkey AS cell, l_returnflag AS system, CASE l_linenumber % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'unresolved row' WHEN 2 THEN 'misplaced row' ELSE 'misread' END AS outcome FROM lineitem)"


@query(
    f"WITH {OUTCOMES}, g AS (SELECT o_orderkey AS cell, system FROM orders, (SELECT DISTINCT system FROM o)), b AS (SELECT g.cell, g.system, coalesce(outcome, 'missing') AS outcome FROM g LEFT JOIN o USING (cell, system)) "
    "SELECT system, count(*) AS cells, " + ", ".join(f"avg(CASE WHEN outcome = '{o}' THEN 1.0 ELSE 0 END) AS {o.replace(' ', '_')}" for o in ("complete", "unresolved row", "misplaced row", "misread", "missing")) + ", avg(CASE WHEN outcome = 'complete' THEN 1.0 ELSE 0 END) * 3878 / 5094 AS recovered FROM b GROUP BY 1"
)
def h01_h03_outcomes_on_common_base(spark, sf):
    eligible = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell"))
    cells = facts.on_common_base(eligible, _outcomes(spark, sf), ["cell"])
    shares = facts.outcome_shares(cells, ["complete", "unresolved row", "misplaced row", "misread", "missing"])
    return shares.withColumn("recovered", facts.recovery("complete", 3878, 5094))


@query("WITH s AS (SELECT l_returnflag AS system, l_orderkey, bool_and(l_quantity > 5) AS ok, bool_or(l_quantity > 49) AS bad FROM lineitem GROUP BY 1, 2) SELECT system, count(*) AS statements, count(*) FILTER (ok) AS fully_right, count(*) FILTER (bad) AS with_critical FROM s GROUP BY 1")
def h04_statement_level(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("system"), "l_orderkey", (F.col("l_quantity") > 5).alias("right"), (F.col("l_quantity") > 49).alias("critical"))
    return facts.statement_level(li, ["l_orderkey"])


@query("WITH d AS (SELECT l_returnflag AS system, CASE WHEN l_quantity > 40 THEN NULL ELSE l_linenumber - 4 END AS d, l_discount >= 0.09 AS heading FROM lineitem) SELECT system, CASE WHEN heading THEN 'section heading' WHEN d IS NULL THEN 'other statement' WHEN d = 1 THEN 'next' WHEN d = -1 THEN 'before' WHEN abs(d) = 2 THEN 'two lines off' WHEN abs(d) >= 3 THEN 'three or more' ELSE 'other cell' END AS place, count(*) AS n FROM d GROUP BY 1, 2")
def h05_offsets(spark, sf):
    d = F.when(F.col("l_quantity") <= 40, F.col("l_linenumber") - 4)
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("system"), facts.offset_class(d, F.col("l_discount") >= 0.09).alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OUTCOMES} SELECT system, count(*) FILTER (outcome IN ('unresolved row', 'misplaced row')) / 3878 AS rate FROM o GROUP BY 1")
def h06_h07_side_rate(spark, sf):
    return facts.side_rate(_outcomes(spark, sf), ["unresolved row", "misplaced row"], 3878)


@query("WITH p AS (SELECT l_orderkey, l_returnflag AS system, count(*) FILTER (l_linenumber > 3) AS a, count(*) FILTER (l_linenumber = 2) AS b, count(*) FILTER (l_linenumber IN (1, 3)) AS c FROM lineitem GROUP BY 1, 2) SELECT system, count(*) FILTER (a >= b AND a >= c) AS in_tables, count(*) FILTER (a < greatest(b, c) AND b >= c) AS outside_only, count(*) FILTER (c > greatest(a, b)) AS absent FROM p GROUP BY 1")
def h08_label_placement(spark, sf):
    number = F.col("l_linenumber")
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("system"))
    return facts.placement(g.agg(F.count_if(number > 3).alias("labels_in_tables"), F.count_if(number == 2).alias("labels_outside"), F.count_if(number.isin(1, 3)).alias("labels_absent")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 'kept' WHEN l_linenumber = 3 THEN 'wrong context' WHEN l_linenumber = 4 THEN 'unresolved' ELSE 'complete' END AS new_group FROM lineitem")
def h09_regroup(spark, sf):
    fact = F.when(F.col("l_linenumber") <= 2, "correct").when(F.col("l_linenumber") == 3, "wrong row").when(F.col("l_linenumber") == 4, "column not stated").otherwise("duplicate")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit("correct").alias("old_fact"), F.lit("kept").alias("old_group"), fact.alias("fact"))
    return facts.regroup(items).select("l_orderkey", "l_linenumber", "new_group")


def part_tables(spark, sf):
    """(p_partkey, truth, output): parts as tables of cells; of the outputs some lack a row, some a cell, some have a
    text reversed."""
    p = spread(table(spark, sf, "part"))
    case, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    truth = F.array(F.array("p_name", "p_brand"), F.array("p_type", size), F.array(size, F.lit("")))
    output = (
        F.when(case == 0, F.array(F.array("p_name", "p_brand"), F.array("p_type", size)))
        .when(case == 1, F.array(F.array("p_name", "p_brand"), F.array(F.col("p_type")), F.array(size, F.lit(""))))
        .when(case == 2, F.array(F.array(F.reverse("p_name"), F.col("p_brand")), F.array("p_type", size), F.array(size, F.lit(""))))
        .otherwise(truth)
    )
    return p.select("p_partkey", truth.alias("truth"), output.alias("output"))


@query()
def h10_tree_similarity(spark, sf):
    html = lambda t: F.concat(F.lit("<table>"), F.array_join(F.transform(t, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>"))), ""), F.lit("</table>"))
    t = part_tables(spark, sf).select("p_partkey", html("truth").alias("t"), html("output").alias("o"))
    return t.select("p_partkey", trees.tree_similarity(F.col("t"), F.col("o")).alias("teds"), trees.tree_similarity(F.col("t"), F.col("o"), texts=False).alias("teds_s"))


@query()
def h11_grid_similarity(spark, sf):
    from pagetally.operators.grids import grits

    return part_tables(spark, sf).select("p_partkey", grits(F.col("truth"), F.col("output")).alias("grits"))


@query("SELECT s_suppkey, CASE WHEN count(*) OVER (PARTITION BY n_name) > 1 THEN n_name || ' (' || s_suppkey || ')' ELSE n_name END AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def h13_runs_by_key(spark, sf):
    runs = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    return facts.by_run(runs.select("s_suppkey", "n_name"), "s_suppkey", "n_name").select("s_suppkey", "name")


@query("WITH s AS (SELECT l_returnflag AS run, l_suppkey, avg(l_quantity) AS score FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey, score AS base FROM s WHERE run = 'N') SELECT run, count(*) FILTER (score < base) AS worse, count(*) AS units FROM s JOIN b USING (l_suppkey) WHERE run <> 'N' GROUP BY 1")
def h12_worse_units(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run"), "l_suppkey").agg(F.avg("l_quantity").alias("score"))
    return facts.worse_than(s, "N", ["l_suppkey"])


# -- confidence ------------------------------------------------------------------------------------
def _records(spark, sf):
    f = F.col
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(f("l_linenumber") == 6, 0.0).when(f("l_linenumber") < 7, 1 - f("l_discount")).alias("p_min"), (f("l_returnflag") != "R").alias("correct"), (f("l_quantity") > 10).alias("anchored"), (f("l_tax") > 0.07).alias("suspect"), F.when(f("l_linenumber") != 5, f("l_linestatus") == "O").alias("agreed"))


RECORDS = "r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 6 THEN 0 WHEN l_linenumber < 7 THEN 1 - l_discount END AS p_min, l_returnflag <> 'R' AS correct, l_quantity > 10 AS anchored, l_tax > 0.07 AS suspect, CASE WHEN l_linenumber <> 5 THEN l_linestatus = 'O' END AS agreed FROM lineitem)"


@query(f"WITH {RECORDS} SELECT l_orderkey, l_linenumber, CASE WHEN suspect OR (NOT coalesce(agreed, false) AND NOT anchored) OR coalesce(nullif(p_min, 0), 1) < 0.95 THEN 'LOW' WHEN anchored AND agreed THEN 'HIGH' ELSE 'MEDIUM' END AS tier FROM r")
def i02_c07_tiers(spark, sf):
    r = _records(spark, sf)
    return r.select("l_orderkey", "l_linenumber", confidence.tier(*map(F.col, ("p_min", "anchored", "suspect", "agreed"))).alias("tier"))


@query(f"WITH {RECORDS}, t(threshold) AS (VALUES (0.99::DOUBLE), (0.95::DOUBLE), (0.9::DOUBLE), (0.8::DOUBLE)) SELECT threshold, count(*) FILTER (p_min < threshold AND correct) / count(*) FILTER (correct) AS flagged_correct, count(*) FILTER (coalesce(nullif(p_min, 0), 1) < threshold AND NOT correct) AS flagged_wrong FROM r, t WHERE p_min IS NOT NULL GROUP BY 1")
def i03_threshold_sweep(spark, sf):
    return confidence.sweep(_records(spark, sf))


@query(f"WITH {RECORDS} SELECT count(*) FILTER (agreed) AS agreed, count(*) FILTER (anchored) AS anchored, count(*) FILTER (agreed AND anchored) AS both FROM r".replace("AS both", 'AS "both"'))
def i04_agreement_counts(spark, sf):
    return confidence.agreement_counts(_records(spark, sf))


@query("WITH n AS (SELECT lang, regexp_replace(translate(text, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٬٫', '01234567890123456789,.'), '[^0-9.,()]', '', 'g') AS t, CAST(doc_id % 10 AS VARCHAR) AS d FROM documents) SELECT lang, count(*) FILTER (contains(t, d) AND contains(t, '1')) AS passed, count(*) AS items FROM n GROUP BY 1")
def i05_probe(spark, sf):
    """Digits, given in Arabic script, that a document's text is to hold in either script."""
    digit = text.arabic_digits((F.col("doc_id") % 10).cast("string"))
    d = table(spark, sf, "documents").select("lang", F.col("text").alias("output"), F.array(digit, F.lit("1")).alias("truths"))
    return confidence.probe(d, "lang")


@query("SELECT l_suppkey, sum(l_linenumber) FILTER (l_returnflag = 'A')::BIGINT AS A, sum(l_linenumber) FILTER (l_returnflag = 'N')::BIGINT AS N, sum(l_linenumber) FILTER (l_returnflag = 'R')::BIGINT AS R FROM lineitem GROUP BY 1")
def i06_row_matrix(spark, sf):
    return confidence.matrix(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"], "l_linenumber")


@query("WITH s AS (SELECT l_returnflag AS run, avg(CASE WHEN l_quantity > 1 THEN 100.0 ELSE 0 END) AS recall FROM lineitem GROUP BY 1), f(run, floor) AS (VALUES ('A', 98.0::DOUBLE), ('N', 94.0::DOUBLE), ('X', 1.0::DOUBLE)) SELECT run, coalesce(recall, 0) AS recall, floor, coalesce(recall, 0) >= floor AS passes FROM f LEFT JOIN s USING (run)")
def i07_regression_gate(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(F.avg(F.when(F.col("l_quantity") > 1, 100.0).otherwise(0.0)).alias("recall"))
    return confidence.gate(s, {"A": 98.0, "N": 94.0, "X": 1.0})


# -- statistics and costs ----------------------------------------------------------------------------
def frame(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_name").alias("filing_id"), F.col("s_nationkey").cast("string").alias("format"))


@query()
def k01_k02_stratified_draw(spark, sf):
    """A first and a second draw of a supplier for each nation; the second leaves out what the first has taken."""
    strata = [str(k) for k in range(25)]
    first = statistics.stratified_draw(frame(spark, sf), strata, 20261001)
    second = statistics.stratified_draw(frame(spark, sf), strata, 20261002, exclude=[name for _, name in first])
    return spark.createDataFrame([(1, *r) for r in first] + [(2, *r) for r in second], "draw int, stratum string, filing_id string")


@query("SELECT p_partkey, round(1 - pow(0.05, 1.0 / p_size), 9) AS upper FROM part")
def k03_zero_error_bound(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(statistics.zero_error_bound(F.col("p_size")), 9).alias("upper"))


@query(
    """WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b FROM part)
    SELECT p_brand, round(corr(a, b), 9) AS spearman FROM r GROUP BY 1"""
)
def k04_f11_spearman(spark, sf):
    return statistics.spearman(table(spark, sf, "part"), "p_size", "p_retailprice", ["p_brand"]).withColumn("spearman", F.round("spearman", 9))


@query()
def k03_error_bound(spark, sf):
    """Bounds for samples in which errors were found."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", statistics.error_bound(F.col("p_partkey") % 4, F.col("p_size")).alias("upper"))


@query(
    """WITH n AS (SELECT p_partkey AS i, p_brand, p_size AS a, p_retailprice AS b FROM part), p AS (SELECT x.p_brand, sign(x.a - y.a) AS sa, sign(x.b - y.b) AS sb FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.i < y.i)
    SELECT p_brand, round(sum(sa * sb) / sqrt(sum(sa * sa) * sum(sb * sb)), 9) AS kendall FROM p GROUP BY 1"""
)
def k04_kendall(spark, sf):
    return statistics.kendall(table(spark, sf, "part"), "p_size", "p_retailprice", ["p_brand"]).withColumn("kendall", F.round("kendall", 9))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def k05_stratum_counts(spark, sf):
    return statistics.stratum_counts(table(spark, sf, "documents"), "lang", "source")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity * 1.5 / (l_quantity * 60) * 1000 AS thousand, l_quantity * 60 * 730 AS capacity, 1 / (1 / l_quantity + 1 / (l_quantity + 10)) AS both_engines,
    (1000 / (l_quantity * 60) + 10.0 / 60) * 4.5 / 1000 * 1000 AS batch FROM lineitem"""
)
def l01_l04_cost(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cost.per_thousand(q * 1.5, q).alias("thousand"), cost.monthly_capacity(q).alias("capacity"), cost.in_series(q, q + 10).alias("both_engines"), cost.batch_price(F.lit(4.5), q, F.lit(1000)).alias("batch"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS configuration, CASE WHEN 2190000 <= p_size * 100000 THEN CAST(2190000 AS DOUBLE) END AS s1, CASE WHEN 821250 <= p_size * 100000 THEN CAST(821250 AS DOUBLE) END AS s2 FROM part")
def l05_break_even(spark, sf):
    c = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("configuration"), (F.col("p_size") * 100000).alias("capacity"))
    prices = spark.createDataFrame([("s1", 1.5), ("s2", 4.0)], "service string, price double")
    return cost.break_even(c, prices, ["s1", "s2"])


@query("SELECT l_returnflag AS run, count(DISTINCT l_partkey) AS pages, round(sum(l_tax), 6) AS cost FROM lineitem GROUP BY 1")
def l06_run_cost(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_partkey").alias("page"), F.col("l_tax").alias("cost_usd"))
    return cost.run_cost(t).withColumn("cost", F.round("cost", 6))
