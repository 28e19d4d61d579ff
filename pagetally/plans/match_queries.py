"""Queries of multisets, joins, geometry, selection and tables.

The driver's tables stand in for pages and statements: an order is a page or statement, its line items
are blocks, rows or readings. Every query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetally.functions.text import nfkc
from pagetally.operators import layout, matching, multiset, reconcile, selection
from pagetally.operators import tables as grids
from pagetally.plans.registry import query
from pagetally.sources import pages
from pagetally.tables import dealt, table


#: Line numbers repeat within an order; with part, quantity and discount they give its lines an order.
ORD = "CAST(l_linenumber * 10000000000 + l_partkey * 100000 + round(l_quantity) * 1000 + round(l_discount * 100) AS BIGINT)"


def _sides(spark, sf):
    """Quantities of odd and even lines of an order, as two multisets."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("value"), "l_linenumber")
    side = lambda odd: li.where(F.col("l_linenumber") % 2 == odd).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    return side(1), side(0)


SIDES = "a AS (SELECT l_orderkey AS key, l_quantity AS value, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2), b AS (SELECT l_orderkey AS key, l_quantity AS value, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2), m AS (SELECT key, value, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b USING (key, value))"


@query("SELECT d.doc_id, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def d01_c02_with_truth(spark, sf):
    return matching.with_truth(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"])


@query(f"WITH {SIDES} SELECT key, CAST(sum(least(na, nb)) AS BIGINT) AS matched, CAST(sum(na) AS BIGINT) AS in_truth, CAST(sum(nb) AS BIGINT) AS in_output, sum(least(na, nb)) / greatest(1, sum(na)) AS recall, sum(least(na, nb)) / greatest(1, sum(nb)) AS precision FROM m GROUP BY key")
def d02_e01_number_recall(spark, sf):
    return multiset.recall_precision(*_sides(spark, sf), ["key"])


@query(
    """WITH r AS (SELECT l_suppkey AS g, l_orderkey AS row_id, l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), x AS (SELECT l_suppkey AS g, l_partkey AS line_no, l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
    need AS (SELECT g, row_id, count(*) AS need FROM r GROUP BY 1, 2), hit AS (SELECT r.g, row_id, line_no, count(*) AS got FROM r JOIN x ON r.g = x.g AND r.value = x.value AND x.n >= r.n GROUP BY 1, 2, 3)
    SELECT need.g, need.row_id, coalesce(bool_or(got = need), false) AS found FROM need LEFT JOIN hit ON hit.g = need.g AND hit.row_id = need.row_id GROUP BY 1, 2"""
)
def d03_contained_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    one = lambda by, name: li.groupBy(F.col("l_suppkey").alias("g"), F.col(by).alias(name), F.col("l_linenumber").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return matching.contained(one("l_orderkey", "row_id"), one("l_partkey", "line_no"), ["g"])


@query(
    """WITH q AS (SELECT l_orderkey AS k, l_returnflag = 'R' AS wanted, l_quantity AS v FROM lineitem)
    SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM q a WHERE a.k = o_orderkey AND a.wanted AND NOT EXISTS (SELECT 1 FROM q b WHERE b.k = a.k AND NOT b.wanted AND b.v = a.v)) AS all_in FROM orders WHERE o_orderkey IN (SELECT k FROM q)"""
)
def d03b_contained_sets(spark, sf):
    """Quantities of an order's returned items against those of its others."""
    side = lambda test: F.collect_list(F.when(test, F.col("l_quantity")))
    figs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(side(F.col("l_returnflag") == "R").alias("figs"), side(F.col("l_returnflag") != "R").alias("line"))
    return table(spark, sf, "orders").select("o_orderkey").join(figs, "o_orderkey").select("o_orderkey", matching.in_line(F.col("figs"), F.col("line")).alias("all_in"))


def read_badly(spark, sf):
    """Line items as true rows and as lines of output: a quarter of them split over two lines, a quarter with one
    figure misread, a quarter without its figures and label, the others right."""
    li = table(spark, sf, "lineitem").withColumn("ord", F.expr(ORD))
    label = F.concat_ws(" ", F.lit("item"), "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    figures_ = [F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"), F.round("l_extendedprice", 2)]
    rows = li.select(F.col("l_orderkey").alias("g"), F.col("ord").alias("row_id"), label.alias("label"), F.array(*figures_).alias("values"))
    line = lambda half, text, *values: F.struct((2 * F.col("ord") + half).alias("line_no"), text.alias("text"), F.array(*values).cast("array<double>").alias("values"))
    case = F.col("l_partkey") % 4
    split = F.array(line(0, label, *figures_[:2]), line(1, F.lit(""), figures_[2]))
    misread = F.array(line(0, label, figures_[0], figures_[1], figures_[2] + 10))
    gone = F.array(line(0, F.lit("?")))
    right = F.array(line(0, label, *figures_))
    lines = li.select(F.col("l_orderkey").alias("g"), F.inline(F.when(case == 0, split).when(case == 1, misread).when(case == 2, gone).otherwise(right)))
    return rows, lines


@query()
def d04_i01_missed_rows(spark, sf):
    return matching.missed_rows(*read_badly(spark, sf), ["g"])


@query(f"WITH {SIDES} SELECT key, coalesce(sum(least(na, nb)) / sum(greatest(na, nb)), 1) AS jaccard FROM (SELECT o_orderkey AS key FROM orders) LEFT JOIN m USING (key) GROUP BY key")
def d05_e07_parity(spark, sf):
    return multiset.jaccard(*_sides(spark, sf), ["key"], table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")))


@query(f"WITH {SIDES}, j AS (SELECT key, coalesce(sum(least(na, nb)) / sum(greatest(na, nb)), 1) AS jaccard FROM (SELECT o_orderkey AS key FROM orders) LEFT JOIN m USING (key) GROUP BY key) SELECT o_orderstatus AS status, count(*) AS pages, round(avg(jaccard), 9) AS parity FROM j JOIN orders ON o_orderkey = key GROUP BY 1")
def e07_mean_parity(spark, sf):
    status = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    each = multiset.jaccard(*_sides(spark, sf), ["key"], status.select("key")).join(status, "key")
    return multiset.mean_jaccard(each, ["status"]).withColumn("parity", F.round("parity", 9))


@query(
    """WITH r AS (SELECT o_custkey AS c, o_orderstatus AS s, count(*) AS n, max(o_totalprice) AS largest FROM orders GROUP BY 1, 2)
    SELECT c_custkey, c_name, f.n AS f_orders, o.n AS o_orders, o.largest AS o_largest, p.largest AS p_largest FROM customer LEFT JOIN r f ON f.c = c_custkey AND f.s = 'F' LEFT JOIN r o ON o.c = c_custkey AND o.s = 'O' LEFT JOIN r p ON p.c = c_custkey AND p.s = 'P'"""
)
def d06_aligned_runs(spark, sf):
    """Orders of each status as a 'run' over customers."""
    by = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("largest"))
    runs = {k.lower(): by.where(F.col("o_orderstatus") == k).select("c_custkey", "n", "largest") for k in "FOP"}
    out = matching.aligned_runs(table(spark, sf, "customer").select("c_custkey", "c_name"), runs, "c_custkey")
    return out.select("c_custkey", "c_name", F.col("f.n").alias("f_orders"), F.col("o.n").alias("o_orders"), F.col("o.largest").alias("o_largest"), F.col("p.largest").alias("p_largest"))


@query("SELECT s_suppkey, n.n_nationkey, n_name FROM supplier JOIN nation n ON n.n_nationkey = s_nationkey")
def d07_inventory_lookup(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return matching.looked_up(rows, table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")


def _statement(spark, sf):
    """Orders as statements: a total row and a row for each line item."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("stmt"), F.lit("total").alias("row_id"), F.lit("v").alias("col"), F.col("o_totalprice").alias("value"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("stmt"), F.concat(F.lit("r"), "l_linenumber").alias("row_id"), F.lit("v").alias("col"), net.alias("value"))
    cells = o.unionByName(li)
    refs = dealt(li.select("stmt", "row_id"), "stmt").groupBy("stmt").agg(F.collect_set("row_id").alias("sum_of")).withColumn("row_id", F.lit("total"))
    return cells, reconcile.edges(refs, ["stmt"])


NET = "s AS (SELECT l_orderkey AS stmt, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS summed, count(*) AS components FROM lineitem GROUP BY 1)"


@query(
    f"""WITH {NET} SELECT stmt, 'total' AS total, 'v' AS col, o_totalprice AS printed, round(summed, 6) AS summed, components, abs(o_totalprice - summed) <= 1 AS reconciles,
    CASE WHEN abs(o_totalprice - summed) <= 1 THEN CASE WHEN o_totalprice = summed THEN 'reconciles' ELSE 'rounding gap' END WHEN abs(o_totalprice + summed) <= 1 THEN 'sign flipped'
    WHEN starts_with(printf('%.0f', abs(summed)), printf('%.0f', abs(o_totalprice))) AND length(printf('%.0f', abs(o_totalprice))) < length(printf('%.0f', abs(summed))) THEN 'digits dropped' ELSE 'unexplained' END AS diagnosis
    FROM orders JOIN s ON stmt = o_orderkey"""
)
def d08_g06_g07_reconcile(spark, sf):
    cells, links = _statement(spark, sf)
    return reconcile.diagnose(reconcile.reconcile(cells, links, ["stmt"])).withColumn("summed", F.round("summed", 6))


@query(
    """WITH c AS (SELECT 'a' AS x, o_orderstatus AS status, count(*) AS figures FROM orders GROUP BY 2), l AS (SELECT o_orderstatus AS status, count(*) AS figures FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
    z AS (SELECT o_orderstatus AS status, count(*) AS lone FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1),
    t AS (SELECT c.status, c.figures + coalesce(l.figures, 0) AS figures, c.figures + coalesce(l.figures, 0) - coalesce(lone, 0) AS covered FROM c LEFT JOIN l USING (status) LEFT JOIN z USING (status))
    SELECT status, CAST(sum(figures) AS BIGINT) AS figures, CAST(sum(covered) AS BIGINT) AS covered, sum(covered) / sum(figures) AS share FROM t GROUP BY ROLLUP (status)"""
)
def e05_g08_coverage(spark, sf):
    cells, links = _statement(spark, sf)
    status = dealt(table(spark, sf, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("stmt"), F.col("o_orderstatus").alias("status"))
    return reconcile.coverage(reconcile.covered(dealt(cells, "stmt").join(status, "stmt"), links, ["stmt"]), "status")


@query(f"WITH {NET} SELECT CASE WHEN summed IS NULL THEN 'without components' WHEN abs(o_totalprice - summed) <= 1 THEN 'reconciles' ELSE 'differs' END AS part, count(*) AS totals FROM orders LEFT JOIN s ON stmt = o_orderkey GROUP BY 1")
def g14_ledger_split(spark, sf):
    cells, links = _statement(spark, sf)
    checked = reconcile.reconcile(cells, links, ["stmt"]).select("stmt", "reconciles")
    totals = cells.where("row_id = 'total'").join(checked, "stmt", "left")
    return totals.groupBy(F.when(F.col("reconciles").isNull(), "without components").when(F.col("reconciles"), "reconciles").otherwise("differs").alias("part")).agg(F.count(F.lit(1)).alias("totals"))


@query("SELECT doc_id, 'approver 2026-01-01' AS verified_by FROM documents WHERE n_chars >= 200 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def g13_promotion(spark, sf):
    drafts = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") >= 200, 0).otherwise(1).alias("n_errors"))
    return reconcile.promote(drafts, table(spark, sf, "labels"), "doc_id", "approver", "2026-01-01").drop("n_errors")


RESCORED = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unlabeled line' ELSE 'ok' END AS status, CASE event_id % 4 WHEN 0 THEN NULL ELSE 'h' || (event_id % 3) END AS header, CASE event_id % 7 WHEN 0 THEN NULL ELSE event_type || '-' || (event_id % 3) END AS fact"


@query(
    f"""WITH e AS (SELECT event_id, user_id AS page, event_type AS label, value AS v, {RESCORED} FROM events), i AS (SELECT event_id AS item, user_id AS page, event_type AS label, value AS v, CASE event_id % 2 WHEN 0 THEN NULL ELSE 'h1' END AS wanted, event_type || '-1' AS old FROM events),
    m AS (SELECT item, fact, status IS NOT DISTINCT FROM 'unlabeled line' AS unlabeled_line, header IS DISTINCT FROM wanted AS header_changed,
      row_number() OVER (PARTITION BY item ORDER BY fact IS DISTINCT FROM old, fact IS NOT DISTINCT FROM old OR status IS DISTINCT FROM 'unlabeled line', header IS DISTINCT FROM wanted, event_id) AS k FROM i JOIN e ON i.page = e.page AND i.label = e.label AND abs(e.v - abs(i.v)) <= 0.5)
    SELECT item, fact, unlabeled_line, header_changed FROM m WHERE k = 1"""
)
def d09_rescore(spark, sf):
    """Events found again; statuses, headers and verdicts are missing here and there."""
    e = table(spark, sf, "events")
    number = F.col("event_id")
    items = e.select(number.alias("item"), F.col("user_id").alias("page"), F.col("event_type").alias("label"), "value", F.when(number % 2 != 0, "h1").alias("header"), F.concat("event_type", F.lit("-1")).alias("old_fact"))
    status = F.when(number % 5 == 1, "unlabeled line").when(number % 5 != 0, "ok")
    fact = F.when(number % 7 != 0, F.concat("event_type", F.lit("-"), number % 3))
    header = F.when(number % 4 != 0, F.concat(F.lit("h"), number % 3))
    cells = e.select(F.col("user_id").alias("page"), F.col("event_type").alias("label"), "value", header.alias("header"), fact.alias("fact"), status.alias("row_status"), number.alias("ord"))
    return matching.rescore(items, cells, 0.5)


def halves(spark, sf):
    """Line items as the two halves of a wide table; every fifth label of the right half is another."""
    li = table(spark, sf, "lineitem").withColumn("ord", F.expr(ORD))
    label = F.concat_ws(" ", F.lit("row"), "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    changed = F.when(F.col("l_partkey") % 5 == 0, F.lit("")).otherwise(label)
    left = li.select("l_orderkey", "ord", label.alias("label"), F.col("l_quantity").cast("string").alias("text"))
    return left, li.select("l_orderkey", "ord", changed.alias("label"), F.col("l_tax").cast("string").alias("text"))


@query()
def d10_merge_halves(spark, sf):
    return matching.merge_halves(*halves(spark, sf), ["l_orderkey"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def d11_j06_remaining(spark, sf):
    done = table(spark, sf, "labels").select("doc_id", F.lit("x").alias("text"))
    return matching.remaining(table(spark, sf, "documents").select("doc_id", "source"), done, "doc_id")


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def d12_fill_missing(spark, sf):
    source = table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return matching.fill_missing(table(spark, sf, "labels").select("doc_id", "quality"), source, "doc_id")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.value AS first, b.quality AS second, a.value IS NOT DISTINCT FROM b.quality AS agrees FROM (SELECT doc_id, n_chars % 2 AS value FROM documents) a FULL JOIN labels b ON a.doc_id = b.doc_id")
def d13_agreement(spark, sf):
    """Labels against a second 'annotator' who marks every document by the parity of its length."""
    first = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).alias("value"))
    return matching.agreement(first, table(spark, sf, "labels").select("doc_id", F.col("quality").alias("value")), ["doc_id"])


@query("SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'PRINTED' WHEN 0 THEN 'BOTH_WRONG' END AS decision, CAST(l.toxic AS DOUBLE) AS correct_value FROM documents d LEFT JOIN labels l USING (doc_id)")
def d14_keep_decisions(spark, sf):
    new = table(spark, sf, "documents").select("doc_id", F.lit(None).cast("string").alias("decision"), F.lit(None).cast("double").alias("correct_value"))
    old = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "PRINTED").otherwise("BOTH_WRONG").alias("decision"), F.col("toxic").cast("double").alias("correct_value"))
    return matching.keep_decisions(new, old, ["doc_id"])


@query("WITH v AS (SELECT DISTINCT l_suppkey AS g, CAST(l_partkey AS DOUBLE) AS value FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT DISTINCT l_suppkey AS g, CAST(l_partkey AS DOUBLE) AS read_as FROM lineitem WHERE l_returnflag <> 'R'), d AS (SELECT v.g, value, read_as, printf('%.0f', value) AS a, printf('%.0f', read_as) AS b FROM v JOIN o ON v.g = o.g) SELECT g, value, read_as FROM d WHERE length(a) = length(b) AND len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1")
def e13_near_misses(spark, sf):
    """Parts of a supplier's returned items against those of its others."""
    part = lambda test, name: table(spark, sf, "lineitem").where(test).select(F.col("l_suppkey").alias("g"), F.col("l_partkey").cast("double").alias("value")).distinct()
    return matching.near_misses(part(F.col("l_returnflag") == "R", "value"), part(F.col("l_returnflag") != "R", "value"), ["g"])


@query("SELECT l_partkey, count(*) AS missed, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS runs FROM lineitem GROUP BY 1")
def f08_e13_miss_report(spark, sf):
    out = matching.miss_report(table(spark, sf, "lineitem"), ["l_partkey"], "l_returnflag")
    return out.withColumn("runs", F.array_join("runs", ","))


# -- geometry ------------------------------------------------------------------------------------
def _page_blocks(spark, sf):
    box = {"y0": F.col("l_quantity") * 6, "y1": F.col("l_quantity") * 6 + 20 + F.col("l_linenumber"), "x0": F.col("l_extendedprice"), "x1": F.col("l_extendedprice") + 10}
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.expr(ORD).alias("ord"), *[v.alias(k) for k, v in box.items()], F.when(F.col("l_returnflag") == "R", "Table").otherwise("Text").alias("category"), F.concat(F.lit("<b>"), "l_shipdate", F.lit("</b>  x "), "l_linenumber").alias("text"))


BLOCKS = f"p AS (SELECT l_orderkey AS page, {ORD} AS ord, l_quantity * 6 AS y0, l_quantity * 6 + 20 + l_linenumber AS y1, l_extendedprice AS x0, CASE WHEN l_returnflag = 'R' THEN 'Table' ELSE 'Text' END AS category, {ORD} AS t FROM lineitem), c AS (SELECT *, (y0 + y1) / 2 AS cy, greatest(1.0, y1 - y0) AS h FROM p), w AS (SELECT *, CASE WHEN abs(cy - lag(cy) OVER o) < 0.6 * least(h, lag(h) OVER o) AND category <> 'Table' AND lag(category) OVER o <> 'Table' THEN 0 ELSE 1 END AS fresh FROM c WINDOW o AS (PARTITION BY page ORDER BY cy, ord)), b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY page ORDER BY cy, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM w)"


@query(f"WITH {BLOCKS} SELECT page, ord, band FROM b")
def f01_bands(spark, sf):
    return layout.bands(_page_blocks(spark, sf), "page").select("page", "ord", "band")


@query(f"WITH {BLOCKS}, l AS (SELECT page, band, string_agg('x ' || t, '  ' ORDER BY -x0, cy, ord) AS line FROM b GROUP BY 1, 2) SELECT page, string_agg(line, chr(10) ORDER BY band) AS text FROM l GROUP BY 1")
def f03_render_bands(spark, sf):
    rows = _page_blocks(spark, sf).withColumn("text", F.concat(F.lit("x "), "ord"))
    return layout.render(layout.bands(rows, "page"), "page")


@query()
def f02_cluster_rows(spark, sf):
    box = F.struct(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("ord").cast("string").alias("t"))
    pages_ = _page_blocks(spark, sf).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", box.alias("b")))).alias("s"))
    return pages_.select("page", F.array_join(layout.cluster_rows(F.transform("s", lambda s: s["b"])), "\n").alias("text"))


@query(
    """WITH r AS (SELECT l_partkey AS page, l_linenumber AS run, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT a.page, a.run, sum(CASE WHEN b.run <> a.run THEN least(a.n, b.n) ELSE 0 END) AS shared FROM r a JOIN r b ON a.page = b.page AND a.value = b.value GROUP BY 1, 2), z AS (SELECT page, run, sum(n) AS size FROM r GROUP BY 1, 2),
    k AS (SELECT page, run, shared + 0.001 * size AS score, row_number() OVER (PARTITION BY page ORDER BY shared + 0.001 * size DESC, run) AS k FROM s JOIN z USING (page, run)) SELECT page, run, CAST(score AS DOUBLE) AS score FROM k WHERE k = 1"""
)
def f04_medoid_reading(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("page"), F.col("l_linenumber").alias("run"), F.col("l_quantity").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return multiset.medoid(r.withColumn("pos", F.col("run")), "page", "run", "pos")


def readings(spark, sf):
    """Each order's items by return flag as a 'run': a bar table; those of run N lack the total."""
    li = table(spark, sf, "lineitem").withColumn("ord", F.expr(ORD))
    row = F.concat(F.lit("| "), "l_returnflag", F.lit(" | "), F.col("l_linenumber").cast("string"), F.lit(" | "), F.format_number("l_extendedprice", 2), F.lit(" |"))
    total = F.concat(F.lit("| total | | "), F.format_number(F.sum("l_extendedprice"), 2), F.lit(" |"))
    g = li.groupBy("l_orderkey", F.col("l_returnflag").alias("run")).agg(F.array_sort(F.collect_list(F.struct("ord", row.alias("r")))).alias("s"), total.alias("total"))
    body = F.transform("s", lambda x: x["r"])
    lines = F.when(F.col("run") == "N", body).otherwise(F.array_append(body, F.col("total")))
    return g.select("l_orderkey", "run", F.ascii("run").alias("pos"), F.array_join(lines, "\n").alias("text"))


@query()
def f05_best_by_features(spark, sf):
    return selection.best_by_features(readings(spark, sf), ["l_orderkey"], "run", "pos")


TRUTH_ROWS = f"li AS (SELECT *, {ORD} AS ord FROM lineitem), t AS (SELECT l_orderkey AS k, ord AS row_id, unnest([l_quantity, CAST(l_linenumber AS DOUBLE) + 100]) AS v FROM li), l AS (SELECT l_orderkey AS k, l_returnflag AS run, ord AS line_no, unnest([l_quantity - CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END, CAST(l_linenumber AS DOUBLE) + 100]) AS v FROM li)"


@query(
    f"""WITH {TRUTH_ROWS}, r AS (SELECT k, row_id, v, count(*) AS n FROM t GROUP BY 1, 2, 3), x AS (SELECT k, run, line_no, v, count(*) AS n FROM l GROUP BY 1, 2, 3, 4),
    need AS (SELECT k, row_id, count(*) AS need FROM r GROUP BY 1, 2), hit AS (SELECT r.k, run, row_id, line_no, count(*) AS got FROM r JOIN x ON r.k = x.k AND r.v = x.v AND x.n >= r.n GROUP BY 1, 2, 3, 4),
    f AS (SELECT DISTINCT hit.k, hit.run, hit.row_id FROM hit JOIN need ON need.k = hit.k AND need.row_id = hit.row_id AND need = got), runs AS (SELECT DISTINCT k, run FROM x), h AS (SELECT runs.k, runs.run, count(f.row_id) AS hits FROM runs LEFT JOIN f ON f.k = runs.k AND f.run = runs.run GROUP BY 1, 2)
    SELECT k, run, hits FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY hits DESC, run) AS p FROM h) WHERE p = 1"""
)
def f06_best_by_truth(spark, sf):
    """Of each order's 'runs' (return flags) the one whose lines hold most of the order's items; every third quantity is misread."""
    li = dealt(table(spark, sf, "lineitem"), "l_orderkey").withColumn("ord", F.expr(ORD))
    number = F.col("l_linenumber").cast("double") + 100
    misread = F.col("l_quantity") - F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0)
    rows = li.select(F.col("l_orderkey").alias("k"), F.col("ord").alias("row_id"), F.explode(F.array(F.col("l_quantity"), number)).alias("value")).groupBy("k", "row_id", "value").agg(F.count(F.lit(1)).alias("n"))
    lines = li.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("run"), F.ascii("l_returnflag").alias("pos"), F.col("ord").alias("line_no"), F.explode(F.array(misread, number)).alias("value"))
    lines = lines.groupBy("k", "run", "pos", "line_no", "value").agg(F.count(F.lit(1)).alias("n"))
    return selection.best_by_truth(rows, lines, ["k"], "run", "pos")


@query(
    f"""WITH a AS (SELECT l_orderkey AS page, {ORD} AS seed, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS n_flags, CAST(l_quantity AS BIGINT) AS figures FROM lineitem), o AS (SELECT o_orderkey AS page, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS n_flags, 25 AS figures FROM orders),
    c AS (SELECT page, arg_min(seed, seed) FILTER (n_flags = 0) AS cs, arg_min(figures, seed) FILTER (n_flags = 0) AS cf FROM a GROUP BY 1), m AS (SELECT page, seed AS ms, figures AS mf FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY figures DESC, seed) AS k FROM a) WHERE k = 1)
    SELECT o.page, CASE WHEN n_flags > 0 AND cs IS NOT NULL THEN CAST(cs AS VARCHAR) WHEN n_flags > 0 AND mf > figures THEN CAST(ms AS VARCHAR) ELSE 'original' END AS chosen, CAST(CASE WHEN n_flags > 0 AND cs IS NOT NULL THEN cf WHEN n_flags > 0 AND mf > figures THEN mf ELSE figures END AS BIGINT) AS figures FROM o LEFT JOIN c USING (page) LEFT JOIN m USING (page)"""
)
def f07_retry_ladder(spark, sf):
    attempts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.expr(ORD).alias("seed"), F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("n_flags"), F.col("l_quantity").cast("bigint").alias("figures"))
    originals = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("n_flags"), F.lit(25).cast("bigint").alias("figures"))
    return selection.retry_ladder(originals, attempts, "page")


@query("SELECT user_id, arg_min(event_type, ts) AS event_type FROM (SELECT DISTINCT ON (user_id) user_id, event_type, ts FROM events WHERE value > 50 ORDER BY user_id, ts, event_id) GROUP BY 1")
def f10_first_match(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return selection.first_match(e, ["user_id"], "value > 50", "at", "event_type")


@query("SELECT name, min(pos) AS pos FROM (SELECT l_shipdate::DATE::VARCHAR AS name, l_orderkey AS pos, l_quantity * 5 AS rows, l_linenumber * 100 AS figs FROM lineitem) WHERE rows > 170 OR (rows = 170 AND figs >= 366) GROUP BY 1")
def c06_candidates(spark, sf):
    runs = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("name"), F.col("l_orderkey").alias("pos"), (F.col("l_quantity") * 5).alias("rows"), (F.col("l_linenumber") * 100).alias("figs"))
    return selection.candidates(runs, rows=170)


@query("SELECT l_orderkey, list_sort(list(l_quantity))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS upper, median(l_quantity) AS middle, count(DISTINCT abs(l_quantity)) AS distinct_values FROM lineitem GROUP BY 1")
def e08_e10_medians(spark, sf):
    from pagetally.functions.figures import distinct_figures, middle, upper_median

    v = F.col("v")
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v"))
    return g.select("l_orderkey", upper_median(v).alias("upper"), middle(v).alias("middle"), distinct_figures(v).cast("bigint").alias("distinct_values"))


@query(
    """WITH p AS (SELECT l_orderkey AS page, CASE WHEN l_returnflag = 'R' THEN 'table' WHEN l_returnflag = 'A' THEN 'picture' ELSE 'text' END AS label, l_quantity * 20 AS y0, l_quantity * 20 + 30 AS y1 FROM lineitem), c AS (SELECT *, (y0 + y1) / 2 AS cy FROM p),
    f AS (SELECT page, min(y0) FILTER (label = 'table') AS top, min(cy) FILTER (label = 'picture' AND cy > 500) AS pic FROM c GROUP BY 1)
    SELECT page, CAST(trunc(greatest(0, any_value(top) - 30)) AS INTEGER) AS top, CAST(trunc(least(1000, max(y1) + 30)) AS INTEGER) AS bottom FROM c JOIN f USING (page) WHERE top IS NOT NULL AND label IN ('table', 'text') AND cy >= top AND cy < coalesce(pic, 970) GROUP BY 1"""
)
def e11_crop_box(spark, sf):
    label = F.when(F.col("l_returnflag") == "R", "table").when(F.col("l_returnflag") == "A", "picture").otherwise("text")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.lit(1000.0).alias("height"), label.alias("label"), (F.col("l_quantity") * 20).alias("y0"), (F.col("l_quantity") * 20 + 30).alias("y1"))
    return layout.crop_box(rows, "page", "height")


@query("SELECT l_orderkey, min(l_quantity) AS x0, min(l_tax) AS y0, max(l_quantity) AS x1, max(l_tax) AS y1 FROM lineitem GROUP BY 1")
def e12_polygon_box(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("xs"), F.collect_list("l_tax").alias("ys"))
    return g.select("l_orderkey", layout.polygon_box(F.col("xs"), F.col("ys")).alias("b")).select("l_orderkey", "b.*")


# -- tables --------------------------------------------------------------------------------------
def _json_pages(spark, sf):
    block = F.struct(F.array("l_quantity", "l_tax", "l_extendedprice", "l_discount").alias("bbox"), F.col("l_returnflag").alias("category"), F.col("l_linenumber").cast("string").alias("text"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.expr(ORD).alias("ord"), block.alias("b")))).alias("s"))
    cut = F.to_json(F.transform("s", lambda s: s["b"]))
    return g.select("l_orderkey", F.when(F.col("l_orderkey") % 10 == 0, F.left(cut, F.length(cut) - 5)).otherwise(F.concat(F.lit("```json\n"), cut, F.lit("\n```"))).alias("raw"))


@query(f"SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORD}) - 1 AS INTEGER) AS ord, l_quantity AS x0, l_tax AS y0, l_returnflag AS category, CAST(l_linenumber AS VARCHAR) AS text FROM lineitem WHERE l_orderkey % 10 <> 0")
def g01_blocks(spark, sf):
    """Every tenth page's list is broken off and falls back to its raw text, so it has no blocks."""
    return layout.exploded(_json_pages(spark, sf), "l_orderkey", "raw").select("l_orderkey", "ord", "x0", "y0", "category", "text")


def _html_pages(spark, sf):
    row = F.concat(F.lit("<tr><td colspan='2'>"), "l_returnflag", F.lit("</td><td>"), "l_linenumber", F.lit("</td></tr>"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.expr(ORD).alias("ord"), row.alias("r")))).alias("s"))
    return g.select("l_orderkey", F.concat(F.lit("x <table>"), F.array_join(F.transform("s", lambda s: s["r"]), ""), F.lit("</table> y")).alias("html"))


@query(f"WITH r AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORD}) - 1 AS INTEGER) AS row_no, l_returnflag, l_linenumber FROM lineitem) SELECT l_orderkey, row_no, unnest([0, 1, 2]) AS col_no, unnest([l_returnflag, l_returnflag, CAST(l_linenumber AS VARCHAR)]) AS cell FROM r")
def g02_table_cells(spark, sf):
    return grids.table_cells(_html_pages(spark, sf), ["l_orderkey"], "html").drop("table_no")


@query()
def g09_relations(spark, sf):
    """Sums in each order's table of prices by return flag; two runs in three print their total."""
    values = grids.grid_values(grids.tables(F.col("text")))
    return readings(spark, sf).select("l_orderkey", "run", grids.relations(values).alias("relations"))


def misprinted(spark, sf):
    """Orders as statements whose totals are the sums of their items, to two places; every third total is off by 300."""
    li = table(spark, sf, "lineitem").withColumn("v", F.round("l_extendedprice", 2)).withColumn("row_id", F.concat(F.lit("r"), F.expr(ORD)))
    items = li.select(F.col("l_orderkey").alias("stmt"), "row_id", F.lit("v").alias("col"), F.col("v").alias("value"))
    off = F.when(F.col("l_orderkey") % 3 == 0, 300).otherwise(0)
    totals = li.groupBy("l_orderkey").agg(F.round(F.sum("v"), 2).alias("value")).select(F.col("l_orderkey").alias("stmt"), F.lit("total").alias("row_id"), F.lit("v").alias("col"), (F.col("value") + off).alias("value"))
    refs = items.groupBy("stmt").agg(F.collect_list("row_id").alias("sum_of")).withColumn("row_id", F.lit("total"))
    return items.union(totals), reconcile.edges(refs, ["stmt"])


@query()
def g10_one_digit_repair(spark, sf):
    return reconcile.repair(*misprinted(spark, sf), ["stmt"], tolerance=0.5)


@query()
def g03_g04_structure_flags(spark, sf):
    flags = grids.structure_flags(F.col("text"), grids.tables(F.col("text")))
    out = table(spark, sf, "documents").select("doc_id", nfkc(F.col("text")).alias("text")).select("doc_id", flags.alias("f"))
    return out.select("doc_id", "f.expected", "f.figures", "f.table_rows", F.array_join("f.flags", "; ").alias("flags"))


@query(
    """WITH b AS (SELECT l_orderkey AS k, count(*) AS items, CASE WHEN l_orderkey % 2 = 0 THEN 4 ELSE 2 END AS vals FROM lineitem GROUP BY 1), y AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders),
    c AS (SELECT k, items, vals, k % 3 = 0 AS headed, [CAST(y AS VARCHAR), CAST(y - 1 AS VARCHAR)] AS ys FROM b JOIN y ON o_orderkey = k)
    SELECT k AS o_orderkey, CASE WHEN headed THEN 'a,b' ELSE 'البند,إيضاح,' || CASE WHEN vals = 4 THEN ys[1] || ' ريال,' || ys[2] || ' ريال,' || ys[1] || ' دولار,' || ys[2] || ' دولار' ELSE ys[1] || ',' || ys[2] END END AS cols,
    CAST(items + CASE WHEN headed THEN 1 ELSE 0 END AS INTEGER) AS kept FROM c"""
)
def g11_g12_year_headers(spark, sf):
    """Each order's items as a table with two or four value columns, a row of years on top, and a header every third time."""
    even = F.col("l_orderkey") % 2 == 0
    price = F.format_number("l_extendedprice", 0)
    row = F.concat(F.array(F.col("l_returnflag"), F.lit("1"), price, price), F.when(even, F.array(price, price)).otherwise(F.array().cast("array<string>")))
    body = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(row).alias("items"))
    t = table(spark, sf, "orders").select("o_orderkey", F.array(F.year("o_orderdate"), F.year("o_orderdate") - 1).alias("y")).join(body, "o_orderkey")
    years = F.array(F.array(F.lit("2024"), F.lit("2023")))
    header = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit(" "), F.lit("")))
    made = grids.year_headers(header, F.concat(years, "items"), F.col("y"), F.col("o_orderkey") % 2 == 0)
    return t.select("o_orderkey", made.alias("t")).select("o_orderkey", F.array_join("t.cols", ",").alias("cols"), F.size("t.rows").alias("kept"))


# -- sets ----------------------------------------------------------------------------------------
def _set_sql(expression: str, where: str) -> str:
    return f"WITH {SIDES} SELECT key, value, CAST({expression} AS BIGINT) AS n FROM m WHERE {where}"


@query(_set_sql("least(na, nb)", "na > 0 AND nb > 0"))
def j01_multiset_intersection(spark, sf):
    return multiset.intersection(*_sides(spark, sf), ["key"])


@query(_set_sql("greatest(na, nb)", "true"))
def j02_multiset_union(spark, sf):
    return multiset.union(*_sides(spark, sf), ["key"])


@query(_set_sql("na - nb", "na > nb"))
def j03_multiset_difference(spark, sf):
    return multiset.difference(*_sides(spark, sf), ["key"])


def _pairs(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("c")), table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("c"))


@query("SELECT l_orderkey AS k, CAST(l_linenumber AS INTEGER) AS c FROM lineitem UNION ALL SELECT o_orderkey, CAST(1 AS INTEGER) FROM orders")
def j04_concatenated(spark, sf):
    return multiset.concatenated(*_pairs(spark, sf))


@query("SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS INTEGER) AS c FROM lineitem UNION SELECT o_orderkey, CAST(1 AS INTEGER) FROM orders")
def j05_united(spark, sf):
    return multiset.united(*_pairs(spark, sf))


@query("SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn, role) AS text FROM conversations GROUP BY 1")
def e02_joined_text(spark, sf):
    return pages.joined_text(table(spark, sf, "conversations"), ["conv_id"], ["turn", "role"])
