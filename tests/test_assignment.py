"""Matchings and outcomes against exhaustive search."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from pagetally.functions.distance import similarity
from pagetally.functions.text import key_of, label_key
from pagetally.operators.assignment import OUTCOMES, WORTH, gathered, heaviest, label_errors, label_errors_of, matched, outcomes, outcomes_of, period_of, stated_period, stated_rows
from pagetally.operators import facts
from pagetally.plans import fact_queries


def exhaustive(edges):
    """All matchings: the heaviest, then the first in order of (left, right), a left alone coming last."""
    weight = {}
    for left, right, w in edges:
        if w > 0:
            weight[left, right] = max(w, weight.get((left, right), 0))
    lefts, rights = sorted({x for x, _ in weight}), sorted({y for _, y in weight})
    best = None

    def go(i, used, total, places):
        nonlocal best
        if i == len(lefts):
            key = (-total, places)
            best = key if best is None else min(best, key)
            return
        for n, right in enumerate(rights):
            if right not in used and (lefts[i], right) in weight:
                go(i + 1, used | {right}, total + weight[lefts[i], right], (*places, n))
        go(i + 1, used, total, (*places, len(rights)))

    go(0, frozenset(), 0, ())
    return [(x, rights[n]) for x, n in zip(lefts, best[1], strict=True) if n < len(rights)]


def test_heaviest_matching_is_the_first_of_the_heaviest():
    rnd = random.Random(1)
    for _ in range(3000):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        edges = [(rnd.randint(1, n) * 3, rnd.randint(1, m) * 2, rnd.randint(-1, 4)) for _ in range(rnd.randint(1, 14))]
        assert heaviest(edges) == exhaustive(edges)
    assert heaviest([]) == [] and heaviest([(1, 1, 0)]) == []


def test_dense_components_in_time():
    rnd = random.Random(2)
    began = time.time()
    pairs = heaviest([(i, j, rnd.randint(1, 9)) for i in range(120) for j in range(120)])
    assert len(pairs) == 120 == len({j for _, j in pairs}) and time.time() - began < 60


def test_groups_are_matched_apart(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", "c"]), rnd.randint(1, 4), rnd.randint(1, 4), rnd.randint(0, 5)) for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, left bigint, right bigint, weight bigint").repartition(3)
    got = sorted(tuple(r) for r in matched(df, ["g"]).collect())
    want = [(g, *pair) for g in "abc" for pair in exhaustive([r[1:] for r in rows if r[0] == g])]
    assert got == sorted(want)
    assert matched(df.where("false"), ["g"]).collect() == []
    with pytest.raises(Exception, match="more edges than can be matched"):
        matched(df, ["g"], most=2).collect()


LABELS = ["Total assets", "Total asset", "Cash at bank", "Cash in bank", "Sales", "", None]


def plain_outcomes(true, out, solve=exhaustive):
    """The rules by trying every assignment of rows, and for each absolute value of cells."""
    key = lambda s: (s or "").lower()
    values = lambda cells, row: {abs(c[-1]) for c in cells if c[0] == row and c[-1] is not None}
    t_rows, o_rows = {c[0]: key(c[1]) for c in true}, {c[0]: key(c[1]) for c in out}
    edges = []
    for (i, a), (j, b) in itertools.product(t_rows.items(), o_rows.items()):
        if a and b and (alike := similarity(a, b)) >= 80:
            edges.append((i, j, round(alike * 100) * 1024 + len(values(true, i) & values(out, j))))
    states = {j: i for i, j in solve(edges)}

    def kind(t, o):
        if t[3] != o[4]:
            return "wrong sign"
        if o[0] not in states:
            return "unresolved row"
        if states[o[0]] != t[0]:
            return "misplaced row"
        if o[3] is None:
            return "unresolved column"
        return "complete" if o[3] == t[2] else "misplaced column"

    cells = sorted(t for t in true if t[3] is not None)
    answers = sorted((o for o in out if o[4] is not None), key=lambda o: (o[0], o[2], o[4]))
    kinds = {(i, j): kind(t, o) for i, t in enumerate(cells) for j, o in enumerate(answers) if abs(t[3]) == abs(o[4])}
    chosen = {}
    for size in {abs(t[3]) for t in cells}:
        chosen |= dict(solve([(i, j, WORTH[k]) for (i, j), k in kinds.items() if abs(cells[i][3]) == size]))
    return sorted((t[0], t[2], t[3], kinds[i, chosen[i]] if i in chosen else "misread or omitted") for i, t in enumerate(cells))


def test_outcomes_equal_exhaustive_assignment(spark):
    rnd = random.Random(5)
    truth, output, want = [], [], []
    for k in range(160):
        t_labels, o_labels = [rnd.choice(LABELS) for _ in range(4)], [rnd.choice(LABELS) for _ in range(4)]
        true = [(i, t_labels[i], y, rnd.choice([None, 5.0, 7.0, -7.0, 10.0 * i])) for i in range(rnd.randint(1, 4)) for y in ("2024", "2023")]
        heads = [rnd.choice(["2024", "2023", None]) for _ in range(2)]
        out = [(j, o_labels[j], c, heads[c], rnd.choice([None, 5.0, 7.0, -5.0, 10.0 * j])) for j in range(rnd.randint(0, 4)) for c in range(2)]
        truth += [(k, *r) for r in true]
        output += [(k, j, label, c, None if h is None else f"year {h}", v) for j, label, c, h, v in out]
        clean = [(i, label or "", y, v) for i, label, y, v in true]
        want += [(k, *r) for r in plain_outcomes(clean, out)]
    t = spark.createDataFrame(truth, "k bigint, row bigint, label string, col string, value double")
    o = spark.createDataFrame(output, "k bigint, out_row bigint, label string, out_col bigint, header string, value double")
    got = sorted(tuple(r) for r in outcomes(t, o, ["k"]).collect())
    assert got == sorted(want)
    assert {r[-1] for r in got} == {*OUTCOMES, "misread or omitted"}
    assert {r.outcome for r in outcomes(t, o.where("false"), ["k"]).collect()} == {"misread or omitted"}
    assert outcomes(t.where("false"), o, ["k"]).collect() == []


def test_outcomes_deal_rows_out_by_group_alone(spark):
    """Each side once, however many steps follow."""
    t = spark.createDataFrame([(1, 0, "cash", "2024", 5.0)], "k bigint, row bigint, label string, col string, value double")
    o = spark.createDataFrame([(1, 0, "cash", 0, "Year 2024", 5.0)], "k bigint, out_row bigint, label string, out_col bigint, header string, value double")
    found = outcomes(t.repartition(2), o.repartition(2), ["k"])
    assert [tuple(r) for r in found.collect()] == [(1, 0, "2024", 5.0, "complete")]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Window") == 0
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 2


ODD = ["Cash (12) at bank", "نقد ١٢٣ في البنك", "<b>Total</b>  assets*", "a\u00a0b\u2003 c\x1cd\x85e", " \t", "", "إأآىة – x", "1,234.5-|", "<open", "a\nb", "😀 ۱۲ y", "_#`—", "Year 2024", "2024/2023", "2024 2024", "٢٠٢٤", "٢٠٢٤ 2024", "20245", "2031", "1920 2016", None]


def test_labels_and_headers_are_keyed_as_in_columns(spark):
    got = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", label_key(F.col("t")).alias("key"), stated_period(F.col("t")).alias("period")).collect()
    assert [(r.key, r.period) for r in got] == [(None if r.t is None else key_of(r.t), period_of(r.t)) for r in got]
    assert {r.period for r in got} == {None, "2024", "2016"}


def many_cells(spark, rnd, groups=40):
    truth = [(s, k, i, rnd.choice(LABELS), y, rnd.choice([None, 5.0, -7.0, float("nan"), 10.0 * i])) for s in "xy" for k in range(groups) for i in range(rnd.randint(1, 4)) for y in ("2024", "2023")]
    output = [(s, k, j, rnd.choice(LABELS), c, rnd.choice(["year 2024", "2023", "Note", None]), rnd.choice([None, 5.0, 7.0, float("nan"), 10.0 * j])) for s in "xy" for k in range(groups) if k % 5 for j in range(rnd.randint(0, 4)) for c in range(2)]
    t = spark.createDataFrame(truth, "s string, k bigint, row bigint, label string, col string, value double")
    return t, spark.createDataFrame(output, "s string, k bigint, out_row bigint, label string, out_col bigint, header string, value double")


def test_groups_may_be_several_rows_that_stand_together(spark):
    """A row for each cell, over batches of three rows: the results of gathered groups."""
    t, o = many_cells(spark, random.Random(7))
    cells = [F.array(F.struct(*[F.col(c) for c in df.columns if c not in "sk"])) for df in (t, o)]
    whole = gathered(t, o, ["s", "k"])
    kind = dict(whole.dtypes)
    pieces = t.select("s", "k", cells[0].alias("a"), F.lit(None).cast(kind["b"]).alias("b")).union(o.select("s", "k", F.lit(None).cast(kind["a"]), cells[1]))
    pieces = pieces.repartition(3, "k").sortWithinPartitions("k", F.rand(1))
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert rows(outcomes_of(pieces, ["s", "k"], together=["k"])) == rows(outcomes(t, o, ["s", "k"]))
        (x,), (y,) = (df.collect() for df in (label_errors_of(pieces, ["s", "k"], together=["k"]), label_errors(t, o, ["s", "k"])))
        assert (x.labels, x.found) == (y.labels, y.found) and x.found and x.cer == pytest.approx(y.cer) and x.wer == pytest.approx(y.wer)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert stated_rows(t, o, ["s", "k"]).count() >= x.found


def test_statements_of_queries_move_lines_once(spark, sf):
    """One exchange and one sort for the lines; cells of both systems are looked at once."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    cells = plan(fact_queries.h02_cell_outcomes(spark, sf))
    assert cells.count("Exchange hashpartitioning") == 1 and cells.count("Sort [") == 1 and cells.count("Aggregate") == 0
    assert plan(fact_queries.h02_h04_outcomes_by_system(spark, sf)).count("MapInArrow") == 1
    labels = plan(fact_queries.h10_label_errors(spark, sf))
    assert labels.count("MapInArrow") == 1 and labels.count("Exchange hashpartitioning(stmt") == 1


def test_shares_and_statements_of_one_pass(spark):
    """Those of the two passes that are joined."""
    rnd = random.Random(11)
    names = [*OUTCOMES, "misread or omitted"]
    rows = [(rnd.choice("xy"), rnd.randint(0, 30), rnd.choice(["complete", "complete", *names])) for _ in range(200)]
    cells = spark.createDataFrame(rows, "system string, stmt bigint, outcome string").select("*", (F.col("outcome") == "complete").alias("right"), (F.col("outcome") == "wrong sign").alias("critical"))
    got = facts.shares_by_statement(cells, names, ["stmt"])
    want = facts.outcome_shares(cells, names).join(facts.statement_level(cells, ["stmt"]), "system")
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rates_count_equal_pairs_of_labels_as_often_as_they_are(spark):
    """Three labels read well and one cut short: rates are found once a pair and weighted."""
    true = [(k, 0, "Cash at bank", "2024", 5.0) for k in range(4)] + [(9, 0, "Loans", "2024", 1.0)]
    t = spark.createDataFrame(true, "k bigint, row bigint, label string, col string, value double")
    o = spark.createDataFrame([(k, 0, "Cash at bank" if k else "Cash at ban", 0, "2024", 5.0) for k in range(4)], "k bigint, out_row bigint, label string, out_col bigint, header string, value double")
    found = label_errors(t, o, ["k"])
    (r,) = found.collect()
    assert (r.labels, r.found) == (5, 4) and r.cer == pytest.approx(1 / 12 / 4) and r.wer == pytest.approx(1 / 3 / 4)
    assert "_printed" in found._jdf.queryExecution().executedPlan().toString()  # pairs are counted before they are compared
