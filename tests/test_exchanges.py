"""How often the data of a step moves: each query here gathers its groups once."""

import contextlib
import io
import random

from pyspark.sql import functions as F

from pagetally.operators import selection
from pagetally.operators.anchoring import anchored
from pagetally.operators.reconcile import covered
from pagetally.operators.signed import relations_with_signs
from pagetally.plans import catalog


def exchanges(df):
    """Shuffles in the plan, each one that is used again counted once."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return sum("Exchange hashpartitioning" in line and "ReusedExchange" not in line for line in out.getvalue().splitlines())


def test_best_by_truth_moves_its_inputs_and_result_once(spark, sf):
    assert exchanges(catalog.QUERIES["f06_best_by_truth"](spark, sf)) <= 3


def test_best_by_truth_against_all_pairs(spark):
    rng = random.Random(5)
    odd = [1.0, 2.0, 0.0, -0.0, float("nan"), None]
    some = lambda: {v: rng.choice([1, 2]) for v in rng.sample(odd, rng.choice([1, 1, 2, 3]))}
    truth = {(k, r): some() for k in range(12) for r in range(rng.choice([1, 4, 9]))}
    read = {(k, run, n): some() for k in range(1, 13) for run in "ab" for n in range(rng.choice([1, 5]))}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = frame([(k, r, v, n) for (k, r), p in truth.items() for v, n in p.items()], "page int, row_id int, value double, n long")
    lines = frame([(k, run, ord(run), i, v, n) for (k, run, i), p in read.items() for v, n in p.items()], "page int, run string, pos int, line_no int, value double, n long")
    same = lambda v, w: v is not None and w is not None and (v == w or v != v and w != w)
    holds = lambda line, row: all(any(same(v, w) and m >= n for w, m in line.items()) for v, n in row.items())
    want = {}
    for k in range(1, 12):
        hits = {run: sum(any(holds(p, row) for (page, name, _), p in read.items() if (page, name) == (k, run)) for (page, _), row in truth.items() if page == k) for run in "ab"}
        best = min("ab", key=lambda run: (-hits[run], run))
        want[k] = (best, hits[best])
    assert {r.page: (r.run, r.hits) for r in selection.best_by_truth(rows, lines, ["page"], "run", "pos").collect()} == want


def test_statements_are_gathered_once(spark, sf):
    for name in ("g10_anchored_figures", "i02_tiers_from_relations", "g10_repairs_over_totals"):
        assert exchanges(catalog.QUERIES[name](spark, sf)) <= 2
    assert exchanges(catalog.QUERIES["e05_g08_coverage"](spark, sf)) <= 4


def plain_flags(figures, links, tolerance):
    """(holding, failing, suspect) by (row, column), by going through all relations."""
    relations = []
    for total in {t for t, _, _ in links}:
        for col in {c for _, c in figures}:
            parts = [(r, s) for t, r, s in links if t == total and (r, col) in figures]
            if parts and (total, col) in figures:
                ok = abs(figures[total, col] - sum(s * figures[r, col] for r, s in parts)) <= tolerance
                relations.append(({(r, col) for r, _ in parts} | {(total, col)}, ok))
    holding = {f: sum(f in m and ok for m, ok in relations) for f in figures}
    failing = {f: sum(f in m and not ok for m, ok in relations) for f in figures}
    clash = set().union(*[m for m, ok in relations if not ok and all(holding[f] for f in m)])
    return {f: (holding[f], failing[f], failing[f] > 0 and (holding[f] == 0 or f in clash)) for f in figures}


def test_anchored_and_covered_against_all_relations(spark):
    rng = random.Random(9)
    figures, links = {}, {}
    for k in range(60):
        rows = [f"r{n}" for n in range(rng.choice([1, 3, 7]))]
        figures[k] = {(r, c): float(rng.choice([1, 2, 3])) for r in rows for c in "xy" if rng.random() < 0.8}
        links[k] = list({(t, r): (t, r, rng.choice([1, -1])) for _ in range(rng.choice([0, 2, 6])) for t in [rng.choice(rows)] for r in [rng.choice(["r0", "r1", "r2", "gone"])] if t != r}.values())
    cells = spark.createDataFrame([(k, *f, v) for k, here in figures.items() for f, v in here.items()] + [(0, "blank", "x", None), (0, None, "x", 1.0)], "k int, row_id string, col string, value double")
    edges = spark.createDataFrame([(k, *x) for k, here in links.items() for x in here] + [(0, None, "r0", 1), (0, "r0", None, 1), (999, "r0", "r1", 1)], "k int, total string, ref string, sign int")
    got = {(r.k, r.row_id, r.col): (r.holding, r.failing, r.suspect) for r in anchored(cells, edges, ["k"], 0.5).collect()}
    want = {(k, *f): flags for k in figures for f, flags in plain_flags(figures[k], links[k], 0.5).items()}
    assert got == want | {(0, None, "x"): (0, 0, False)}
    assert any(s for _, _, s in want.values()) and any(h for h, _, _ in want.values())
    hit = {(k, r, c) for k in figures for t, ref, _ in links[k] for r, c in figures[k] if r == ref and (t, c) in figures[k] or r == t}
    assert {(r.k, r.row_id, r.col) for r in covered(cells, edges, ["k"]).where("covered").collect()} == hit


def test_batches_of_empty_tables(spark):
    for rows in ([(None,)], [([],)], [([[]],)], [([[], []],), (None,)]):
        df = spark.createDataFrame(rows, "t array<array<double>>")
        assert df.select(F.size(relations_with_signs(F.col("t"))).alias("n")).where("n > 0").count() == 0
