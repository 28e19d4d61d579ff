"""Signed totals, anchoring and repairs against exhaustive search."""

import itertools
import random
import time
from math import comb, prod

from pagetally.operators.anchoring import anchored, repair_groups, repairs
from pagetally.operators.signed import CHANCE, MOST_MINUS, relations_with_signs, signed_totals


def exhaustive(table, tolerance=1.0):
    """Every run and every choice of subtracted lines, along both axes."""
    out = []
    width = max(map(len, table), default=0)
    full = [[r[c] if c < len(r) else None for c in range(width)] for r in table]
    for axis, lines in (("rows", full), ("columns", [list(x) for x in zip(*full, strict=True)])):
        for target in range(2, len(lines)):
            columns = [c for c, v in enumerate(lines[target]) if v is not None]
            if not any(abs(lines[target][c]) >= 1000 for c in columns):
                continue
            rows = [r for r in range(target) if any(lines[r][c] is not None for c in columns)]
            alone = prod(min(1.0, (2 * round(tolerance * 100) + 1) / (2 * max(abs(round((x[c] or 0) * 100)) for x in lines) + 1)) for c in columns)
            best = None
            for length in range(2, len(rows) + 1):
                run = rows[len(rows) - length :]
                for m in range(min(MOST_MINUS, length - 1) + 1):
                    if comb(length, m) * len(rows) * alone >= CHANCE:
                        continue
                    for minus in itertools.combinations(run, m):
                        sums = [sum(-(lines[r][c] or 0) if r in minus else (lines[r][c] or 0) for r in run) for c in columns]
                        if all(abs(s - lines[target][c]) <= tolerance + 1e-9 for s, c in zip(sums, columns, strict=True)):
                            best = min(best or (99,), (m, length, minus))
            if best:
                out.append((axis, target, rows[len(rows) - best[1]], list(best[2])))
    return out


def test_signed_totals_equal_exhaustive_search():
    rnd = random.Random(1)
    found = set()
    for k in range(150):
        rows = []
        for _ in range(rnd.randint(3, 13 if k % 10 else 16)):
            rows.append([rnd.choice([None, float(rnd.randint(-90000, 900000)), float(rnd.randint(1, 9) * 1000)]) if rnd.random() < 0.9 else None for _ in range(rnd.randint(1, 3))])
            if len(rows) > 2 and rnd.random() < 0.5:  # a total of a run, some subtracted
                at = rnd.randrange(len(rows) - 1)
                run = rows[at:]
                signs = [-1 if rnd.random() < 0.3 else 1 for _ in run]
                rows.append([sum(s * ((r[c] if c < len(r) else None) or 0) for s, r in zip(signs, run, strict=True)) + rnd.choice([0, 0, 0.5, 3]) for c in range(max(map(len, run)))])
        if k % 4 == 0:  # a last column that is the first two's sum or difference
            sign = rnd.choice([1, 1, -1])
            rows = [[r[0], r[1], None if r[0] is None and r[1] is None else (r[0] or 0) + sign * (r[1] or 0)] if len(r) > 1 else r for r in rows]
        got = signed_totals(rows)
        assert got == exhaustive(rows)
        found |= {(axis, len(minus)) for axis, *_, minus in got}
    assert {("rows", m) for m in range(4)} <= found and ("columns", 0) in found
    assert signed_totals([]) == [] and signed_totals([[]]) == [] and signed_totals([[1.0], [float("nan")], [float("inf")]]) == []


def test_sixty_rows_in_time():
    rnd = random.Random(2)
    rows = [[float(rnd.randint(10**6, 10**8)) for _ in range(2)] for _ in range(59)]
    minus = [3, 17, 40, 58]
    rows.append([sum(-r[c] if i in minus else r[c] for i, r in enumerate(rows)) for c in range(2)])
    began = time.time()
    assert ("rows", 59, 0, minus) in signed_totals(rows)
    assert time.time() - began < 30


def test_relations_with_signs_of_rows(spark):
    df = spark.createDataFrame([([[5000.0], [2000.0], [3000.0]],), ([[5000.0, None]],), (None,), ([],)], "t array<array<double>>")
    got = [r.f for r in df.select(relations_with_signs(df.t).alias("f")).collect()]
    assert [[tuple(x) for x in f] if f is not None else None for f in got] == [[("rows", 2, 0, [1])], [], None, []]


def all_edits(value, places):
    """Every number that one digit less, more or another makes of a figure."""
    text = str(round(abs(value) * 10**places)).zfill(places + 1)
    out = {text[:i] + text[i + 1 :] for i in range(len(text)) if len(text) > 1}
    out |= {text[:i] + d + text[i:] for i in range(len(text) + 1) for d in "0123456789"}
    out |= {text[:i] + d + text[i + 1 :] for i in range(len(text)) for d in "0123456789"}
    return {int(t) / 10**places * (-1 if value < 0 else 1) for t in out} - {value}


def brute(values, links, tolerance):
    gaps = lambda v: {t: v[t] - sum(s * v[x] for x, s in parts if x in v) for t, parts in links.items() if t in v and any(x in v for x, _ in parts)}
    members = {t: {t} | {x for x, _ in links[t] if x in values} for t in gaps(values)}
    fails = {t for t, g in gaps(values).items() if abs(g) > tolerance}
    groups = [{t} for t in fails]
    merged = True
    while merged:
        merged = False
        for a, b in itertools.combinations(groups, 2):
            if any(members[x] & members[y] for x in a for y in b):
                groups = [g for g in groups if g not in (a, b)] + [a | b]
                merged = True
                break
    out = []
    for group in groups:
        found = set()
        for name, old in values.items():
            places = next((k for k in (0, 1) if round(old, 2) == round(old, k)), 2)
            for new in all_edits(old, places):
                after = gaps(values | {name: new})
                own = {t for t in members if name in members[t]}
                if group <= own and all(abs(after[t]) <= tolerance + 1e-6 for t in own):
                    found.add((name, old, new))
        if len(found) == 1:
            out.append((*found.pop(), len(group)))
    return sorted(out)


def test_repairs_equal_all_single_edits():
    rnd = random.Random(3)
    mended = set()
    for _ in range(400):
        items = {f"r{i}": float(rnd.choice([rnd.randint(-500, 9999), rnd.randint(0, 99) / 4])) for i in range(6)}
        links = {"a": [("r0", 1), ("r1", 1), ("r2", -1)], "b": [("r3", 1), ("r4", 1), ("r5", 1)], "c": [("a", 1), ("b", 1)], "d": [("r2", 1), ("r5", 1)]}
        values = dict(items)
        for t in "abdc":
            values[t] = sum(s * values[x] for x, s in links[t])
        for _ in range(rnd.randint(0, 2)):
            name = rnd.choice(sorted(values))
            values[name] = rnd.choice(sorted(all_edits(values[name], 0 if values[name] == int(values[name]) else 2)))
        if rnd.random() < 0.2:
            values.pop(rnd.choice(sorted(values)))
        got = repairs(values, links, 0.5)
        assert got == brute(values, links, 0.5)
        mended |= {(len(got), r[3]) for r in got}
    assert (1, 2) in mended and (2, 1) in mended


def test_anchored_and_suspect_figures(spark):
    cells = [("r1", 1.0), ("r2", 2.0), ("r3", 4.0), ("r4", 5.0), ("a", 3.0), ("b", 90.0), ("c", 12.0), ("x", 7.0), ("blank", None)]
    links = [("a", "r1", 1), ("a", "r2", 1), ("b", "r3", 1), ("b", "r4", 1), ("c", "a", 1), ("c", "b", 1)]
    c = spark.createDataFrame([("s", r, "v", v) for r, v in cells], "k string, row_id string, col string, value double")
    e = spark.createDataFrame([("s", *x) for x in links], "k string, total string, ref string, sign int")
    got = {r.row_id: (r.holding, r.failing, r.anchored, r.suspect) for r in anchored(c, e, ["k"], 0.5).collect()}
    assert got == {"r1": (1, 0, True, False), "r2": (1, 0, True, False), "a": (1, 1, True, False), "b": (0, 2, False, True), "r3": (0, 1, False, True), "r4": (0, 1, False, True), "c": (0, 1, False, True), "x": (0, 0, False, False)}
    assert [tuple(r) for r in repair_groups(c, e, ["k"], 0.5).collect()] == [("s", "v", "b", 90.0, 9.0, 2)]
    clash = spark.createDataFrame([("s", r, "v", v) for r, v in [("a", 3.0), ("r1", 1.0), ("r2", 2.0), ("d", 9.0), ("e", 3.0), ("f", 9.0)]], c.schema)
    more = spark.createDataFrame([("s", "a", "r1", 1), ("s", "a", "r2", 1), ("s", "d", "f", 1), ("s", "d", "a", 1), ("s", "e", "a", 1), ("s", "g", "d", 1), ("s", "f", "d", 1)], e.schema)
    flags = {r.row_id: (r.anchored, r.suspect) for r in anchored(clash, more, ["k"], 0.5).collect()}
    assert flags["a"] == (True, True) and flags["d"] == (True, True) and flags["r1"] == (True, False)


def test_tables_together_as_one_by_one():
    """A batch of tables, whole and with gaps, of few rows and many, gives what each sum tried in turn gives, and each table is not tried by itself."""
    from pagetally.operators import signed

    rng = random.Random(8)
    tables = [None, [], [[]]]
    for _ in range(400):
        rows = [[rng.choice([None, float(rng.randint(1, 90_000)), float(rng.randint(1, 90_000))]) for _ in range(rng.choice([1, 2, 3]))] for _ in range(rng.choice([2, 4, 6, 14]))]
        rows.append([sum(rng.choice([1, 1, 1, -1]) * (r[c] or 0.0) for r in rows if c < len(r)) for c in range(2)])
        tables.append(rows)
    tables = signed.pa.array(tables, signed.TABLES)
    limit = round(1.0 * signed.SCALE)
    want = []
    for cells, there in signed._tables_of(tables):
        here = []
        for axis, x, y in (("rows", cells, there), ("columns", cells.T, there.T)):
            for target, rows, *problem in signed._problems(x, y, limit):
                hit = signed._solved(*problem, limit, MOST_MINUS, CHANCE)
                if hit:
                    here.append((axis, target, int(rows[len(rows) - hit[0]]), [int(rows[k]) for k in hit[1]]))
        want.append(here)
    assert signed.signed_totals_of(tables, 1.0, MOST_MINUS, CHANCE) == want
    assert sum(map(bool, want)) > 100 and any(minus for here in want for *_, minus in here)
