import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetally.functions.loops import _cuts, cut_tandem, runs
from pagetally.operators import nearest



def naive(items, times, least):
    """Elements that stay: every start and every period is tried."""
    n = len(items)
    for s in range(n):
        for p in range(1, (n - s) // times + 1):
            e = s + p
            while e < n and items[e] == items[e - p]:
                e += 1
            if e - s >= max(times * p, least):
                return s + p
    return None


@pytest.mark.parametrize("times", [3, 4, 8])
def test_loops_equal_naive_search(times):
    rnd = random.Random(times)
    texts = []
    for _ in range(700):
        parts = [rnd.choice("abc") for _ in range(rnd.randint(0, 12))]
        unit = [rnd.choice("ab") for _ in range(rnd.randint(1, 7))]
        parts += unit * rnd.randint(0, 12) + unit[: rnd.randint(0, len(unit))] + [rnd.choice("abc") for _ in range(rnd.randint(0, 9))]
        texts.append(" ".join(parts))
    for words in (True, False):
        for least in (0, 20):
            got = _cuts(texts, times, least, words)
            for t, kept in zip(texts, got, strict=True):
                assert kept == naive(t.split(" ") if words and t else list(t) if not words else [], times, least), (t, times, least)


def test_loops_of_a_long_text_in_time():
    rnd = random.Random(1)
    words = [str(rnd.randrange(50)) for _ in range(300_000)]
    words[200_000:200_000] = ["x", "y", "z"] * 4000
    began = time.time()
    assert _cuts([" ".join(words)], 8, 0, True) == [200_003]
    assert len(runs(np.zeros(200_000, np.int64), 8)) == 1
    assert time.time() - began < 20


def test_loops_inside_lines(spark):
    df = spark.createDataFrame([("head\n" + "12,345 " * 500 + "\ntail",), ("a b c",), (None,), ("",), ("no  loop here",)], "t string")
    assert [r.t for r in df.select(cut_tandem(F.col("t")).alias("t")).collect()] == ["head\n12,345", "a b c", None, "", "no  loop here"]
    assert df.select(cut_tandem(F.col("t"), words=False).alias("t")).first().t == "head\n12,345 "


def test_nearest_equals_all_pairs(spark):
    rnd = random.Random(3)
    left = [(k, rnd.choice("ab"), rnd.choice([None, *range(12)])) for k in range(80)]
    right = [(rnd.choice("abc"), rnd.choice([None, *range(-3, 15)]), rnd.choice("xyz")) for _ in range(14)]
    got = nearest.nearest(spark.createDataFrame(left, "id int, k string, row int"), spark.createDataFrame(right, "k string, row int, what string"), ["k"], "row", ["what"]).collect()
    for r in got:
        near = sorted((abs(p - r.row), p - r.row > 0, w, p - r.row) for k, p, w in right if k == r.k and p is not None and r.row is not None)
        assert (r.distance, r.what) == ((near[0][3], near[0][2]) if near else (None, None))
    assert len(got) == 80


def test_misplaced_labels(spark):
    lines = spark.createDataFrame([("f", 1, 0, "h", True), ("f", 1, 1, "a", False), ("f", 1, 2, "b", False), ("f", 1, 3, "c", False), ("f", 1, 6, "a", False), ("f", 2, 0, "z", False)], "f string, s int, row int, label string, heading boolean")
    cases = [(1, "b", "next"), (2, "a", "before"), (1, "h", "section heading"), (1, "c", "two lines off"), (3, "a", "two lines off"), (6, "b", "three or more"), (1, "z", "other statement"), (1, "q", "other cell"), (1, "a", "other cell"), (2, None, "other cell")]
    df = spark.createDataFrame([("f", 1, row, label, want) for row, label, want in cases], "f string, s int, row int, label string, want string")
    got = nearest.misplaced_offsets(df, lines, ["f", "s"], ["f"]).collect()
    assert [(r.label, r.want) for r in got if r.place != r.want] == [] and len(got) == len(cases)


def test_label_places(spark):
    t = lambda rows: spark.createDataFrame(rows, "p int, label string")
    got = nearest.label_places(t([(1, "a"), (1, "b"), (1, "c"), (1, None), (2, "a")]), t([(1, "a"), (2, "b")]), t([(1, "a"), (1, "b"), (1, "b")]), ["p"])
    assert {tuple(r) for r in got.collect()} == {(1, 1, 1, 2), (2, 0, 0, 1)}


def test_overlaps_equal_all_pairs(spark):
    rnd = random.Random(4)
    rect = lambda: (x := rnd.uniform(-50, 200), y := rnd.uniform(-50, 200), x + rnd.choice([0, 1, 16, 64, 130]), y + rnd.choice([-2, 5, 32, 96]))
    boxes, lines = [(rnd.randint(1, 2), k, *rect()) for k in range(60)], [(rnd.randint(1, 2), k, *rect()) for k in range(60)]
    boxes.append((1, 60, None, 0.0, 1.0, 1.0))
    schema = "page int, {} int, x0 double, y0 double, x1 double, y1 double"
    got = {(r.page, r.box, r.line): r.share for r in nearest.overlaps(spark.createDataFrame(boxes, schema.format("box")), spark.createDataFrame(lines, schema.format("line")), ["page"], cell=32.0).collect()}
    want = {}
    for p, b, *r in boxes[:-1]:
        for q, n, *s in lines:
            wide, tall = min(r[2], s[2]) - max(r[0], s[0]), min(r[3], s[3]) - max(r[1], s[1])
            if p == q and wide > 0 and tall > 0:
                want[p, b, n] = wide * tall / ((s[2] - s[0]) * (s[3] - s[1]))
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)
