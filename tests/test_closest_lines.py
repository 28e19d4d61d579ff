import random
import time
from collections import Counter

import numpy as np

from pagetally.functions.distance import Bigrams, Subsequences, best_window
from pagetally.operators import matching


def test_bounds_of_bigrams():
    """No window is more similar than the bound, which is 100 for texts that hold the other."""
    rnd = random.Random(7)
    for letters in ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz ن😀"):
        text = lambda: "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 5, 9, 9, 40])))  # noqa: B023, E731
        a = [text() for _ in range(120)]
        b = [text() for _ in range(60)] + [text() + x + text() for x in a[:30]] + ["".join(rnd.choice([c, c, c, "z", ""]) for c in x) for x in a[30:60]]
        mine, theirs, columns = Bigrams(a), Bigrams(b), Subsequences(b)
        for i, x in enumerate(a):
            bounds = mine.bounds(i, theirs, np.arange(len(b)))
            exact = np.array([best_window(x, y) for y in b])
            assert (bounds >= exact).all()
            assert (bounds[exact == 100] >= 100).all()
            some = np.array(rnd.sample(range(len(b)), 50))
            assert (columns.bounds(x, some) >= exact[some]).all()
    far = Bigrams(["abcdefghijkl"]).bounds(0, Bigrams(["mnopqrstuvwxyz"]), np.arange(1))
    assert far[0] < 71


def group(rnd, n, words):
    """Rows and lines of one group: labels that lines repeat with a slip of the pen, some that no line has, a figure that
    most lines share, and lines of equal text."""
    names = [" ".join(rnd.choice(words) for _ in range(4)) for _ in range(n)]
    slip = lambda x: x[: (k := rnd.randrange(len(x)))] + rnd.choice("xyz") + x[k + 1 :]
    rows = [("g", i, rnd.choice(names) if rnd.random() < 0.95 else f"qq{i} vv{i} ww{i}", [float(rnd.choice([2020, n + i]))] if rnd.random() < 0.02 else [float(n + i)]) for i in range(n)]
    lines = [("g", i, slip(x) + " 12,345", [2020.0 if rnd.random() < 0.5 else -1.0 - i]) for i, x in enumerate(rnd.choices(names, k=n))]
    return rows, lines


def test_large_group_equals_all_pairs(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(60)]
    rows, lines = group(rnd, 130, words)
    want = {}
    for _, i, label, values in rows:
        need = Counter(values)
        want[i] = max((sum((need & Counter(held)).values()), best_window(label, text), -at) for _, at, text, held in lines)
    frames = [spark.createDataFrame(data, f"g string, {k} int, {t} string, values array<double>") for data, k, t in ((rows, "row_id", "label"), (lines, "line_no", "text"))]
    got = matching.closest_line(*frames, ["g"]).collect()
    assert {r.row_id: (r.shared, r.similarity, -r.line_no) for r in got} == want


def test_group_of_many_rows_and_lines(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 10))) for _ in range(3000)]
    rows, lines = group(rnd, 4000, words)
    rows = [r for r in rows if not r[2].startswith("qq")]
    frames = [spark.createDataFrame(data, f"g string, {k} int, {t} string, values array<double>") for data, k, t in ((rows, "row_id", "label"), (lines, "line_no", "text"))]
    began = time.time()
    got = matching.missed_rows(*frames, ["g"]).collect()
    assert time.time() - began < 60
    # every label stands in a line but for one letter, unless no line drew it
    assert sum(r.similarity >= 90 for r in got) > 0.55 * len(got)
