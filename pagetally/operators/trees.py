"""Tree edit distance between tables (TEDS, TEDS-S): an Arrow function over pairs of HTML texts."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.functions.distance import _distance, distance_grid

#: Pairs of nodes from which on trees are compared with arrays, and up to which (24 bytes each); beyond, an error.
FEW_PAIRS, MOST_PAIRS = 900, 40_000_000
KEEP = {"table", "thead", "tbody", "tr", "td", "th"}
#: What is open in a table ends where one of these begins.
ENDS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "thead": {"thead", "tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: A tag of a table without attributes; where nothing else begins or is escaped, the parser sees just these and texts.
PLAIN = re.compile(r"<(/?(?:table|thead|tbody|tr|td|th))>")


class _Tree(HTMLParser):
    """Nodes (label, text, children) of the table tags; other tags' text stays with their cell. A cell ends where the next
    cell, row or part begins, a row where the next row or part does, and nothing around a table ends inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root: list = ["root", "", []]
        self.path = [self.root]

    def _within(self, tags: set) -> int | None:
        """Where the outermost open one of these tags in the innermost table is."""
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i][0] == "table":
                return next((k for k in range(i + 1, len(self.path)) if self.path[k][0].split(" ")[0] in tags), None)
        return None

    def handle_starttag(self, tag, attrs):
        if tag in KEEP:
            # end tags that HTML lets authors leave out
            at = self._within(ENDS.get(tag, set()))
            if at is not None:
                del self.path[at:]
            if tag in ("td", "th"):
                spans = dict(attrs)
                label = f"{tag} {spans.get('rowspan') or 1} {spans.get('colspan') or 1}"
            else:
                label = tag
            node = [label, "", []]
            self.path[-1][2].append(node)
            self.path.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.path) - 1, 0, -1):
            name = self.path[i][0].split(" ")[0]
            if name == tag:
                del self.path[i:]
                break
            if name == "table":  # what is open around a table does not end in it
                break

    def handle_data(self, data):
        if self.path[-1][0][:2] in ("td", "th"):
            self.path[-1][1] += data


def _postorder(node, out: list) -> None:
    """Appends (label, text, leftmost leaf) in postorder, however deep the tree is."""
    stack = [(node, iter(node[2]), len(out))]
    while stack:
        node, children, first = stack[-1]
        child = next(children, None)
        if child is not None:
            stack.append((child, iter(child[2]), len(out)))
        else:
            stack.pop()
            out.append((node[0], " ".join(node[1].split()), first))


def _nodes(html: str) -> list:
    tree = _Tree()
    parts = PLAIN.split(html)
    if "&" in html or any("<" in text for text in parts[::2]):
        tree.feed(html)
        tree.close()
    else:
        for i, part in enumerate(parts):
            if not i % 2:
                tree.handle_data(part)
            elif part[0] == "/":
                tree.handle_endtag(part[1:])
            else:
                tree.handle_starttag(part, ())
    out: list = []
    for child in tree.root[2]:
        if child[0] == "table":
            _postorder(child, out)
            break
    return out


def _renames(a: list, b: list, texts: bool) -> np.ndarray:
    """What it costs to rename each node of a to each of b."""
    codes: dict[str, int] = {}
    of = [np.array([codes.setdefault(x[0], len(codes)) for x in t]) for t in (a, b)]
    out = (of[0][:, None] != of[1][None, :]).astype(float)
    if texts:
        cells = [[i for i, x in enumerate(t) if x[0][:2] in ("td", "th")] for t in (a, b)]
        known = [{t: k for k, t in enumerate(dict.fromkeys(tree[i][1] for i in which))} for tree, which in zip((a, b), cells, strict=True)]
        if cells[0] and cells[1]:
            names = [list(k) for k in known]
            longest = np.maximum.outer(*[[max(1, len(x)) for x in side] for side in names])
            apart = distance_grid(*names) / longest
            place = [np.array([k[tree[i][1]] for i in which]) for k, tree, which in zip(known, (a, b), cells, strict=True)]
            at = np.ix_(cells[0], cells[1])
            out[at] = np.maximum(out[at], np.where(out[at] < 1, apart[np.ix_(*place)], 1.0))
    return out


def _forest(cost, dist, leaf_a, leaf_b, i: int, j: int) -> None:
    """Distances of the subtrees of keyroots i and j, and of those on the paths to their first leaves; a row at a time,
    the tree with fewer nodes giving the rows."""
    if i - leaf_a[i] > j - leaf_b[j]:
        cost, dist, leaf_a, leaf_b, i, j = cost.T, dist.T, leaf_b, leaf_a, j, i
    li, lj = int(leaf_a[i]), int(leaf_b[j])
    m = j - lj + 1
    step = np.arange(m + 1.0)
    tree = leaf_b[lj : j + 1] == lj
    back = leaf_b[lj : j + 1] - lj
    f = np.empty((i - li + 2, m + 1))
    f[0] = step
    for p in range(li, i + 1):
        above, here = f[p - li], f[p - li + 1]
        least = f[leaf_a[p] - li][back] + dist[p, lj : j + 1]
        whole = leaf_a[p] == li
        if whole:
            least = np.where(tree, above[:-1] + cost[p, lj : j + 1], least)
        here[0] = p - li + 1
        np.minimum(least, above[1:] + 1, out=here[1:])
        here[:] = np.minimum.accumulate(here - step) + step  # insertions along the row
        if whole:
            dist[p, lj : j + 1][tree] = here[1:][tree]


def _rows_apart(cost, dist, leaf_a, leaf_b, stars_a, stars_b) -> None:
    """Distances of all pairs of nodes that have leaves alone (rows of cells) and cost nothing to rename: those of their
    leaves' sequences, for all rows of two widths at once."""
    wide = [{}, {}]
    for side, (leaf, stars) in enumerate(((leaf_a, stars_a), (leaf_b, stars_b))):
        for i in stars:
            wide[side].setdefault(int(i - leaf[i]), []).append(int(i))
    for n, left in wide[0].items():
        for m, right in wide[1].items():
            part = max(1, (1 << 21) // ((m + 1) * len(right)))
            for at in range(0, len(left), part):
                some = np.array(left[at : at + part])
                first, other = some - n, np.array(right) - m
                line = np.broadcast_to(np.arange(m + 1.0)[:, None, None], (m + 1, len(some), len(right))).copy()
                for x in range(n):
                    corner = line[0].copy()
                    line[0] = x + 1
                    for y in range(m):
                        corner, line[y + 1] = line[y + 1].copy(), np.minimum(np.minimum(line[y + 1], line[y]) + 1, corner + cost[np.ix_(first + x, other + y)])
                at_ = np.ix_(some, right)
                dist[at_] = np.where(cost[at_] == 0, line[m], dist[at_])


def large_distance(a: list, b: list, texts: bool) -> float:
    """``edit_distance`` of large trees. Leaves and rows of cells, nearly all subtrees of a table, are compared together;
    what is left of the decomposition into paths goes row by row. Needs 24 bytes for each pair of nodes."""
    n, m = len(a), len(b)
    if n * m > MOST_PAIRS:
        raise ValueError(f"tables of {n} and {m} nodes are too large to compare")
    cost = _renames(a, b, texts)
    leaf_a, leaf_b = (np.array([x[2] for x in t]) for t in (a, b))
    dist = np.full((n, m), np.inf)
    shapes = []
    for leaf in (leaf_a, leaf_b):
        number = np.arange(len(leaf))
        bare = leaf == number
        inner = np.r_[0, np.cumsum(~bare)]
        shapes.append((number, bare, np.flatnonzero(~bare & (inner[number] == inner[leaf]))))
    (rows, bare_a, stars_a), (columns, bare_b, stars_b) = shapes
    dist[np.ix_(bare_a, bare_b)] = cost[np.ix_(bare_a, bare_b)]
    for c, d, bare, leaf, number in ((cost, dist, bare_a, leaf_b, columns), (cost.T, dist.T, bare_b, leaf_a, rows)):
        single, deep = np.flatnonzero(bare), np.flatnonzero(leaf != number)
        if len(single) and len(deep):  # a leaf becomes the node that it is nearest to, and all others are inserted
            for part in np.array_split(single, len(single) * len(leaf) // (1 << 22) + 1):
                ends = np.c_[leaf[deep], deep + 1].ravel()
                padded = np.c_[c[part], np.full(len(part), np.inf)]
                d[np.ix_(part, deep)] = np.minimum.reduceat(padded, ends, axis=1)[:, ::2] + (deep - leaf[deep])
    _rows_apart(cost, dist, leaf_a, leaf_b, stars_a, stars_b)
    roots = []
    for leaf in (leaf_a, leaf_b):
        path: dict[int, list[int]] = {}
        for i, first in enumerate(leaf.tolist()):
            path.setdefault(first, []).append(i)
        roots.append(sorted((p[-1], p) for p in path.values()))
    for i, path_a in roots[0]:
        for j, path_b in roots[1]:
            if len(path_a) > 1 and len(path_b) > 1 and np.isinf(dist[np.ix_(path_a, path_b)]).any():
                _forest(cost, dist, leaf_a, leaf_b, i, j)
    return float(dist[n - 1, m - 1])


def edit_distance(a: list, b: list, texts: bool) -> float:
    """Zhang and Shasha's ordered tree edit distance; inserting and deleting cost 1, renaming 1, and two equal
    cells the normalised distance of their texts."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n + m)
    return large_distance(a, b, texts) if n * m > FEW_PAIRS else small_distance(a, b, texts)


def small_distance(a: list, b: list, texts: bool) -> float:
    """``edit_distance`` of trees of few nodes, for which arrays do not pay."""
    n, m = len(a), len(b)
    keyroots = lambda t: sorted({leaf: i for i, (_, _, leaf) in enumerate(t)}.values())
    known: dict[tuple[str, str], float] = {}

    def rename(x, y):
        if x[0] != y[0]:
            return 1.0
        if not texts or x[1] == y[1] or x[0][:2] not in ("td", "th"):
            return 0.0
        pair = (x[1], y[1])
        if pair not in known:
            known[pair] = _distance(*pair) / max(len(x[1]), len(y[1]))
        return known[pair]

    leaf_a, leaf_b = [t[2] for t in a], [t[2] for t in b]
    dist = [[0.0] * m for _ in range(n)]
    roots_b = keyroots(b)
    for i in keyroots(a):
        li = leaf_a[i]
        for j in roots_b:
            lj = leaf_b[j]
            f = [[float(y) for y in range(j - lj + 2)]]
            for p in range(li, i + 1):
                above, row, left = f[-1], [float(p - li + 1)], float(p - li + 1)
                whole, before, known_row = leaf_a[p] == li, f[leaf_a[p] - li], dist[p]
                for y, q in enumerate(range(lj, j + 1), 1):
                    tree = whole and leaf_b[q] == lj
                    least = above[y - 1] + rename(a[p], b[q]) if tree else before[leaf_b[q] - lj] + known_row[q]
                    if above[y] + 1 < least:
                        least = above[y] + 1
                    if left + 1 < least:
                        least = left + 1
                    if tree:
                        known_row[q] = least
                    left = least
                    row.append(least)
                f.append(row)
    return dist[n - 1][m - 1]


def _similar(a: list, b: list, texts: bool) -> float:
    most = max(len(a), len(b))
    return 1 - edit_distance(a, b, texts) / most if most and a != b else 1.0


def teds(truth: str, output: str, texts: bool = True) -> float:
    """1 for equal tables; nodes of the larger tree in the denominator."""
    return _similar(_nodes(truth), _nodes(output), texts)


#: Of so many pairs of bare structures, in so many nodes at most, a task remembers the similarity.
STRUCTURES, SMALL = 10_000, 200


def _scorer(texts: bool):
    known: dict[tuple, float] = {}

    def one(truth: str, output: str) -> float:
        a, b = _nodes(truth), _nodes(output)
        if texts or len(a) + len(b) > SMALL:
            return _similar(a, b, texts)
        pair = tuple((label, leaf) for label, _, leaf in a), tuple((label, leaf) for label, _, leaf in b)
        if pair not in known:
            if len(known) >= STRUCTURES:
                known.clear()
            known[pair] = _similar(a, b, texts)
        return known[pair]

    @F.pandas_udf(T.DoubleType())
    def score(truth: pd.Series, output: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or o is None else one(t, o) for t, o in zip(truth, output, strict=True)], dtype="Float64")

    return score


def tree_similarity(truth: Column, output: Column, texts: bool = True) -> Column:
    """TEDS, or TEDS-S (structure alone) with ``texts=False``."""
    return _scorer(texts)(truth, output)
