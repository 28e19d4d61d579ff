"""Maximum-weight matching within groups, and the outcome of every true cell of a table from what an output holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.functions.distance import cer, similarities, wer
from pagetally.functions.figures import loose_years, loose_years_of
from pagetally.functions.text import key_of
from pagetally.operators.gathered import codes, flat, owners, places, ranges

MOST_EDGES = 4_000_000  # of one group; more raise
PAIR = pa.struct([("left", pa.int64()), ("right", pa.int64())])

#: A true cell's outcomes, best first, and what each adds to a matching: one better outcome outweighs all below it for one cell.
OUTCOMES = ["complete", "unresolved row", "unresolved column", "misplaced row", "misplaced column", "wrong sign"]
WORTH = {name: 1 << (len(OUTCOMES) - 1 - k) for k, name in enumerate(OUTCOMES)}
CRITICAL = ["misplaced row", "misplaced column", "wrong sign"]


def _components(edges: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Edges by connected component."""
    root: dict[int, int] = {}  # ends as numbers: lefts even, rights odd

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for left, right, _ in edges:
        x, y = find(2 * left), find(2 * right + 1)
        if x != y:
            root[x] = y
    parts: dict = {}
    for edge in edges:
        parts.setdefault(find(2 * edge[0]), []).append(edge)
    return list(parts.values())


def _heaviest(edges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The matching of one component: shortest augmenting paths with potentials (Hungarian method), one left after another.
    Costs are exact integers: the weight first, then, left by left, the place of its right, so equally heavy matchings
    have one order. A left may stay alone, which comes after all rights."""
    lefts, rights = sorted({e[0] for e in edges}), sorted({e[1] for e in edges})
    base = len(rights) + 2
    unit = base ** len(lefts)
    place, number = ({x: k for k, x in enumerate(xs)} for xs in (rights, lefts))
    best: dict[tuple[int, int], int] = {}
    for left, right, weight in edges:
        best[left, right] = max(weight, best.get((left, right), 0))
    reach: dict[int, list[tuple[int, int]]] = {}
    for (left, right), weight in best.items():
        if weight > 0:
            i = number[left]
            reach.setdefault(i, []).append((place[right], -weight * unit + (place[right] + 1) * base ** (len(lefts) - 1 - i)))
    alone = len(rights)
    owner: dict[int, int] = {}  # column to row
    row_price, column_price = [0] * len(lefts), {}
    for i in range(len(lefts)):
        reach.setdefault(i, []).append((alone + i, (alone + 1) * base ** (len(lefts) - 1 - i)))
    for i in range(len(lefts)):
        distance: dict[int, int] = {}
        came: dict[int, int] = {}
        done: dict[int, int] = {}
        row, so_far, column = i, 0, -1
        while True:
            for c, cost in reach[row]:
                if c not in done:
                    d = so_far + cost - row_price[row] - column_price.get(c, 0)
                    if c not in distance or d < distance[c]:
                        distance[c], came[c] = d, column
            column = min((c for c in distance if c not in done), key=lambda c: (distance[c], c))
            done[column] = so_far = distance[column]
            if column not in owner:
                break
            row = owner[column]
        row_price[i] += so_far
        for c, d in done.items():
            if c != column:
                row_price[owner[c]] += so_far - d
                column_price[c] = column_price.get(c, 0) - (so_far - d)
        while column >= 0:
            before = came[column]
            owner[column] = i if before < 0 else owner[before]
            column = before
    return [(lefts[i], rights[c]) for c, i in owner.items() if c < alone]


def heaviest(edges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(left, right) pairs of the heaviest matching of (left, right, weight), sorted; weights of 0 and less match nothing."""
    edges = [e for e in edges if e[2] > 0]
    if len({e[0] for e in edges}) == len(edges) == len({e[1] for e in edges}):
        return sorted(e[:2] for e in edges)  # no two share an end
    out = []
    for part in _components(edges):
        if len(part) == 1:
            out.append(part[0][:2])
        elif len(part) > 16:
            out += _heaviest(part)
        else:  # small ones are alike again and again: solved by the places of their ends
            lefts, rights = sorted({e[0] for e in part}), sorted({e[1] for e in part})
            place, number = ({x: k for k, x in enumerate(xs)} for xs in (rights, lefts))
            out += [(lefts[i], rights[k]) for i, k in _solved(tuple([(number[x], place[y], w) for x, y, w in part]))]
    return sorted(out)


@lru_cache(1 << 16)
def _solved(part: tuple[tuple[int, int, int], ...]) -> list[tuple[int, int]]:
    return _heaviest(list(part))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("left", T.LongType()), T.StructField("right", T.LongType())])))
def _matched(left: pa.Array, right: pa.Array, weight: pa.Array) -> pa.Array:
    ends = np.cumsum(left.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    flat = list(zip(*(a.flatten().to_pylist() for a in (left, right, weight)), strict=True))
    out, at = [], 0
    for end in ends:
        out.append([{"left": x, "right": y} for x, y in heaviest(flat[at:end])])
        at = end
    return pa.array(out, pa.list_(PAIR))


def matched(edges: DataFrame, keys: Sequence[str], most: int = MOST_EDGES) -> DataFrame:
    """(keys, left, right): within each group a one-to-one matching of the greatest total weight. edges: keys, left, right
    (bigint), weight (bigint; 0 and less: no edge). Of equally heavy matchings the one whose smallest left has the
    smallest right, then the next left, and so on. A component of connected edges is solved by itself; a group is
    one row of its edges, and one of more than ``most`` edges raises."""
    listed = edges.where("weight > 0").groupBy(*keys).agg(F.collect_list(F.struct("left", "right", "weight")).alias("e"))
    size = F.size("e")
    held = F.when(size > most, F.raise_error(F.concat(F.lit("a group has more edges than can be matched: "), size.cast("string")))).otherwise(F.col("e"))
    found = listed.select(*keys, held.alias("e"))
    return found.select(*keys, F.inline(_matched(F.col("e.left"), F.col("e.right"), F.col("e.weight"))))


def gathered(truth: DataFrame, output: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, a, b): each group of truth in one row, its cells beside those of its output. Grouping and join are by the group alone,
    so nothing is dealt out twice. A group is a statement, of a few dozen rows."""
    listed = lambda t, to: t.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in t.columns if c not in keys])).alias(to))
    return listed(truth, "a").join(listed(output, "b"), list(keys), "left")


def _ranks(values: pa.Array) -> np.ndarray:
    """Places of values in their order, alike where values are; -1 for null. What is no number comes last."""
    if pa.types.is_string(values.type):
        coded = values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        rank = np.full(len(words) + 1, -1)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        return rank[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)]
    found = np.unique(pc.fill_null(values, 0).to_numpy(zero_copy_only=False), return_inverse=True)[1].reshape(-1)
    return np.where(values.is_valid().to_numpy(zero_copy_only=False), found, -1)


class _Side:
    """The cells of a batch of groups, flat; their rows are numbered over the batch, by group and then by row. ``group``: each list's."""

    def __init__(self, lists: pa.ListArray, group: np.ndarray, row: str):
        self.owner, cells = group[owners(lists)], flat(lists)
        self.fields = {f.name: cells.field(k) for k, f in enumerate(cells.type)}
        self.value = self.fields["value"]
        place = _ranks(self.fields[row])
        wide = place.max(initial=-1) + 2
        number, first, self.row = np.unique(self.owner * wide + place + 1, return_index=True, return_inverse=True)
        self.group, self.rows = number // wide, self.fields[row].take(pa.array(first))

    def largest(self, rank: np.ndarray) -> np.ndarray:
        """Each row's largest rank of its cells, -1 if it has none."""
        found = np.full(len(self.group), -1)
        np.maximum.at(found, self.row, rank)
        return found


class _Labels:
    """The labels of both sides in their order (``words``), their keys, and each row's label by key; different ones are looked at once."""

    def __init__(self, a: _Side, b: _Side):
        both = pa.concat_arrays([a.fields["label"], b.fields["label"]])
        self.words = sorted(both.unique().drop_null().to_pylist())
        keyed = [key_of(w) for w in self.words]
        self.keys = sorted({"", *keyed})
        number = {k: i for i, k in enumerate(self.keys)}
        self.key = np.array([*[number[k] for k in keyed], 0], np.int64)  # 0 states nothing
        self.labels = np.split(_ranks(both), [len(a.owner)])
        self.named = [side.largest(self.key[rank]) for side, rank in zip((a, b), self.labels, strict=True)]


def _pairs(left: np.ndarray, right: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in left, place in right) of equal groups, right in order, in parts of about so many."""
    begin, count = places(left, right)
    ends = np.cumsum(count)
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        one, other = ranges(begin[at:stop], count[at:stop])
        yield one + at, other
        at = stop


def _check(edges: np.ndarray) -> None:
    if edges.max(initial=0) > MOST_EDGES:
        raise ValueError(f"a group has more edges than can be matched: {int(edges.max())}")


_SCORES: dict[tuple[str, str], float] = {}  # of keys that a worker has met, so many at most


def _scores(a: list[str], b: list[str], most: int = 1 << 18) -> np.ndarray:
    """``similarities``, of which a worker keeps those of its first different pairs."""
    found = [_SCORES.get(p) for p in zip(a, b, strict=True)]
    new = [i for i, score in enumerate(found) if score is None]
    for i, score in zip(new, similarities([a[i] for i in new], [b[i] for i in new]).tolist(), strict=True):
        found[i] = score
        if len(_SCORES) < most:
            _SCORES[a[i], b[i]] = score
    return np.array(found, np.float64)


def _alike(a: _Side, b: _Side, labels: _Labels, alike: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, similarity to a hundredth) of rows of one group whose keys are so much alike. A group's different keys are
    compared, each different pair once; their rows are only then paired."""
    many = len(labels.keys)
    known = []
    for side, named in zip((a, b), labels.named, strict=True):
        rows = np.flatnonzero(named > 0)
        code, count = np.unique(side.group[rows] * many + named[rows], return_counts=True)
        order = np.argsort(side.group[rows] * many + named[rows], kind="stable")
        known.append((code // many, code % many, count, np.cumsum(count) - count, rows[order]))
    (group, key, n, begin, rows), (out_group, out_key, m, out_begin, out_rows) = known
    left, right, score = [], [], []
    for one, other in _pairs(group, out_group):
        pair, at = np.unique(key[one] * many + out_key[other], return_inverse=True)
        found = _scores([labels.keys[k] for k in (pair // many).tolist()], [labels.keys[k] for k in (pair % many).tolist()])[at.reshape(-1)]
        near = np.flatnonzero(found >= alike)
        left.append(one[near]), right.append(other[near]), score.append(np.floor(found[near] * 100 + 0.5).astype(np.int64))
    left, right, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right, score))
    edges = n[left] * m[right]
    _check(np.bincount(group[left], edges))
    entry, at = ranges(np.zeros(len(edges), np.int64), edges)
    i, j = np.divmod(at, m[right][entry])
    return rows[begin[left][entry] + i], out_rows[out_begin[right][entry] + j], score[entry]


def _shared(a: _Side, b: _Side, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many absolute figures both rows of each pair have."""
    size = _sizes(a, b)
    many = max(s.max(initial=-1) for s in size) + 1
    here, there = (np.unique((side.row * many + s)[s >= 0]) for side, s in zip((a, b), size, strict=True))
    begin, count = places(left, here // many) if len(here) else (np.zeros_like(left), np.zeros_like(left))
    entry, at = ranges(begin, count)
    wanted = right[entry] * many + here[at] % many
    found = np.searchsorted(there, wanted)
    hit = np.append(there, -1)[found] == wanted
    return np.bincount(entry[hit], minlength=len(left))


def _sizes(a: _Side, b: _Side) -> list[np.ndarray]:
    """Numbers of figures without their sign, over both sides; all that are no number are alike, -1 for none."""
    return codes(pc.abs(a.value), pc.abs(b.value))


def _matching(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The heaviest matching of all groups' edges; one that shares no end with another needs no search."""
    real = weight > 0
    left, right, weight = left[real], right[real], weight[real]
    if not len(left):
        return left, right
    alone = (np.bincount(left)[left] == 1) & (np.bincount(right)[right] == 1)
    rest = ~alone
    found = np.array(heaviest(list(zip(left[rest].tolist(), right[rest].tolist(), weight[rest].tolist(), strict=True))), np.int64).reshape(-1, 2)
    return np.concatenate([left[alone], found[:, 0]]), np.concatenate([right[alone], found[:, 1]])


def _stated(a: _Side, b: _Side, labels: _Labels, alike: float) -> np.ndarray:
    """The row of a that each row of b states, -1 for none."""
    left, right, score = _alike(a, b, labels, alike)
    left, right = _matching(left, right, score * 1024 + np.minimum(_shared(a, b, left, right), 1023))
    found = np.full(len(b.group), -1)
    found[right] = left
    return found


def _starts(batch: pa.RecordBatch, together: Sequence[str]) -> np.ndarray:
    """Where groups that stand together begin; each row is one of its own if no columns are named."""
    new = np.full(batch.num_rows, not together)
    new[:1] = True
    for c in together:
        code = codes(batch.column(c))[0]
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _parts(batch: pa.RecordBatch, together: Sequence[str], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose groups' cells form about so many pairs at most, or of one group."""
    starts = _starts(batch, together)
    a, b = (np.add.reduceat(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64), starts) if len(starts) else starts for c in ("a", "b"))
    ends, starts = np.cumsum(a * b), np.append(starts, batch.num_rows)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(starts[at], starts[stop] - starts[at])
        at = stop


def _whole(batches: Iterator[pa.RecordBatch], together: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups: rows of the last one wait for those of the next batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if not together:
            yield batch
            continue
        last = _starts(batch, together)[-1]
        if waiting and not last and len(_starts(pa.concat_batches([waiting[-1].slice(waiting[-1].num_rows - 1), batch.slice(0, 1)]), together)) == 1:
            waiting.append(batch)  # still the same group
            continue
        yield pa.concat_batches([*waiting, batch.slice(0, last)])
        waiting = [batch.slice(last)]
    if waiting:
        yield pa.concat_batches(waiting)


def _groups(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each group, group of each row)."""
    of = np.zeros(batch.num_rows, np.int64)
    for c in keys:
        code = codes(batch.column(c))[0] + 1
        of = np.unique(of * (code.max(initial=0) + 1) + code, return_inverse=True)[1].reshape(-1)
    return np.unique(of, return_index=True)[1], of


def _found(groups: DataFrame, keys: Sequence[str], kept: Sequence[str], together: Sequence[str], columns: dict[str, str], find: Callable) -> DataFrame:
    """(kept keys, columns): what ``find`` makes of gathered groups; it returns each row's group and the columns."""
    kinds = dict(groups.dtypes)
    schema = ", ".join(f"`{k}` {v}" for k, v in ({k: kinds[k] for k in kept} | columns).items())

    def run(batches):
        for batch in _whole(batches, together):
            for part in _parts(batch, together):
                first, of = _groups(part, keys) if together else (None, np.arange(part.num_rows))
                group, *made = find(_Side(part.column("a"), of, "row"), _Side(part.column("b"), of, "out_row"))
                taken = pa.array(group if first is None else first[group], pa.int64())
                yield pa.record_batch([*[part.column(k).take(taken) for k in kept], *made], names=[*kept, *columns])

    return groups.select(*dict.fromkeys([*keys, *together]), "a", "b").mapInArrow(run, schema)


def _kind(groups: DataFrame, field: str) -> str:
    return groups.schema["a"].dataType.elementType[field].dataType.simpleString()


def stated_rows(truth: DataFrame, output: DataFrame, keys: Sequence[str], alike: float = 80.0) -> DataFrame:
    """(keys, row, out_row): which true row each output row states by its label.

    truth: keys, row (bigint), label, col, value; output: keys, out_row (bigint), label, header, out_col, value. A pair
    may match if its labels' similarity is ``alike`` or more (labels compared by their keys; an empty label states
    nothing); it weighs that similarity, to a hundredth, and then the absolute values that both rows have (1,023 at
    most are told apart), so rows of one label are told apart by their figures."""

    def find(a: _Side, b: _Side):
        of = _stated(a, b, _Labels(a, b), alike)
        out = np.flatnonzero(of >= 0)
        return b.group[out], a.rows.take(pa.array(of[out])), b.rows.take(pa.array(out))

    return _found(gathered(truth, output, keys), keys, keys, (), {"row": "bigint", "out_row": "bigint"}, find)


def stated_period(header: Column) -> Column:
    """The only year that a header cell names, as text; null if it names none or several."""
    found = F.array_distinct(loose_years(F.coalesce(header, F.lit(""))))
    return F.when(F.size(found) == 1, F.get(found, 0).cast("int").cast("string"))


def period_of(header: str | None) -> str | None:
    """``stated_period`` of one header."""
    found = set(loose_years_of(header or ""))
    return str(found.pop()) if len(found) == 1 else None


def outcomes(truth: DataFrame, output: DataFrame, keys: Sequence[str], alike: float = 80.0) -> DataFrame:
    """(keys, row, col, value, outcome): one outcome for each eligible cell, a true cell with a value.

    truth: keys, row (bigint), label, col (its period), value; output: keys, out_row (bigint), label, out_col (bigint),
    header, value. An output cell answers true cells of its absolute value: as *complete* if its row states the true
    row (``stated_rows``), its header names the period (``stated_period``) and the sign is right; as *unresolved row* if its row
    states none; as *unresolved column* if its row is right and its header names no single year; as *misplaced row* if its
    row states another; as *misplaced column* if its row is right and its header names another period; as *wrong sign* if
    only its sign differs, whatever row and column. Each output cell answers one true cell at most: the
    matching is the one of the greatest worth (``WORTH``), value by value. A cell without answer is *misread or omitted*.

    Rows of one true (row, col) or output (out_row, out_col) given twice are cells of their own; a null value in the
    output answers nothing; a table without output has nothing but cells that are omitted."""
    return outcomes_of(gathered(truth, output, keys), keys, alike)


def outcomes_of(groups: DataFrame, keys: Sequence[str], alike: float = 80.0, together: Sequence[str] = ()) -> DataFrame:
    """``outcomes`` of groups that are gathered: (keys, a, b), the cells of truth and output as arrays of structs. A group is one row.
    With ``together``, some of the keys by which partitions are dealt and sorted, it may be several: they need not be collected."""

    def find(a: _Side, b: _Side):
        labels = _Labels(a, b)
        of_row = _stated(a, b, labels, alike)
        true = _ordered(a, "col")
        cells = _ordered(b, "out_col")
        sizes, out_sizes = (s[c] for s, c in zip(_sizes(a, b), (true, cells), strict=True))
        many = max(sizes.max(initial=0), out_sizes.max(initial=0)) + 1
        size, out_size = a.owner[true] * many + sizes, b.owner[cells] * many + out_sizes
        order = np.argsort(out_size, kind="stable")
        begin, count = places(size, out_size[order])
        _check(np.bincount(a.owner[true], count))
        left, at = ranges(begin, count)
        right = order[at]
        kind = _outcome(a, b, of_row, true[left], cells[right])
        chosen, answer = _matching(left, right, np.array([WORTH[o] for o in OUTCOMES], np.int64)[kind])
        edge = np.searchsorted(left * len(cells) + right, chosen * len(cells) + answer)  # edges are in this order
        outcome = np.full(len(true), len(OUTCOMES))
        outcome[chosen] = kind[edge]
        taken = pa.array(true)
        return a.owner[true], *[a.fields[c].take(taken) for c in ("row", "col", "value")], pa.array([*OUTCOMES, "misread or omitted"]).take(pa.array(outcome))

    return _found(groups, keys, keys, together, {c: _kind(groups, c) for c in ("row", "col", "value")} | {"outcome": "string"}, find)


def _ordered(side: _Side, col: str) -> np.ndarray:
    """Cells with a value by group, row, column and value; nulls come first, what is no number last."""
    order = np.lexsort((_ranks(side.value), _ranks(side.fields[col]), side.row))
    return order[side.value.is_valid().to_numpy(zero_copy_only=False)[order]]


def _outcome(a: _Side, b: _Side, of_row: np.ndarray, cell: np.ndarray, printed: np.ndarray) -> np.ndarray:
    """Numbers in ``OUTCOMES`` of true cells if those output cells answer them."""
    heads = b.fields["header"].dictionary_encode()
    periods = pa.array([*[period_of(h) for h in heads.dictionary.to_pylist()], None], pa.string())
    col, period = codes(a.fields["col"].cast(pa.string()), periods)
    period = period[pc.fill_null(heads.indices, -1).to_numpy(zero_copy_only=False)][printed]
    value, other = (pc.fill_null(side.value, 0).to_numpy(zero_copy_only=False)[at] for side, at in ((a, cell), (b, printed)))
    sign = (other != value) & ((other == other) | (value == value))
    row = of_row[b.row[printed]]
    tests = {"wrong sign": sign, "unresolved row": row < 0, "misplaced row": row != a.row[cell], "unresolved column": period < 0, "misplaced column": period != col[cell]}
    return np.select(list(tests.values()), [OUTCOMES.index(o) for o in tests], OUTCOMES.index("complete"))


def label_errors(truth: DataFrame, output: DataFrame, keys: Sequence[str], by: Sequence[str] = (), alike: float = 80.0) -> DataFrame:
    """(by, labels, found, cer, wer): of the true rows' labels those that an output row states (``stated_rows``), and the mean
    character and word error rates of these, on the labels as they are printed. ``by`` are some of the keys."""
    return label_errors_of(gathered(truth, output, keys), keys, by, alike)


def label_errors_of(groups: DataFrame, keys: Sequence[str], by: Sequence[str] = (), alike: float = 80.0, together: Sequence[str] = ()) -> DataFrame:
    """``label_errors`` of groups that are gathered, as for ``outcomes_of``. Rates are found once for each different pair of labels."""

    def find(a: _Side, b: _Side):
        labels = _Labels(a, b)
        of_row = _stated(a, b, labels, alike)
        last, out_last = (np.where(labels.key[found] > 0, found, -1) for found in (side.largest(rank) for side, rank in zip((a, b), labels.labels, strict=True)))
        printed = np.full(len(a.group), -1)
        stating = np.flatnonzero(of_row >= 0)
        printed[of_row[stating]] = out_last[stating]
        there = np.flatnonzero(last >= 0)
        words = pa.array([*labels.words, None], pa.string())
        printed = printed[there]
        return a.group[there], words.take(pa.array(last[there])), words.take(pa.array(np.where(printed < 0, len(labels.words), printed)))

    pairs = _found(groups, keys, by, together, {"_label": "string", "_printed": "string"}, find).groupBy(*by, "_label", "_printed").agg(F.count(F.lit(1)).alias("n"))
    there = F.col("_printed").isNotNull()
    found = F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0))
    rate = lambda f: F.sum(F.when(there, f(F.col("_label"), F.coalesce("_printed", F.lit(""))) * F.col("n"))) / F.sum(F.when(there, F.col("n")))
    return pairs.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("labels"), found.alias("found"), rate(cer).alias("cer"), rate(wer).alias("wer"))
