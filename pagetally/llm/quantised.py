"""Embedding near-deduplication with inverted lists and product-quantised residuals.

The index is fitted on a sample of at most ``sample`` vectors, taken by a hash of the id; every vector is
indexed. Its lists have two levels, coarse centres and centres of the residuals shared by all coarse ones, so
their number grows with the number of vectors (one for each ``PER_LIST``) though the sample does not; on what
is left a codebook for each subspace is fitted. A vector is a member of its nearest list and probes each list
whose boundary with its own, on either level, lies within ``reach``. How far that has to be is measured:
vectors exactly at the threshold are made from the sample, in the directions in which the sample spreads
(towards random and towards near vectors), and ``reach`` is what finds ``recall`` of those pairs. It is
never more than the distance at the threshold, with which no pair can be missed.

Inside a list, a query's table of distances to the codewords gives all members' approximate distances by
lookup; the member's own quantisation error, kept beside its code, bounds how wrong that is, so no member
within the threshold is pruned. What is left is reranked by exact cosine in double precision.

Vectors are compared with those of their own length. Lengths that at most ``FEW`` different vectors have
are compared whole, in one task each; each other length has an index of its own.

Equal vectors are one class with a multiplicity. Members and queries of a list are cut into blocks
of bounded size; a block returns for each vector the number of its links and one link to the
block's local component, never the pairs. A pair that could meet twice (each probes the other's
list) counts where the smaller id is the query.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are kept; equal rows are vectors of their own and link with each other, also under one id; a
vector of any length is taken whole; a cosine of exactly the threshold links; a row without id links with
nothing; further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import checkpointed, mix
from pagetally.llm.components import connected_components

MEMBERS, QUERIES = 1024, 2048  # rows of a block
PER_LIST = 256  # vectors for each list
FEW = 1024
TOP = 2048  # centres of a level


def _read(batches):
    """Usable vectors, their length and fingerprints; others get an empty one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(1)
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False)
        flat = flat + flat.dtype.type(0)  # no negative zeros
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        bad = np.bincount(owner[~np.isfinite(flat)], minlength=len(size)) > 0
        ok = ~bad & (np.bincount(owner[flat != 0], minlength=len(size)) > 0) & np.asarray(batch.column(0).is_valid())
        f1, f2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        for width in np.unique(size[ok]).tolist():
            rows = np.flatnonzero(ok & (size == width))
            f1[rows], f2[rows] = _fingerprints(flat[first[rows][:, None] + np.arange(width)])
        keep = ok[owner]
        n = np.where(ok, size, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat[keep]))
        yield pa.record_batch([batch.column(0), pa.array(ok), pa.array(n.astype(np.int32)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], names=["id", "ok", "width", "f1", "f2", "x"])


def _fingerprints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = x.view(f"u{x.itemsize}").astype(np.uint64)
    h = [mix(bits + np.uint64(1) + np.arange(x.shape[1], dtype=np.uint64) * np.uint64(0x100000001B3), s) for s in (21, 22)]
    length = np.uint64(x.shape[1])
    return mix(h[0].sum(1, dtype=np.uint64) + length, 1), mix(h[1].sum(1, dtype=np.uint64) + length, 2)


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres; deterministic for the same rows."""
    rng = np.random.default_rng(5)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([(x[a : a + 4096] @ centres.T - half).argmax(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centres, centres of residuals (list = coarse * fine + residual's), codebooks (parts x 256 x width / parts)."""

    def __init__(self, sample: np.ndarray, vectors: int, cosine: float, parts: int, recall: float):
        self.width = sample.shape[1]
        self.parts = max(p for p in range(1, min(parts, self.width) + 1) if self.width % p == 0)
        lists = max(1, vectors // PER_LIST)
        self.coarse = _kmeans(sample, min(lists, TOP, max(1, len(sample) // 10)))
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.fine = np.zeros((1, self.width))
        if lists > len(self.coarse):
            self.fine = _kmeans(rest, min(-(-lists // len(self.coarse)), TOP, max(1, len(sample) // 10)))
            rest = rest - self.fine[_nearest(rest, self.fine)]
        step = self.width // self.parts
        self.books = [_kmeans(rest[:, p * step : (p + 1) * step], 256, 6) for p in range(self.parts)]
        self.gaps = [self._gaps(self.coarse), self._gaps(self.fine)]
        self.reach = self._measured(sample, cosine, recall)

    @staticmethod
    def _gaps(centres: np.ndarray) -> np.ndarray:
        square = (centres**2).sum(1)
        gap = np.maximum(square[:, None] + square[None] - 2 * centres @ centres.T, 0)
        return np.sqrt(np.where(gap > 1e-12, gap, np.inf))

    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centre(self, number) -> np.ndarray:
        return self.coarse[number // len(self.fine)] + self.fine[number % len(self.fine)]

    def place(self, x: np.ndarray) -> np.ndarray:
        at = _nearest(x, self.coarse)
        return at * len(self.fine) + (_nearest(x - self.coarse[at], self.fine) if len(self.fine) > 1 else 0)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, distance from the decoded vector)"""
        at = self.place(x)
        rest = x - self.centre(at)
        step = self.width // self.parts
        codes = np.stack([_nearest(rest[:, p * step : (p + 1) * step], b) for p, b in enumerate(self.books)], 1).astype(np.uint8)
        back = np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], 1)
        return at, codes, np.sqrt(((rest - back) ** 2).sum(1))

    @staticmethod
    def _margins(x: np.ndarray, centres: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """rows x centres: distance to the boundary between the nearest centre and this one."""
        d = (centres**2).sum(1) - 2 * x @ centres.T
        own = d.argmin(1)
        return (d - d[np.arange(len(x)), own][:, None]) / (2 * gaps[own])

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists within reach, in order."""
        rows, lists = [], []
        for a in range(0, len(x), 1024):
            row, top = np.nonzero(self._margins(x[a : a + 1024], self.coarse, self.gaps[0]) <= self.reach)
            row += a
            if len(self.fine) == 1:
                rows.append(row), lists.append(top)
                continue
            for b in range(0, len(row), 1024):
                r, t = row[b : b + 1024], top[b : b + 1024]
                i, low = np.nonzero(self._margins(x[r] - self.coarse[t], self.fine, self.gaps[1]) <= self.reach)
                rows.append(r[i]), lists.append(t[i] * len(self.fine) + low)
        return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(lists or [np.zeros(0, np.int64)])

    def _needed(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The reach with which x probes that list."""
        top, low = lists // len(self.fine), lists % len(self.fine)
        each = np.arange(len(x))
        need = self._margins(x, self.coarse, self.gaps[0])[each, top]
        return np.maximum(need, self._margins(x - self.coarse[top], self.fine, self.gaps[1])[each, low])

    def _measured(self, sample: np.ndarray, cosine: float, recall: float, pairs: int = 2000) -> float:
        far = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
        x = sample[:pairs]
        if len(x) < 3:
            return far
        rng = np.random.default_rng(11)
        few = min(8, len(sample) - 1)
        near = np.empty((len(x), few), np.int64)
        for a in range(0, len(x), 100):  # the whole table of similarities would be large
            alike = x[a : a + 100] @ sample.T
            alike[alike > 1 - 1e-6] = -2  # equal ones show no direction
            near[a : a + 100] = alike.argpartition(-few, axis=1)[:, -few:]
        need = 0.0
        for partner in (rng.integers(0, len(sample), len(x)), near[np.arange(len(x)), rng.integers(0, near.shape[1], len(x))]):
            z = sample[partner]
            away = z - (z * x).sum(1)[:, None] * x
            length = np.sqrt((away**2).sum(1))
            some = length > 1e-6
            y = cosine * x[some] + np.sqrt(max(0.0, 1 - cosine**2)) * away[some] / length[some, None]
            if len(y):
                either = np.minimum(self._needed(x[some], self.place(y)), self._needed(y, self.place(x[some])))
                need = max(need, float(np.quantile(either, recall)))
        return min(far, need) + 1e-9

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """rows x parts x 256: squared distances to the codewords."""
        step = self.width // self.parts
        return np.stack([((rest[:, None, p * step : (p + 1) * step] - b[None]) ** 2).sum(-1) for p, b in enumerate(self.books)], 1)


def _unit(lists: pa.ListArray, width: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return x / np.sqrt((x**2).sum(1))[:, None]


def _place(sent):
    def run(batches):
        index = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(2), index.width)
            at, codes, error = index.code(x)
            row, lists = index.probes(x)
            probes = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)), pa.array(lists.astype(np.int32)))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), probes], names=["id", "times", "x", "list", "code", "error", "probes"])

    return run


def _linked(ids: np.ndarray, times: np.ndarray, s: np.ndarray, t: np.ndarray) -> pa.Table:
    """Links between rows s and t -> for each linked vector its number of links and the smallest id of its local component."""
    name, back = np.unique(ids, return_inverse=True)
    weight = times[s], times[t]
    s, t = back[s], back[t]
    more = np.bincount(s, weights=weight[1], minlength=len(name)) + np.bincount(t, weights=weight[0], minlength=len(name))
    root = np.arange(len(name))
    while len(s):
        low = np.minimum(root[s], root[t])
        before = root.copy()
        np.minimum.at(root, s, low), np.minimum.at(root, t, low)
        root = root[root]
        if (root == before).all():
            break
    pick = np.flatnonzero(more > 0)
    return pa.table({"u": name[pick], "v": name[root[pick]], "more": more[pick].astype(np.int64)})


def _one(group: pa.Table, name: str):
    column = group[name].combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _whole(cosine: float):
    """All vectors of a length that few have."""

    def run(group: pa.Table) -> pa.Table:
        width = group["width"][0].as_py()
        x = _unit(_one(group, "x"), width)
        s, t = np.nonzero(np.triu(x @ x.T >= cosine - 1e-9, 1))
        sure = np.array([float(x[i] @ x[j]) >= cosine for i, j in zip(s.tolist(), t.tolist(), strict=True)], bool)
        return _linked(group["id"].to_numpy(), group["times"].to_numpy(), s[sure], t[sure])

    return run


def _match(sent, cosine: float):
    far = np.sqrt(2 - 2 * cosine) + 1e-6

    def run(group: pa.Table) -> pa.Table:
        index = sent.value
        query = np.asarray(_one(group, "query").to_numpy(zero_copy_only=False), bool)
        ids, times, own = (group[c].to_numpy() for c in ("id", "times", "list"))
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        if not len(q) or not len(m):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "more": pa.array([], pa.int64())})
        x = _unit(_one(group, "x"), index.width)
        centre = index.centre(int(own[m[0]]))
        codes = np.frombuffer(b"".join(_one(group, "code").take(pa.array(m)).to_pylist()), np.uint8).reshape(len(m), -1).astype(np.int64)
        limit = ((group["error"].to_numpy()[m] + far) ** 2).astype(np.float32)
        probing = _one(group, "probes").take(pa.array(m))
        many = index.lists()
        probed = np.repeat(np.arange(len(m)), probing.value_lengths().to_numpy()) * many + probing.flatten().to_numpy()  # in order
        left, right = [], []
        for a in range(0, len(q), 64):
            part = q[a : a + 64]
            table = index.tables(x[part] - centre).astype(np.float32)
            d = np.zeros((len(part), len(m)), np.float32)
            for p in range(index.parts):
                d += table[:, p].take(codes[:, p], 1)
            i, j = np.nonzero(d <= limit * np.float32(1 + 1e-4))
            ask = j * many + own[part[i]]
            both = probed[np.minimum(np.searchsorted(probed, ask), len(probed) - 1)] == ask
            keep = np.where(both, ids[part[i]] < ids[m[j]], True) & (ids[part[i]] != ids[m[j]])
            i, j = part[i[keep]], m[j[keep]]
            for b in range(0, len(i), 1 << 16):
                s, t = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
                ok = np.einsum("ij,ij->i", x[s], x[t]) >= cosine
                left.append(s[ok]), right.append(t[ok])
        return _linked(ids, times, np.concatenate(left or [q[:0]]), np.concatenate(right or [q[:0]]))

    return run


LINKS = "u bigint, v bigint, more bigint"


def _indexed(classes: DataFrame, width: int, number: int, cosine: float, parts: int, sample: int, recall: float) -> DataFrame:
    """Links (u, v, more) between vectors of one length."""
    spark = classes.sparkSession
    taken = classes.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()  # bounded
    sent = spark.sparkContext.broadcast(Index(_unit(_one(taken, "x"), width), number, cosine, parts, recall))  # bounded by sample and TOP
    held = checkpointed(classes.select("id", "times", "x").mapInArrow(_place(sent), f"id bigint, times bigint, x {classes.schema['x'].dataType.simpleString()}, list int, code binary, error double, probes array<int>"))
    asked = held.select("*", F.explode("probes").alias("at"))
    size = held.groupBy(F.col("list").alias("at")).agg(F.count(F.lit(1)).alias("m")).join(asked.groupBy("at").agg(F.count(F.lit(1)).alias("q")), "at")
    size = checkpointed(size.select("at", F.ceil(F.col("m") / MEMBERS).cast("int").alias("mb"), F.ceil(F.col("q") / QUERIES).cast("int").alias("qb")))
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["id", "times", "x", "list", "code", "error", "probes"]
    member = held.withColumn("at", F.col("list")).join(size, "at").select("at", part("mb", 1).alias("m"), spread("qb").alias("q"), F.lit(False).alias("query"), *columns)
    query = asked.join(size, "at").select("at", spread("mb").alias("m"), part("qb", 2).alias("q"), F.lit(True).alias("query"), *[F.lit(None).cast(t).alias(c) if c in ("code", "probes") else F.col(c) for c, t in held.select(*columns).dtypes])
    return member.union(query).groupBy("at", "m", "q").applyInArrow(_match(sent, cosine), LINKS)


def similar_vectors(vectors: DataFrame, cosine: float = 0.95, parts: int = 8, sample: int = 20_000, recall: float = 0.995, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row."""
    kind = vectors.schema[id_col].dataType.simpleString()
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("x"))
    read = rows.mapInArrow(_read, f"id bigint, ok boolean, width int, f1 bigint, f2 bigint, x {rows.schema['x'].dataType.simpleString()}")
    classes = checkpointed(read.where("ok").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"), F.first("width").alias("width"), F.first("x").alias("x")))
    lengths = classes.groupBy("width").agg(F.count(F.lit(1)).alias("n"))
    many = {r.width: r.n for r in lengths.where(F.col("n") > FEW).collect()}  # at most a row for each FEW vectors
    rare = classes.where(~F.col("width").isin(list(many))) if many else classes
    found = rare.select("id", "times", "width", "x").groupBy("width").applyInArrow(_whole(cosine), LINKS)
    for width, number in sorted(many.items()):
        found = found.union(_indexed(classes.where(F.col("width") == width), width, number, cosine, parts, sample, recall))
    found = checkpointed(found)
    degree = found.groupBy(F.col("u").alias("class")).agg(F.sum("more").alias("more"))
    root = connected_components(found.where("u <> v").select("u", "v")).select(F.col("id").alias("class"), "component")
    whole = checkpointed(classes.select("f1", "f2", F.col("id").alias("class"), "times").join(degree, "class", "left").join(root, "class", "left"))
    # the checkpoint lets adaptive execution split a vector that very many rows have
    named = read.where("ok").select("id", "f1", "f2").join(whole, ["f1", "f2"]).select("id", "class", "times", "more", "component")
    alone = read.where("NOT ok").select("id", *[F.lit(None).cast("bigint").alias(c) for c in ("class", "times", "more", "component")])
    component = F.coalesce("component", "class", "id")
    return named.union(alone).select(
        F.col("id").cast(kind).alias(id_col),
        F.coalesce(F.col("times") - 1 + F.coalesce("more", F.lit(0)), F.lit(0)).cast("bigint").alias("n_links"),
        component.cast(kind).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
