"""MinHash near-deduplication with SetSketch registers.

A text's set is its distinct ``shingle``-word fingerprints. Register i of its sketch is
``floor(1 - log_b(min_d h_i(d)))`` over exponentially distributed hash values h_i, truncated to
[0, q + 1]: exponentially spaced minima, mergeable by maximum, equal in two sketches with a
probability close to the Jaccard similarity for b near 1.

1. Texts with equal sets form a class, represented by its smallest id.
2. Registers are banded; the classes of a bucket are proposed to its smallest member, so a bucket
   gives as many candidates as it has members, never all pairs.
3. Classes connected by proposals form an area. The sets of an area of at most ``block`` elements (each
   member counts for MEMBER more, so that very many short texts are no small area)
   come together in one task, which compares a member with those not yet connected to it.
4. In a larger area each proposal is verified where it stands. Where these links leave the area in
   several components, every member outside the largest is compared with every member in blocks of
   bounded size, which adds the links that the smallest members did not show; connected components
   over all links follow.

A comparison estimates the similarity jointly by likelihood from the numbers of larger, smaller and
equal registers; what is not far below the threshold is verified on the full sets.

With 32 bands of 4 registers a pair at 0.8 shares no bucket with probability 5e-8.

Defined results: a text without words (null, empty) has an empty set, is linked with nothing and is
kept; one with fewer words than a shingle is one shingle; a text of any length is taken whole; a
similarity of exactly ``percent`` links; equal rows count as one text and each gets the same result; of
different texts under one id the smallest (by its bytes) is compared with texts that are not equal, and each
row has its own n_shingles; a row without id is kept and not compared; further columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import Words, checkpointed, joined, mix, slices, tune
from pagetally.llm.components import connected_components

GAP = 0x20
B, A, Q = 1.001, 20.0, (1 << 16) - 2
_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2)
_MUL = _rng.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLOCK = 1_000_000  # set elements in a block of the exhaustive comparison
MEMBER = 64  # elements that a member counts for besides its own


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(all texts' distinct shingle fingerprints, sorted within a text; number of each text)."""
    words = Words(*joined(column, GAP), lower=True)
    h, _ = words.windows(k)
    fit = words.fits(k)
    value, doc = h[fit], words.doc[fit]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):  # the whole sequence, told apart by its length
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            there = j < words.count[short]
            word = words.hash[np.minimum(words.first[short] + j, len(words.hash) - 1)]
            extra = mix(extra + np.where(there, mix(word, j), 0).astype(np.uint64), 5)
        value, doc = np.concatenate([value, extra]), np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(value) else np.zeros(0, bool)
    return value[new], np.bincount(doc[new], minlength=len(column))


def registers(value: np.ndarray, size: np.ndarray, m: int) -> np.ndarray:
    """(non-empty sets, m) uint16 registers."""
    size = size[size > 0]
    first = np.r_[0, np.cumsum(size)]
    out = np.empty((len(size), m), np.uint16)
    a = 0
    while a < len(size):  # some sets at a time, so that the work stays in cache
        b = max(a + 1, int(np.searchsorted(first, first[a] + 32768, "right")) - 1)
        x = value[first[a] : first[b]]
        at = first[a:b] - first[a]
        least = np.empty((m, b - a), np.uint64)
        scratch = np.empty_like(x)
        for i in range(m):
            np.bitwise_xor(x, _XOR[i], out=scratch)
            np.multiply(scratch, _MUL[i], out=scratch)
            least[i] = np.minimum.reduceat(scratch, at)
        u = (least.astype(np.float64) + 0.5) / 2.0**64
        e = -np.log1p(-np.minimum(u, 1 - 1e-16)) / A
        out[a:b] = np.clip(np.floor(1 - np.log(e) / np.log(B)), 0, Q + 1).T
        a = b
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def joint_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, points: int = 101) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from registers (rows, m) and set sizes, on a grid of points."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for share in np.linspace(0, 1, points):
        j = share * top
        pm, pl = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
        like = more * np.log(pm) + less * np.log(pl) + same * np.log(np.clip(1 - pm - pl, 1e-12, 1))
        better = like > best
        best, at = np.where(better, like, best), np.where(better, j, at)
    return at


def _sketch(k: int, bands: int, rows: int):
    def run(batches):
        for batch in slices(batches):
            value, size = shingle_sets(batch.column(1), k)
            reg = registers(value, size, bands * rows)
            some = size > 0
            at = np.r_[0, np.cumsum(size[some])[:-1]].astype(np.int64)
            f1, f2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            keys = np.zeros((len(reg), bands), np.uint64)
            if len(reg):
                f1[some], f2[some] = np.add.reduceat(mix(value, 11), at), np.add.reduceat(mix(value, 12), at)
                wide = reg.astype(np.uint64)
                for i in range(bands):
                    x = np.full(len(reg), i + 1, np.uint64)
                    for j in range(i * rows, (i + 1) * rows):
                        x = mix(x * np.uint64(65599) + wide[:, j], 13)
                    keys[:, i] = x
            n = np.where(some, bands, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.record_batch([batch.column(0), pa.array(size.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], names=["id", "n", "f1", "f2", "bands"])

    return run


def _sets(k: int, m: int):
    def run(batches):
        for batch in slices(batches):
            area = batch.column(2)
            value, size = shingle_sets(batch.column(1), k)
            reg = registers(value, size, m)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(value.view(np.int64)))
            some = np.cumsum(size > 0) - 1
            sketch = pa.array([reg[i].tobytes() if n else b"" for i, n in zip(some.tolist(), size.tolist(), strict=True)], pa.binary())
            yield pa.record_batch([batch.column(0), area, pa.array(size.astype(np.int64)), sketch, lists], names=["id", "area", "n", "sketch", "elements"])

    return run


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(int(off[0]), int(off[-1] - off[0])).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return values, off - off[0]


def _verify(percent: int, m: int, slack: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in (2, 5))
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, m) for c in (3, 6))
            near = joint_similarity(ra, rb, na, nb) >= percent / 100 - slack
            (va, oa), (vb, ob) = _flat(batch.column(4)), _flat(batch.column(7))
            ok = np.zeros(batch.num_rows, bool)
            for i in np.flatnonzero(near):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            pick = pa.array(np.flatnonzero(ok))
            yield pa.record_batch([batch.column(0).take(pick), batch.column(1).take(pick)], names=["u", "v"])

    return run


def _resolve(percent: int, m: int, slack: float):
    """An area's components: a link from each member to the smallest id of its component."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("id")
        ids, n = group["id"].to_numpy(), group["n"].to_numpy()
        elements = group["elements"].combine_chunks()
        value, off = _flat(elements if isinstance(elements, pa.ListArray) else elements.chunk(0))
        reg = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint16).reshape(-1, m)
        _, code = np.unique(value, return_inverse=True)
        mark = np.zeros(int(code.max()) + 1, np.int64)
        part = np.arange(len(ids))
        for i in range(len(ids) - 1):
            rest = i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
            rest = rest[100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])]
            if len(rest):
                mine = np.broadcast_to(reg[i], (len(rest), m))
                rest = rest[joint_similarity(mine, reg[rest], np.full(len(rest), n[i], float), n[rest].astype(float), points=21) >= percent / 100 - slack]
            if not len(rest):
                continue
            mark[code[off[i] : off[i + 1]]] = 1
            take = np.repeat(off[rest] - (np.cumsum(n[rest]) - n[rest]), n[rest]) + np.arange(n[rest].sum())
            both = np.add.reduceat(mark[code[take]], np.cumsum(n[rest]) - n[rest])
            mark[code[off[i] : off[i + 1]]] = 0
            hit = rest[100 * both >= percent * (n[i] + n[rest] - both)]
            if len(hit):
                joined_parts = np.unique(np.r_[part[i], part[hit]])
                part[np.isin(part, joined_parts)] = joined_parts[0]
        moved = np.flatnonzero(part != np.arange(len(ids)))
        return pa.table({"u": ids[moved], "v": ids[part[moved]]})

    return run


def _compare(percent: int):
    """Members outside the largest component against all members of a block."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group["id"].to_numpy()
        own = group["component"].to_numpy()
        odd = np.asarray(group["odd"].to_numpy(zero_copy_only=False), bool)
        elements = group["elements"].combine_chunks()
        value, off = _flat(elements if isinstance(elements, pa.ListArray) else elements.chunk(0))
        _, code = np.unique(value, return_inverse=True)
        size = np.diff(off)
        mark = np.zeros(int(code.max()) + 1, np.int64)
        u, v = [], []
        members = np.flatnonzero(~odd)
        if len(members):
            first = off[members]
            take = np.concatenate([np.arange(a, a + n) for a, n in zip(first, size[members], strict=True)])
            inner, at = code[take], np.r_[0, np.cumsum(size[members])[:-1]]
            for i in np.flatnonzero(odd):
                mine = code[off[i] : off[i + 1]]
                mark[mine] = 1
                both = np.add.reduceat(mark[inner], at)
                mark[mine] = 0
                hit = members[(100 * both >= percent * (size[i] + size[members] - both)) & (own[members] != own[i])]
                _, one = np.unique(own[hit], return_index=True)  # one link to each component
                u += [ids[i]] * len(one)
                v += ids[hit[one]].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _large_areas(proposed: DataFrame, sets: DataFrame, percent: int, m: int, block: int) -> DataFrame:
    """(id, component) for areas that no single task should hold."""
    a, b = (sets.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "sketch", "elements")]) for s in "uv")
    pairs = proposed.join(b, F.col("v") == F.col("id_v")).join(a, F.col("u") == F.col("id_u")).select("u", "v", "n_u", "sketch_u", "elements_u", "n_v", "sketch_v", "elements_v")
    links = checkpointed(pairs.mapInArrow(_verify(percent, m, 0.25), "u bigint, v bigint"))
    linked = connected_components(links)
    places = checkpointed(sets.select("id", "n", "area").join(linked, "id", "left").select("id", "n", "area", F.coalesce("component", "id").alias("component")))
    by_part = places.groupBy("area", "component").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") + MEMBER).alias("n"))
    area = by_part.groupBy("area").agg(F.max(F.struct("k", "component", "n")).alias("top"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    area = area.select("area", F.col("top.component").alias("main"), F.ceil(F.col("all_n") / block).cast("int").alias("mb"), F.ceil((F.col("all_n") - F.col("top.n")) / block).cast("int").alias("ob"))
    split = places.join(area, "area").join(sets.select("id", "elements"), "id")
    spread = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.greatest(F.col(n), F.lit(1))).cast("int")
    member = split.select("area", part("mb", 1).alias("m"), F.explode(spread("ob")).alias("o"), "id", "component", F.lit(False).alias("odd"), "elements")
    odd = split.where("component <> main").select("area", F.explode(spread("mb")).alias("m"), part("ob", 2).alias("o"), "id", "component", F.lit(True).alias("odd"), "elements")
    further = member.union(odd).groupBy("area", "m", "o").applyInArrow(_compare(percent), "u bigint, v bigint")
    return connected_components(checkpointed(links.union(further)))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row."""
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = checkpointed(texts.mapInArrow(_sketch(shingle, bands, rows), "id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>"))
    # the checkpoint lets adaptive execution split a set that very many texts have where it is joined below
    classes = checkpointed(sketches.where("n > 0 AND id IS NOT NULL").groupBy("f1", "f2").agg(F.min("id").alias("class"), F.first("bands").alias("bands")))
    keys = classes.select("class", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "least")
    proposed = checkpointed(keys.join(buckets, "key").where("class <> least").select(F.col("least").alias("u"), F.col("class").alias("v")).distinct())
    concerned = proposed.select(F.col("u").alias("id")).union(proposed.select(F.col("v").alias("id"))).distinct()
    areas = concerned.join(connected_components(proposed), "id", "left").select("id", F.coalesce("component", "id").alias("area"))
    sets = texts.join(areas, "id").groupBy("id").agg(F.min("text").alias("text"), F.min("area").alias("area")).select("id", "text", "area").mapInArrow(_sets(shingle, bands * rows), "id bigint, area bigint, n bigint, sketch binary, elements array<bigint>")
    sets = checkpointed(sets)
    size = sets.groupBy("area").agg(F.sum(F.col("n") + MEMBER).alias("all_n"))
    small = sets.join(size.where(F.col("all_n") <= block).select("area"), "area")
    found = small.groupBy("area").applyInArrow(_resolve(percent, bands * rows, 0.25), "u bigint, v bigint").select(F.col("u").alias("class"), F.col("v").alias("component"))
    large = size.where(F.col("all_n") > block).select("area")
    if not large.isEmpty():
        found = found.union(_large_areas(proposed, sets.join(large, "area"), percent, bands * rows, block).select(F.col("id").alias("class"), "component"))
    named = sketches.where("n > 0").select("id", "n", "f1", "f2").join(classes.select("f1", "f2", "class"), ["f1", "f2"], "left").select("id", "n", "class")
    empty = sketches.where("n = 0").select("id", "n", "id", F.lit(None).cast("bigint"))
    out = named.join(found, "class", "left").select("id", "n", "class", "component").union(empty.toDF("id", "n", "class", "component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "class", "id"))
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
