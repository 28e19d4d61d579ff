import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetally.llm.components import connected_components
from pagetally.llm.setsketch import joint_similarity, merge, near_duplicates, registers
from tests.llm.helpers import awkward, components, random_texts, shingles


def brute(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    near = lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    return sets, components(sorted(texts), near)


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_components_are_exact(spark, block):
    texts = {k * 2: t for k, t in enumerate(random_texts(160, seed=9, vocabulary=40))}
    sets, want = brute(texts, 4, 80)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = near_duplicates(df, shingle=4, percent=80, block=block).collect()
    assert {r.doc_id: r.n_shingles for r in rows} == {k: len(s) for k, s in sets.items()}
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert len(set(want.values())) < len(want) - 20


def test_awkward_rows(spark):
    rows = near_duplicates(awkward(spark), shingle=4).collect()
    by = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(rows) == 13
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (7, 2, 7, True), (8, 2, 7, False), (None, 5, None, True), (None, 0, None, True)} <= by
    assert near_duplicates(awkward(spark, False), shingle=4).collect() == []


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(0)
    for shared in (0, 300, 800):
        pool = rng.integers(0, 2**63, 2000 - shared, dtype=np.uint64) * np.uint64(2)
        a, b = pool[:1000], pool[1000 - shared :]
        ra, rb = registers(a, np.array([1000]), 512), registers(b, np.array([1000]), 512)
        both = np.unique(np.r_[a, b])
        assert (merge(ra, rb) == registers(both, np.array([len(both)]), 512)).all()
        j = shared / len(both)
        assert abs(joint_similarity(ra, rb, np.array([1000.0]), np.array([1000.0]))[0] - j) < 0.08


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(159, 7), (300, 300), (500, 400), (400, 500)]
    df = spark.createDataFrame(links, "u bigint, v bigint")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert {k for k, v in got.items() if v == 0} == {*range(1, 41), *range(100, 160)}
    assert got[500] == 400 and 300 not in got
    assert connected_components(df.where(F.lit(False))).collect() == []
