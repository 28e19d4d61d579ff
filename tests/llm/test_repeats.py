import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagetally.llm import common
from pagetally.llm.factors import factor_duplicates
from pagetally.llm.suffixes import suffix_duplicates
from tests.llm.helpers import WORD, awkward, random_texts, removed


def held_against_brute_force(spark, operator, window, partitions, texts=None):
    texts = texts or {k * 3: t for k, t in enumerate(random_texts(150, seed=window))}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").orderBy(F.hash("doc_id")).repartition(partitions)
    want = removed(texts, window)
    seen = 0
    for r in operator(df, window).collect():
        words, gone = WORD.findall(texts[r.doc_id]), want[r.doc_id]
        assert (r.n_words, r.n_removed) == (len(words), sum(gone))
        assert WORD.findall(r.kept) == [w for w, g in zip(words, gone, strict=True) if not g]
        assert {i for s in r.spans for i in range(s.start, s.stop)} == {i for i, g in enumerate(gone) if g}
        seen += sum(gone)
    assert seen > 100


def test_factors_remove_what_repeats(spark):
    held_against_brute_force(spark, factor_duplicates, 20, 1)
    held_against_brute_force(spark, factor_duplicates, 20, 7)


def test_suffixes_remove_what_repeats(spark):
    held_against_brute_force(spark, suffix_duplicates, 50, 5)


def patchwork(n, seed, pieces=6, longest=45):
    """Texts put together from parts of few sources, so that passages over a seam occur in third texts."""
    rnd = random.Random(seed)
    sources = [[f"{c}{i}" for i in range(120)] for c in "abc"] + [["x", "y"] * 40]
    out = {}
    for k in range(n):
        words = []
        for _ in range(rnd.randint(1, pieces)):
            source = rnd.choice(sources)
            at = rnd.randrange(0, len(source), 5)
            words += source[at : at + rnd.randint(3, longest)]
        out[k] = " ".join(words)
    return out


@pytest.mark.parametrize("window", [7, 20, 50])
def test_seams(spark, window):
    for operator in (factor_duplicates, suffix_duplicates):
        held_against_brute_force(spark, operator, window, 3, patchwork(250, window, longest=2 * window))


def test_a_forgetful_memory_does_not_matter(spark):
    for operator, window in ((factor_duplicates, 20), (suffix_duplicates, 50)):
        held_against_brute_force(spark, lambda d, w, f=operator: f(d, w, memory=3), window, 2)


def test_one_passage_in_very_many_texts(spark):
    rnd = random.Random(5)
    common_words = [f"c{i}" for i in range(60)]
    texts = {}
    for k in range(600):
        begin, stop = rnd.randint(0, 12), 60 - rnd.randint(0, 12)
        texts[k] = " ".join([*(f"l{k % 7}{i}" for i in range(rnd.randint(0, 9))), *common_words[begin:stop], *(f"r{k % 11}{i}" for i in range(rnd.randint(0, 9)))])
    for operator, window in ((factor_duplicates, 20), (suffix_duplicates, 50)):
        held_against_brute_force(spark, operator, window, 9, texts)


def test_long_texts(spark):
    """Texts above a slice (2 MiB), one of them with a word of a megabyte."""
    rnd = random.Random(6)
    long = " ".join(str(rnd.randrange(10**6)) for _ in range(400_000))
    part = " ".join(long.split(" ")[200_000:200_100])
    texts = [(1, long), (2, "x" * (1 << 20) + " " + part), (3, part + " " + "x" * (1 << 20)), (4, long)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(2)
    for operator, window in ((factor_duplicates, 20), (suffix_duplicates, 50)):
        got = {r.doc_id: (r.n_words, r.n_removed) for r in operator(df, window).select("doc_id", "n_words", "n_removed").collect()}
        assert got == {1: (400_000, 0), 2: (101, 100), 3: (101, 100), 4: (400_000, 400_000)}


def thue_morse(n, swap, words="ab"):
    return [words[bin(i).count("1") % 2 ^ swap] for i in range(n)]


def test_hashes_tell_regular_words_apart():
    """Sequences in which any polynomial modulo a power of two collides."""
    for n in (8, 16, 63, 64, 1024, 4096):
        data, ends = common.joined(pa.array(["".join(thue_morse(n, 0)) + " " + "".join(thue_morse(n, 1))]), 0x20)
        for seed in (0, 1):
            words = common.Words(data, ends)
            h = common.word_hashes(words.data, words.start, words.end, seed)
            assert h[0] != h[1]
    data, ends = common.joined(pa.array([" ".join(thue_morse(64, 0)), " ".join(thue_morse(64, 1))]), 0x20)
    h1, h2 = common.Words(data, ends).windows(64, double=True)
    assert h1[0] != h1[64] and h2[0] != h2[64]


def alike_words(bits: int, n: int = 4_000_000, most: int = 12) -> list[tuple[str, str]]:
    """Different numbers whose hashes begin with the same bits, found by search."""
    names = np.char.add("n", np.arange(n).astype(str))
    data, ends = common.joined(pa.array([*names.tolist()]), 0x20)
    words = common.Words(data, ends)
    top = words.hash >> np.uint64(64 - bits)
    order = np.argsort(top, kind="stable")
    same = np.flatnonzero(top[order][1:] == top[order][:-1])[:most]
    return [(str(names[order[i]]), str(names[order[i + 1]])) for i in same]


def test_words_of_like_hashes_are_told_apart(spark):
    """Texts of a window's length that differ in one word, whose hash agrees in 39 bits, at each place of the window."""
    pairs = alike_words(39)
    assert len(pairs) > 5
    texts = []
    for k in range(50):
        x, y = pairs[k % len(pairs)]
        for word in (x, y):
            texts.append(" ".join([*(f"t{k}w{i}" for i in range(k)), word, *(f"t{k}w{i}" for i in range(k + 1, 50))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for operator, window in ((suffix_duplicates, 50), (factor_duplicates, 50)):
        assert {r.n_removed for r in operator(df, window).collect()} == {0}
    twice = [*enumerate(texts), *((1000 + k, t) for k, t in enumerate(texts))]
    df = spark.createDataFrame(twice, "doc_id bigint, text string").repartition(5)
    assert {(r.doc_id >= 1000, r.n_removed) for r in suffix_duplicates(df, 50).collect()} == {(False, 0), (True, 50)}


def test_words_of_any_length_in_records(spark):
    """Words of 30 to 34 bytes, some of them the digest of others, and bytes that sort before a blank."""
    long = ["x" * n for n in range(29, 36)] + ["é" * 16, "é" * 15 + "x", "\x00", "\x00\x00", "a\x01"]
    long += [hashlib.blake2b(w.encode(), digest_size=16).hexdigest() for w in long]
    rnd = random.Random(11)
    source = [rnd.choice(long) for _ in range(400)]
    texts = {}
    for k in range(120):
        at = rnd.randrange(300)
        words = source[at : at + rnd.randint(40, 90)]
        if rnd.random() < 0.5:
            words[rnd.randrange(len(words))] = rnd.choice(long)
        texts[k] = " ".join(words)
    held_against_brute_force(spark, suffix_duplicates, 50, 4, texts)


def test_wide_offsets_and_views():
    for kind in (pa.string(), pa.large_string(), pa.string_view()):
        column = pa.array(["zz", "abc", None, "de"], kind).slice(1)
        data, ends = common.joined(column, 0x20)
        assert data.tobytes() == b"abc  de " and ends.tolist() == [3, 4, 7]


def test_batches_do_not_matter(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for operator, window in ((factor_duplicates, 20), (suffix_duplicates, 50)):
            held_against_brute_force(spark, operator, window, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_layout_is_kept(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, f"before\n  it\t{passage}\nafter  all"), (3, "a\n\nb")], "doc_id bigint, text string")
    kept = {r.doc_id: r.kept for r in suffix_duplicates(df, 50).collect()}
    assert kept == {1: passage, 2: "before\n  it\tafter  all", 3: "a\n\nb"}


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = factor_duplicates(df, 20).collect()
    assert len(rows) == df.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    words = "long words " * 9000
    expected = removed({7: words, 8: words}, 20)
    assert [r.n_removed for r in by[7]] == [sum(expected[7])] * 2
    assert by[8][0].n_removed == sum(expected[8]) == 18000
    assert all(r.n_removed == 0 for k in (None, 1, 2, 3, 4, 5, 6) for r in by[k])
    assert by[1][0].kept == "" and hashlib.sha256(by[6][0].kept.encode()).hexdigest() == hashlib.sha256(b"a b c").hexdigest()
    assert factor_duplicates(awkward(spark, False), 20).collect() == []
    carried = suffix_duplicates(df, 50, carry=["lang", "x0"]).collect()
    assert {r.x0 for r in carried} == {"x"} and sum(r.lang is None for r in carried) == 1
    assert [r.kept for r in carried if r.doc_id == 1] == [None]
