import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagetally.llm.common import joined
from pagetally.llm.packing import Packer, least_slack, pack
from pagetally.llm.tokens import SEPARATOR, WordMachine, compile_tokenizer, token_counts
from tests.llm.helpers import awkward, random_texts

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts():
    rnd = random.Random(3)
    parts = [*"aZé1٣ \n\t   　'strevldmS.,!¾Ⅷ字😀́‍", "<|endoftext|>", "  ", "'re", "'ll", "aaaa"]
    return ["", "'s", "''s", "a<|endoftext|>b  <|endoftext|> ", "x \n y", " ", "\n\n", "don't!'s 'sam 'r"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]


def test_ids_are_the_librarys(library):
    texts = odd_texts()
    data, ends = joined(pa.array(texts), SEPARATOR)
    ids, upto = compile_tokenizer(PATH).encode(data, ends)
    at = 0
    for want, end in zip(library.encode_batch(texts, add_special_tokens=False), upto, strict=True):
        assert ids[at:end].tolist() == [*want.ids, 0]
        at = end


def test_counts_over_chunks_and_cache_resets(library):
    machine = compile_tokenizer(PATH)
    texts = random_texts(200)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    machine.CACHE, before = 10, machine.CACHE
    try:
        data, ends = joined(pa.array(texts), SEPARATOR)
        ids, upto = machine.encode(data, ends)
        assert np.split(ids, upto)[0].tolist() == [*want[0], 0] and len(ids) == sum(map(len, want)) + len(texts)
    finally:
        machine.CACHE = before
    for kept in (150_000, 40, 5):
        machine.word_machine = WordMachine(machine)
        machine.word_machine.STATES_KEPT = kept
        for part in (texts[:100], texts[100:]):
            data, ends = joined(pa.array(part), SEPARATOR)
            assert machine.count(data, ends).tolist() == [len(x) for x in library.encode_batch(part, add_special_tokens=False)]
        assert kept > 40 or len(machine.word_machine.states) <= 2 * kept + 300
    machine.word_machine = None


def test_counts_are_on_the_transitions(library):
    """Counts of words of any make and length are sums along paths through few states."""
    rnd = random.Random(11)
    texts = odd_texts() + ["a" * 5000, "ab" * 4000, "".join(rnd.choice("abcdefgh") for _ in range(20_000)), "".join(rnd.choice("éü漢字abc'") for _ in range(3000)), "x" * (3 << 20)]
    machine = WordMachine(compile_tokenizer(PATH))
    for text in texts[-5:]:
        word = text.encode()
        assert machine.count([word]) == [len(compile_tokenizer(PATH)._merge([word])[0])]
    assert len(machine.states) < 30_000
    data, ends = joined(pa.array(texts), SEPARATOR)
    assert compile_tokenizer(PATH).count(data, ends).tolist() == [len(x) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_long_texts(spark, library):
    """A text above a slice (2 MiB) and the empty text around it."""
    long = "some words and 123 numbers. " * 90_000
    df = spark.createDataFrame([(1, ""), (2, long), (3, None)], "doc_id bigint, text string")
    n = len(library.encode(long, add_special_tokens=False).ids)
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(df, PATH).collect()} == {(1, 0, 0), (2, len(long), n), (3, 0, 0)}
    rows = pack(df, PATH).collect()
    assert check_layout(rows, {2: [*library.encode(long, add_special_tokens=False).ids, 0]}) == 0
    assert {r.doc_id: r.doc_tokens for r in rows} == {1: 1, 2: n + 1, 3: 1}


def test_token_counts_of_awkward_rows(spark, library):
    df = awkward(spark)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, PATH).collect())
    want = Counter()
    for r in df.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 1024] += 1
    assert got == want
    assert token_counts(awkward(spark, False), PATH).collect() == []


def test_least_slack_is_optimal():
    rnd = random.Random(5)
    for _ in range(200):
        counts = Counter(rnd.randint(1, 60) for _ in range(rnd.randint(1, 12)))
        chosen = least_slack(dict(counts), 64)
        assert all(0 < k <= counts[n] for n, k in chosen.items())
        longest = max(counts)
        sums = {longest}
        for n in (counts - Counter([longest])).elements():
            sums |= {s + n for s in sums if s + n <= 64}
        assert sum(n * k for n, k in chosen.items()) == max(sums)


def check_layout(rows, ids_of, capacity=1024):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    waste = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
        waste += 0 if at & (at - 1) == 0 else capacity - at
    for doc, pieces in by_doc.items():
        if doc in ids_of:
            at, ids = 0, np.array(ids_of[doc], np.uint32)
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
                at += r.length
            assert at == len(ids)
    return waste


def test_packing_round_trip(spark, library):
    texts = dict(enumerate(random_texts(300, longest=900)))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    rows = pack(df, PATH, pool=64).collect()
    assert check_layout(rows, {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}) == 0


def test_packing_of_awkward_rows(spark, library):
    df = awkward(spark)
    rows = pack(df, PATH, with_ids=True).collect()
    check_layout(rows, {})
    total = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in df.collect())
    assert sum(len(r.ids) for r in rows) == total == sum(r.length for r in rows)
    assert pack(awkward(spark, False), PATH).collect() == []


def test_a_multiset_is_reused_and_slack_is_cut():
    p = Packer(16, 0)
    for k in range(9):
        p.add(k, np.arange(11, dtype=np.uint32))
    p.finish()
    sizes = Counter()
    for row in p.rows:
        sizes[row[5]] += row[2]
    assert sum(sizes.values()) == 99 and all(s == 16 or s & (s - 1) == 0 for s in sizes.values())
