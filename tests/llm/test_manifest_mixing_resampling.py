import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagetally.llm.merkle import fold, merkle_manifest, siblings
from pagetally.llm.mixing import mix, water_level
from pagetally.llm.resampling import dictionary, resample, weights
from tests.llm.helpers import LOWER, WORD, awkward, random_texts

FIELDS = ["doc_id", "lang", "text"]
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fan):
    """(top, siblings of each leaf level by level as (left, right))"""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k in range(len(paths)):
            begin = at[k] // fan * fan
            run = level[begin : begin + fan]
            paths[k].append(("".join(run[: at[k] - begin]), "".join(run[at[k] - begin + 1 :])))
            at[k] //= fan
        level = [H(*level[b : b + fan]) for b in range(0, len(level), fan)]
    return level[0], paths


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


@pytest.mark.parametrize(("fan", "height"), [(2, 10), (2, 2), (3, 1), (5, 2)])
def test_manifest_equals_a_plain_tree(spark, fan, height):
    rnd = random.Random(fan)
    rows = [(k * 3, rnd.choice(["en", "en", "en", "de", None, "é", "fr"]), rnd.choice(["x", "", None, "Émile " * k])) for k in range(90)] + [(7, "lone", "t"), (None, "en", "t"), (None, "en", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(5)
    seen = {"text": F.when(F.col("doc_id") % 2 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))}
    out = merkle_manifest(df, FIELDS, "lang", fan=fan, height=height, presented=seen)
    got = out.select("doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof"), fold(F.col("presented_leaf"), F.col("path")).alias("folded")).collect()
    groups = {}
    for k, g, t in rows:
        groups.setdefault(g, []).append((k is not None, k or 0, H(field(k), field(g), field(t)), k, g, t))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subtrees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fan) for g in names}
    root, above = tree([subtrees[g][0] for g in names], fan)
    want = []
    for g, up in zip(names, above, strict=True):
        for (*_, leaf, k, _, t), path in zip(sorted(groups[g], key=lambda x: x[:3]), subtrees[g][1], strict=True):
            node = H(field(k), field(g), field(None if t is None else t + "!")) if k is not None and k % 2 else leaf
            for left, right in path + up:
                node = H(left, node, right)
            want.append((k, leaf, subtrees[g][0], root, "".join(a + b for a, b in path + up), node))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(g.folded != g.root for g in got) and any(g.folded == g.root for g in got)


def test_manifest_of_awkward_rows(spark):
    df = awkward(spark)
    rows = merkle_manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang").collect()
    assert len(rows) == 13 and len({r.root for r in rows}) == 1 and len({r.subroot for r in rows}) == 2
    one = next(r for r in rows if r.doc_id == 4)  # the only row without lang: its leaf is the subroot
    assert one.subroot == one.leaf == H("1:4", "1:s", "-", "1:3", "3:one")
    assert len({(r.leaf, str(r.path)) for r in rows if r.doc_id == 7}) == 2 and len({r.leaf for r in rows if r.doc_id == 7}) == 1
    assert merkle_manifest(awkward(spark, False), ["doc_id", "text"], "lang").collect() == []


def test_water_level(spark):
    rnd = random.Random(2)
    for _ in range(6):
        sources = [(rnd.randint(1, 9), rnd.randint(0, 300)) for _ in range(rnd.randint(1, 9))]
        budget = rnd.random() * sum(c for _, c in sources)
        level = water_level(spark.createDataFrame(sources, "weight bigint, cap bigint"), budget)
        assert math.isclose(sum(min(c, level * w) for w, c in sources), budget, rel_tol=1e-9, abs_tol=1e-9)
    assert water_level(spark.createDataFrame([(1, 5)], "weight bigint, cap bigint"), 9.0) == math.inf


@pytest.mark.parametrize("small", [8 << 20, 0])
def test_mix_meets_targets(spark, monkeypatch, small):
    monkeypatch.setattr("pagetally.llm.mixing.SMALL", small)
    rnd = random.Random(3)
    sizes = {"a": 700, "b": 40, "c": 90, "d": 3, None: 60}
    rows = [(k, g, " ".join(["w"] * rnd.randint(0, 60))) for k, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = mix(df.repartition(6), [5, 2, 1]).collect()
    again = mix(df.orderBy(F.hash("text", "doc_id")).repartition(3), [5, 2, 1]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = {r.doc_id: r.taken for r in mix(df, [5, 2, 1], seed=1).collect()}
    assert other != {r.doc_id: r.taken for r in got}
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.size == len(WORD.findall(rows[r.doc_id][2]))
        by.setdefault(r.source, []).append(r)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(total)
    level = {g: rs[0].target / w for (g, rs), w in zip(sorted(by.items(), key=lambda x: (x[0] is None, x[0])), [5, 2, 1, 5, 2], strict=True) if rs[0].target < 3 * rs[0].source_size}
    assert max(level.values()) == pytest.approx(min(level.values()))
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 0.5 and rs[0].source_size == sum(r.size for r in rs)
        partly = [r for r in rs if r.taken not in (r.whole * r.size, (r.whole + 1) * r.size)]
        assert len(partly) <= 1


def test_mix_of_awkward_rows(spark):
    rows = mix(awkward(spark), [5, 2, 1]).collect()
    assert len(rows) == 13 and all(r.taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert len({r.taken for r in rows if r.doc_id == 7}) == 1
    assert mix(awkward(spark, False), [5, 2, 1]).collect() == []
    blank = mix(spark.createDataFrame([(1, "s", None), (2, None, " ")], "doc_id bigint, source string, text string"), [1])
    assert {(r.doc_id, r.target, r.taken) for r in blank.collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    same = spark.createDataFrame([(1, "s", "a b c")] * 7 + [(1, "t", "a " * 90)], "doc_id bigint, source string, text string")
    # 111 words, half of them 55.5, evenly 27.75 each: 7 equal rows hold 21 words and are taken once (27.75 - 21 = 7 words, 1 each)
    assert {(r.source, r.taken) for r in mix(same, [1], share=0.5, epochs=2).collect()} == {("s", 4), ("t", 28)}


def grams(text, longest):
    w = TERM.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize(("longest", "often"), [(1, 1 << 20), (2, 40), (3, 0)])
def test_resampling_equals_plain_counts(spark, longest, often):
    texts = dict(enumerate(random_texts(120, seed=8, vocabulary=60))) | {500: None, 501: "", 502: "Ünï CODE x-y x_y"}
    wanted = random_texts(30, seed=9, vocabulary=20)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    target = spark.createDataFrame([(t,) for t in wanted], "text string")
    got = {r.doc_id: r for r in resample(df, target, percent=30, least=20, longest=longest, buckets=97, often=often).collect()}
    own = {k: grams(t, longest) for k, t in texts.items()}
    s, t = Counter(), Counter()
    for _, f in own.values():
        s.update(zlib.crc32(x.encode()) % 97 for x in f)
    for x in wanted:
        t.update(zlib.crc32(g.encode()) % 97 for g in grams(x, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 97) / ((s[b] + 1) * (T + 97)))) for b in range(97)]
    scores = {}
    for k, (w, f) in own.items():
        h = int(H(f"2024:{k}")[:8], 16)
        weight = sum(gain[zlib.crc32(x.encode()) % 97] for x in f)
        scores[k] = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        assert (got[k].n_words, got[k].n_features, got[k].weight, got[k].score) == (len(w), len(f), weight, scores[k])
    able = sorted((k for k in own if len(own[k][0]) >= 20), key=lambda k: (-scores[k], k))
    drawn = able[: 30 * len(able) // 100]
    assert {k: r["rank"] for k, r in got.items() if r["rank"]} == {k: n + 1 for n, k in enumerate(drawn)}


def test_dictionary_has_each_feature_once(spark):
    texts = random_texts(60, seed=4)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    rows = dictionary(df, "text", 2).collect()
    want = Counter(g for t in texts for g in grams(t, 2)[1])
    assert {r.feature: r.times for r in rows} == want and len(rows) == len(want)


def test_resampling_of_awkward_rows(spark):
    none = spark.createDataFrame([], "text string")
    rows = resample(awkward(spark), none, percent=50).collect()
    assert len(rows) == 13 and {r.weight for r in rows if r.doc_id in (1, 2, 3)} == {0}
    able = [r for r in rows if r.n_words >= 20]
    assert sorted(r["rank"] for r in able if r["rank"]) == list(range(1, len(able) * 50 // 100 + 1))
    assert weights(awkward(spark, False), none).collect() == []
    assert {r.doc_id for r in resample(awkward(spark).withColumn("doc_id", F.col("doc_id").cast("string")), none).collect()} == {None, *map(str, range(1, 11))}
