import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagetally.llm.decontam import align, contaminated, has_excerpt, seeds_needed
from pagetally.llm.toxicity import CODE, LEET, LETTERS, REPEAT, SEPARATORS, SKIP, SUBSTITUTE, Tokens, _decoder, language_model, restore, suspicious, toxicity, trim
from tests.llm.helpers import LOWER, WORD, awkward, components, removed, shingles


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_restoring_distorted_words(spark, documents):
    more = spark.createDataFrame([("you idiot and moron are stupid, worthless losers " * 50,)], "text string")
    model = language_model(documents.select("text").union(more))
    for seen, meant in {"1d10t": "idiot", "m0r0n": "moron", "idiooot": "idiot", "i.d.i.o.t": "idiot", "5tupid": "stupid", "l0sers": "losers"}.items():
        assert suspicious(seen) and restore(seen, model) == meant
    assert trim("the###") == "the" and not suspicious("plain") and not suspicious("2024")


def test_restoring_against_every_path(spark, documents):
    """The best word under channel and model, by trying each reading of each character."""
    model = language_model(documents.select("text"))
    rnd = random.Random(2)

    def every(token):
        paths = [((0, 0), 0.0, "")]
        for ch in token:
            new = []
            for (a, b), score, text in paths:
                options = ([(CODE[ch], 0.0)] if ch in CODE and ch != " " else []) + [(CODE[c], SUBSTITUTE) for c in LEET.get(ch, "")]
                new += [((b, c), score + cost + float(model[a, b, c]), text + LETTERS[c]) for c, cost in options]
                if ch in SEPARATORS or not options:
                    new.append(((a, b), score + SKIP, text))
                new += [((a, b), score + REPEAT + cost, text) for c, cost in options if c == b][:1]
            paths = new
        return max(score + float(model[a, b, 0]) for (a, b), score, _ in paths), {text for (a, b), score, text in paths}

    def worth(token, word):
        best = {}
        for (a, b), score, text in _all(token):
            best[text] = max(best.get(text, -1e9), score + float(model[a, b, 0]))
        return best[word]

    def _all(token):
        paths = [((0, 0), 0.0, "")]
        for ch in token:
            options = ([(CODE[ch], 0.0)] if ch in CODE and ch != " " else []) + [(CODE[c], SUBSTITUTE) for c in LEET.get(ch, "")]
            new = []
            for (a, b), score, text in paths:
                new += [((b, c), score + cost + float(model[a, b, c]), text + LETTERS[c]) for c, cost in options]
                if ch in SEPARATORS or not options:
                    new.append(((a, b), score + SKIP, text))
                if any(c == b for c, _ in options):
                    new.append(((a, b), score + REPEAT + min(cost for c, cost in options if c == b), text))
            paths = new
        return paths

    for _ in range(200):
        token = "".join(rnd.choice("abdeiost0134571!.-$") for _ in range(rnd.randint(3, 8)))
        top, words = every(token)
        word = restore(token, model)
        assert word in words and worth(token, word) == pytest.approx(top, abs=1e-4)


def decoded(texts, model):
    """The distinct tokens of each text, plain and restored."""
    tokens = Tokens(pa.array(texts, pa.string()), _decoder(model))
    stop = np.cumsum(tokens.size)
    return {tokens.raw[b - n : b].tobytes().decode() for b, n in zip(stop, tokens.size, strict=True)}


def test_restoring_whatever_the_length(spark, documents):
    more = spark.createDataFrame([("you idiot and moron are stupid, worthless losers " * 50,)], "text string")
    model = language_model(documents.select("text").union(more))
    assert "stupid" in decoded(["st" + "u" * 40 + "pid"], model)
    assert any("idiotidiot" in t for t in decoded([" ".join("idiot" * 120)], model))
    assert any("idiot" in t and "stupid" in t for t in decoded([".".join("youstupididiotandmoron")], model))
    long = "i.d.i.o.t" * 60_000
    assert "idiotidiot" in restore(long, model) and len(restore(long, model)) > 200_000
    assert trim("--the" + "#" * 100_000) == "the"


def test_restoring_what_symbols_and_other_letters_hide(spark, documents):
    more = spark.createDataFrame([("you idiot and moron are stupid, blöd, worthless losers " * 50,)], "text string")
    model = language_model(documents.select("text").union(more))
    for seen, meant in {"b l ö d": "blöd", "B L Ö D": "blöd", "id-iot": "idiot", "stu_pid": "stupid", "mo.ron": "moron", "blÖÖÖd": "blöd", "id–iot": "idiot"}.items():
        assert meant in decoded([seen], model)
    assert {"id-iot", "idiot"} <= decoded(["id-iot,"], model) and decoded(["plain"], model) == {"plain"}
    for seen, meant in {"приввввет": "привет", "за-мок": "замок", "ξέρωωω": "ξέρω", "żżżółw": "żółw", "Ψ": "Ψ"}.items():
        assert restore(seen, model) == meant
    assert {"за-мок", "замок"} == decoded(["за-мок"], model)


def test_held_out_accuracy_and_no_leak(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = {r.doc_id: r for r in toxicity(documents, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for k, r in out.items())
    held = [(out[r.doc_id].predicted, r.toxic) for r in labels.collect() if out[r.doc_id].held_out]
    assert np.mean([p == y for p, y in held]) > 0.9
    toxic = [p for p, y in held if y == 1]
    clean = [p for p, y in held if y == 0]
    # most texts are clean, so accuracy alone says little; a third of the toxic ones hold no word that 37 others show
    assert np.mean(toxic) > 0.6 and np.mean(clean) < 0.05
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity(documents, flipped).collect()} == {k: r.score for k, r in out.items()}


def test_either_class_is_ranked_by_its_words(spark, documents):
    """Held-out rows of label 1 score higher whichever class it is that words give away."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for marks in (labels, labels.withColumn("toxic", 1 - F.col("toxic"))):
        score = {r.doc_id: r.score for r in toxicity(documents, marks).where("held_out").collect()}
        one, none = ([score[r.doc_id] for r in marks.where(F.col("toxic") == y).collect() if r.doc_id in score] for y in (1, 0))
        assert np.mean([(x > y) + (x == y) / 2 for x in one for y in none]) > 0.8


def test_sampled_classes_keep_their_share(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    empty = spark.createDataFrame([(-1, "")], "doc_id bigint, text string")
    docs = documents.select("doc_id", "text").union(empty)
    logit = {}
    for sample in (4000, 20):
        p = toxicity(docs, labels, sample=sample).where("doc_id = -1").first().score
        logit[sample] = np.log(p / (1 - p))
    assert abs(logit[20] - logit[4000]) < 1


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (6, 1), (9, 0), (9, 1)], "doc_id bigint, toxic int")
    rows = toxicity(awkward(spark), labels, carry=["text", "score"]).columns
    assert rows[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert len(toxicity(awkward(spark), labels).collect()) == 13
    assert toxicity(awkward(spark, False), labels).collect() == []
    assert {r.score < 0.01 for r in toxicity(awkward(spark), labels.where(F.lit(False))).collect()} == {True}


def smith_waterman(a, b):
    """Matched words of a best local alignment (match 2, mismatch and gap -1; of equal scores most matches)."""
    row, best = [(0, 0)] * (len(b) + 1), (0, 0)
    for x in a:
        new = [(0, 0)]
        for j, y in enumerate(b, 1):
            d = row[j - 1]
            options = [(d[0] + 2, d[1] + 1) if x == y else (d[0] - 1, d[1]), (row[j][0] - 1, row[j][1]), (new[-1][0] - 1, new[-1][1]), (0, 0)]
            top = max(o for o in options if o[0] >= 0)
            new.append(top)
        row = new
        best = max(best, *row)
    return best[1]


def test_alignment():
    rnd = random.Random(4)
    for _ in range(200):
        a = [rnd.randrange(6) for _ in range(rnd.randint(1, 15))]
        b = [rnd.randrange(6) for _ in range(rnd.randint(1, 25))]
        matched, start, stop = align(np.array(a), np.array(b))
        assert matched == smith_waterman(a, b)
        assert 0 <= start <= stop <= len(b)


def test_edited_copies_are_found_and_others_not(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(12, 60)))) for k in range(20)]
    docs, want = [], set()
    for k in range(120):
        noise = [rnd.choice(words) for _ in range(rnd.randint(0, 200))]
        if k % 3 == 0:
            q, text = rnd.choice(items)
            copy = text.split()
            for at in rnd.sample(range(len(copy)), int(0.15 * len(copy))):
                copy[at] = "edited"
            noise[len(noise) // 2 : len(noise) // 2] = [w.upper() + "," for w in copy]
            want.add((k, q))
        docs.append((k, " ".join(noise)))
    got = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.score >= 0.8 for r in got)
    blocks = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), limit=600).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == want


def test_copies_with_insertions_and_short_items(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    noise = lambda: [rnd.choice(words) for _ in range(rnd.randint(0, 150))]
    items = [(k, " ".join(rnd.choice(words) for _ in range(40))) for k in range(10)] + [(10, "ka kb kc kd ke"), (11, "la lb lc ld le")]
    docs = []
    for k in range(10):
        copy = items[k][1].split()
        for at in range(5, 37, 10):
            copy[at] = "edited"
        for at in range(38, 3, -5):
            copy.insert(at, "inserted")
        docs.append((k, " ".join(noise() + copy + noise())))
    docs += [(10, "ka kb other kd ke"), (11, "la new lb new lc new ld"), (12, "la lb other"), (13, " ".join(noise()))]
    got = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in got} == {(k, k, 0.9) for k in range(10)} | {(10, 10, 0.8), (11, 11, 0.8)}


def test_every_good_alignment_is_found(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    items = [[rnd.choice(words) for _ in range(rnd.randint(3, 25))] for _ in range(25)]
    texts = []
    for k in range(150):
        copy = [w for w in rnd.choice(items) for w in ([w] if rnd.random() < 0.85 else rnd.choice([[], ["x"], [w, "y"], ["z", w, "z"]]))]
        texts.append([rnd.choice(words) for _ in range(rnd.randint(0, 40))] + copy + [rnd.choice(words) for _ in range(rnd.randint(0, 40))])
    want = {(t, q) for t, text in enumerate(texts) for q, item in enumerate(items) if smith_waterman(item, text) >= 0.8 * len(item) - 1e-9}
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], f"{name} bigint, text string")
    got = contaminated(frame(texts, "doc_id"), frame(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.score >= 0.8 - 1e-9} == want and len(want) > 50


def test_excerpts_are_found(spark):
    words = [f"w{i}" for i in range(459)]
    items = [(1, " ".join(words[:59])), (2, " ".join(words[59:]))]
    cut = words[200:216]
    cut[3], cut[8], cut[12] = "edited", "edited", "edited"
    docs = [(1, words[7:52]), (2, words[100:400]), (3, words[100:113]), (4, words[100:112]), (5, cut), (6, cut[:15]), (7, words[70:82] + ["x"] * 20 + words[82:94])]
    got = contaminated(spark.createDataFrame([(k, "a b c " + " ".join(t) + " d e f") for k, t in docs], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in got} == {(1, 1, 45), (2, 2, 300), (3, 2, 13), (5, 2, 13)}


def test_repeated_words_need_little_memory():
    import time
    import tracemalloc

    from pagetally.llm import common
    from pagetally.llm.decontam import GAP, Items, _hits

    for item, text, copies in ((500 * ["0"], 100_000, True), (1000 * ["0"], 1_000_000, True), (250 * ["0", "1"], 100_000, False), (250 * ["0"] + ["x"] + 249 * ["0"], 100_000, True)):
        index = Items([1], [" ".join(item)], 3, 0.8, 13)
        index.choose_seeds(np.ones(len(index.terms), np.int64))
        data, ends = common.joined(pa.array(["0 " * text]), GAP)
        tracemalloc.start()
        began = time.time()
        got = list(_hits(index, common.Words(data, ends, lower=True, gaps=common.NO_WORD)))
        assert tracemalloc.get_traced_memory()[1] < 1e9 and time.time() - began < 120
        tracemalloc.stop()
        assert bool(got) == copies and (not copies or got[0][2][0] == item.count("0"))


def test_periodic_texts_against_brute_force(spark):
    rnd = random.Random(14)
    some = lambda n: [rnd.choice("ab") for _ in range(n)]
    items = [some(rnd.randint(3, 40)) for _ in range(6)] + [["0"] * 30, ["0", "1"] * 20, ["0"] * 14 + ["x"] * 30, ["|", "y"] * 9]
    texts = [rnd.choice([some(60), ["0"] * rnd.randint(10, 80), ["1", "0"] * 30, ["y"] * 20, ["0"] * 13 + some(9) + ["x"] * rnd.randint(0, 14)]) + some(rnd.randint(0, 9)) for _ in range(40)]
    want = set()
    for t, text in enumerate(texts):
        for q, item in enumerate(items):
            item = [w for w in item if w != "|"]
            n = smith_waterman(item, text)
            code = {w: k for k, w in enumerate("ab01xy")}
            if n >= 0.8 * len(item) - 1e-9 or has_excerpt(np.array([code[w] for w in item]), np.array([code[w] for w in text]), 13, 0.8):
                want.add((t, q))
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], f"{name} bigint, text string")
    import pagetally.llm.decontam as module

    found = {(r.doc_id, r.item_id) for r in contaminated(frame(texts, "doc_id"), frame(items, "item_id")).collect()}
    assert found == want and 20 < len(want) < 400
    index = module.Items(list(range(len(items))), [" ".join(i) for i in items], 3, 0.8, 13)
    words = module.Words(*module.joined(pa.array([" ".join(t) for t in texts]), 32), lower=True, gaps=module.NO_WORD)
    index.choose_seeds(np.ones(len(index.terms), np.int64))
    kept, module.PAIRS = module.PAIRS, 40
    try:
        assert {(t, q) for t, q, _ in module._hits(index, words)} == want
    finally:
        module.PAIRS = kept


def test_a_column_of_zeros_passes_the_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(1, "0 " * 200_000, "en", "s", 1), (2, "clean words", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in pipeline.drop_contaminated(spark, docs, "/root/testdata/sf0.001").collect()} == {1, 2}


def test_excerpt_rule():
    rnd = random.Random(5)

    def plain(a, b):
        """By trying each number of changes from each start."""
        for i in range(len(a)):
            for j in range(len(b)):
                best = {(i, j): {0: 0}}
                for x in range(i, len(a) + 1):
                    for y in range(j, len(b) + 1):
                        here = best.setdefault((x, y), {})
                        for dx, dy in ((1, 1), (1, 0), (0, 1)):
                            for e, m in best.get((x - dx, y - dy), {}).items():
                                same = dx and dy and a[x - 1] == b[y - 1]
                                here[e + (not same)] = max(here.get(e + (not same), 0), m + bool(same))
                        if any(m >= 4 and m >= 0.8 * (m + e) - 1e-9 for e, m in here.items()):
                            return True
        return False

    seen = set()
    for _ in range(60):
        a = [rnd.randrange(9) for _ in range(9)]
        b = [w for w in a for w in ([w] if rnd.random() < 0.6 else rnd.choice([[], [9], [w, 9]]))]
        seen.add(plain(a, b))
        assert has_excerpt(np.array(a), np.array(b), 4, 0.8) == plain(a, b)
    assert seen == {True, False}


def test_leaks_without_id_leave_the_pipeline(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, f"before {item} after"), (1, f"before {item} after"), (None, "clean words"), (2, "clean words"), (3, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = pipeline.drop_contaminated(spark, docs, sf)
    assert got.schema == docs.schema
    assert {(r.doc_id, r.text) for r in got.collect()} == {(None, "clean words"), (2, "clean words"), (3, None)}


def test_seed_bound():
    for m in range(3, 80):
        changed = int(0.2 * m + 1e-9)
        assert seeds_needed(m, 3, 0.8) <= max(1, m - 2 - 3 * changed)


def test_awkward_decontamination(spark):
    items = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (4, "x"), (5, "ONE!"), (6, "c a"), (None, "long words long words")], "item_id bigint, text string")
    rows = {(r.doc_id, r.item_id) for r in contaminated(awkward(spark), items).collect()}
    assert rows == {(None, 1), (7, None), (8, None), (4, 5), (5, 5)}  # short items match whole texts of their words
    assert contaminated(awkward(spark, False), items).collect() == []
    assert contaminated(awkward(spark), items.where(F.lit(False))).collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = docs.count()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == names and docs.count() <= kept
            kept = docs.count()
    whole = pipeline.run(spark, sf)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    total = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert total(whole) == total(docs) and set(key) <= set(whole.columns)
    items = [re.sub(r"\W+", " ", r.text).lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    last = spark.read.parquet(str(tmp_path / "benchmark_decontamination")).collect()
    assert not any(i in re.sub(r"\W+", " ", r.text).lower() for r in last for i in items)


def test_pipeline_against_plain_stages(spark, monkeypatch):
    """All stages but the scores, which are taken as they come, by brute force over small documents."""
    import corpus_pipeline as pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if r.doc_id not in toxic}
    sets = {k: shingles(t, 5) for k, t in texts.items()}
    near = lambda i, j: bool(sets[i]) and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    texts = {k: texts[k] for k, root in components(sorted(texts), near).items() if k == root}
    gone = removed(texts, 50)
    kept = {}
    for k, t in texts.items():
        spans = list(WORD.finditer(t or ""))
        out, at = [], 0
        for i, (m, g) in enumerate(zip(spans, gone[k], strict=True)):
            if g and (i == 0 or not gone[k][i - 1]):
                out.append((t or "")[at : m.start()])
            if g:
                at = spans[i + 1].start() if i + 1 < len(spans) else len(t or "")
        kept[k] = "".join(out) + (t or "")[at:]
    plain = lambda t: "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (t or "").translate(LOWER)).split()
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {}
    for k, t in kept.items():
        words = plain(t)
        code = {w: i for i, w in enumerate(dict.fromkeys(words))}
        text = np.array([code[w] for w in words], np.int64)
        hit = False
        for item in items:
            of = np.array([code.get(w, -1) for w in item], np.int64)
            there = (of >= 0).sum()
            hit |= bool(there >= 0.8 * len(item) and align(of, text)[0] >= 0.8 * len(item) - 1e-9 or there >= 13 and has_excerpt(of, text, 13, 0.8))
        if not hit:
            clean[k] = t
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in clean.items()}
    rows = pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == want
    held = {}
    for r in rows:
        held.setdefault(r.doc_id, []).append((r.start, r.length))
    for k, pieces in held.items():
        assert sum(n for _, n in pieces) == want[k] and all(a + n == b for (a, n), (b, _) in zip(sorted(pieces), sorted(pieces)[1:], strict=False))
    assert 20 < len(want) < docs.count()


@pytest.mark.parametrize("with_rows", [True, False])
def test_stages_take_awkward_documents(spark, tmp_path, with_rows):
    import corpus_pipeline as pipeline

    docs = awkward(spark, with_rows)
    after = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = [tuple(r) for r in docs.collect()]
    if with_rows:
        assert len(after["toxicity"]) == 13 and all(r[2] == (None if r[0] == 4 else "en") for r in after["toxicity"])
        cut_ = {r[0]: r[1] for r in after["suffix_array_dedup"]}
        assert cut_[1] is None and cut_[2] == "" and cut_[3] == "   \n\t " and cut_[6] == "a b c" and cut_[10] == "ünï©ödé 漢字 🙂 text"
        assert len(cut_[7].split()) < 200 and len(after["suffix_array_dedup"]) == len(after["minhash_near_dedup"]) == len(after["benchmark_decontamination"])
        assert {r[0] for r in after["packing"]} == {None, 1, 2, 3, 4, 6, 7, 9, 10}
    near = spark.read.parquet(str(tmp_path / "minhash_near_dedup"))
    kept = [r.doc_id for r in near.collect()]
    assert sorted(k for k in kept if k is not None) == ([1, 2, 3, 4, 6, 7, 7, 9, 10] if with_rows else []) and kept.count(None) == 2 * with_rows
    assert (docs.count() > 0) == with_rows
