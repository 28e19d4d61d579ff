import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetally.llm import quantised
from pagetally.llm.licenses import TEMPLATES, scan_licenses
from pagetally.llm.queries import URL_RULES
from pagetally.llm.quantised import similar_vectors
from pagetally.llm.urlfilter import build_cascade, filter_urls
from tests.llm.helpers import awkward, components


def vectors(n, width=16, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, width))
    out = []
    for k in range(n):
        x = rng.normal(size=width) if k % 3 else centre[k % 12] + rng.normal(size=width) * rng.choice([0, 0.05, 0.15])
        out.append((k, [float(v) for v in x.astype(np.float32)]))
    return out


def links_of(rows):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x @ x.T >= 0.95


def test_few_vectors_are_compared_whole(spark):
    rows = vectors(400)
    near = links_of(rows)
    want = components([k for k, _ in rows], lambda i, j: near[i, j])
    out = similar_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {k: (int(near[k].sum()) - 1, want[k]) for k, _ in rows}


@pytest.mark.parametrize("recall", [0.995, 1.0])
def test_recall(spark, recall):
    rows = vectors(2500, seed=4)
    out = similar_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), recall=recall)
    near = links_of(rows)
    found, links = out.agg(F.sum("n_links")).first()[0], int(near.sum()) - len(rows)
    assert (0.97 if recall < 1 else 0.995) * links <= found <= links


def test_recall_in_few_dimensions(spark):
    """Vectors that spread in 5 of 256 directions lie much closer to the lists' boundaries than their length tells."""
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(256, 5)))[0]
    rows = [(k, [float(v) for v in x]) for k, x in enumerate((rng.normal(size=(3000, 5)) @ basis.T).astype(np.float32))]
    near = links_of(rows)
    found = similar_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).agg(F.sum("n_links")).first()[0]
    links = int(near.sum()) - len(rows)
    assert 0.97 * links <= found <= links


def test_blocks_and_levels(spark, monkeypatch):
    """Small blocks, and more lists than coarse centres, so that both levels are used."""
    for name, value in (("MEMBERS", 20), ("QUERIES", 40), ("PER_LIST", 10), ("TOP", 12)):
        monkeypatch.setattr(quantised, name, value)
    rows = vectors(1500, seed=8)
    near = links_of(rows)
    found = similar_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).agg(F.sum("n_links")).first()[0]
    links = int(near.sum()) - len(rows)
    assert 0.97 * links <= found <= links


def test_every_length_is_compared(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(v) for v in rng.normal(size=width)]) for k, width in enumerate([4] * 1100 + [7] * 50 + [9] * 30)]
    rows += [(k + 5000, [2 * v for v in x]) for k, x in rows if k % 2]
    out = similar_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    by = {r.vec_id: r for r in out}
    assert all(by[k + 5000].component_id == by[k].component_id and by[k].n_links >= 1 for k in range(1, 1180, 2))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (7, [2.0, 4.0]), (8, [1.0]), (11, [3.0]), (12, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 2.0]), (10, [-1.0, -2.0])]
    df = spark.createDataFrame([(*r, 0, "x", 1.0) for r in rows], "vec_id bigint, embedding array<float>, id int, list string, error double")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in similar_vectors(df).collect()), key=str)
    want = [(k, 0, k, True) for k in (1, 2, 3, 4, 5, 9, 10, 12)] + [(8, 1, 8, True), (11, 1, 8, False), (6, 2, 6, True), (7, 2, 6, False), (7, 2, 6, False), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert similar_vectors(df.where(F.lit(False))).collect() == []


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")


def test_url_rules(spark):
    rnd = random.Random(2)
    urls = [None, "", "://", "x://", "http://NET", "http://a.net?x=/", "https://Example.NET/en/x#y", "http://wexample.net/en/", "ftp://a.b.org/fr/", "http://org/fr", "http://a://b.net/"]
    urls += [f"http://{rnd.choice(['', 'www.', 'a.b.'])}{rnd.choice(['example.net', 'example.com', 'x.org', 'org', 'NET', 'inet'])}{rnd.choice(['', '/', '/en/', '/de/1', '/fr/2', '/en'])}{rnd.choice(['', '?q=/de/', '#/fr/'])}" for _ in range(300)]
    df = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)], "page_id bigint, url string, host string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, URL_RULES).collect()}
    assert got == {k: judge(u) for k, u in enumerate(urls)}
    assert filter_urls(df.where(F.lit(False)), URL_RULES).collect() == []


def test_many_rules_and_ties(spark):
    rnd = random.Random(4)
    name = lambda: "".join(rnd.choice("ab") for _ in range(3))
    rules = [(".".join(name() for _ in range(rnd.randint(1, 2))), rnd.choice(["/", "/x/", "/xy/"]), rnd.choice(["allow", "block", "review"])) for _ in range(60)]
    urls = [f"http://{'.'.join(name() for _ in range(rnd.randint(1, 4)))}{rnd.choice(['/', '/x/', '/xy/z', ''])}" for _ in range(400)]
    first = {}
    for h, p, v in rules:
        first.setdefault(h + p, v)

    def judged(url):
        host, slash, path = url[7:].partition("/")
        fit = [(len(h + p), len(h), h + p) for h, p, _ in rules if (host == h or host.endswith("." + h)) and (slash + path).startswith(p)]
        return (max(fit)[2], first[max(fit)[2]]) if fit else (None, "none")

    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in filter_urls(df, rules, default="none").collect()} == {k: judged(u) for k, u in enumerate(urls)}
    assert {r.verdict for r in filter_urls(df, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("xxhash64(key) % 40 = 0")
    cascade = build_cascade(universe, listed)
    assert len(cascade.levels) > 1
    wrong = universe.where(cascade.test(F.col("key")) != (F.xxhash64("key") % 40 == 0)).count()
    assert wrong == 0 and cascade.nbytes() < 8 * listed.count()


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_scan(texts, templates, rare=3, agree=2):
    """Each text's row, by comparing every template with every place."""
    words = [WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    frequency = Counter(w for ws in words for w in set(ws))
    out = []
    for ws in words:
        base, labels, score = [], set(), 0.0
        for label, text, key, is_base in templates:
            t, k = text.split(), key.split()
            inside = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            rarest = sorted(range(len(t)), key=lambda i: (frequency[t[i]], t[i], i))[:rare]
            for p in range(len(ws)):
                start = p - inside
                there = [0 <= start + i < len(ws) and ws[start + i] == t[i] for i in range(len(t))]
                if ws[p : p + len(k)] == k and sum(there[i] for i in rarest) >= min(agree, len(rarest)):
                    labels.add(label)
                    score = max(score, sum(there) / len(t))
                    if is_base:
                        base.append((p, label))
        first, last = (min(base)[0], max(base)[0]) if base else (None, None)
        out.append((len(ws), len(base), first, last, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
    return out


def scanned(spark, texts, templates):
    df = spark.createDataFrame([(k, t, "w", "n") for k, t in enumerate(texts)], "doc_id bigint, text string, words string, row string")
    return [tuple(r[1:]) for r in sorted(scan_licenses(df, templates).collect())]


def test_licences(spark):
    rnd = random.Random(8)
    words = "cc by all rights reserved general public license mit the released under Apache version 2 0 licensed é x1".split()
    texts = [None, "", "CC BY CC by!cc-by", "all rights reserved", "Permission is hereby granted, free of charge to any person obtaining a copy"]
    texts += [rnd.choice([" ", "-", ". "]).join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    texts += [f"x {text.upper()}. {rnd.choice(words)}" for _, text, _, _ in TEMPLATES]
    assert scanned(spark, texts, TEMPLATES) == plain_scan(texts, TEMPLATES)
    assert scan_licenses(awkward(spark, False)).collect() == []
    rows = scan_licenses(awkward(spark)).collect()
    assert len(rows) == 13 and sum(r.doc_id is None for r in rows) == 2
    assert {(r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in rows if r.doc_id == 9} == {(2, 0, 3, "cc-by,reserved", "cc-by,reserved")}
    assert all((r.n_base, r.first_word, r.labels, r.score) == (0, None, "", 0.0) for r in rows if r.doc_id in (1, 2, 3, 7, 8))


def test_thousands_of_templates(spark):
    """Templates are data: very many of them, long ones and such that share all words but the order."""
    rnd = random.Random(9)
    words = [f"l{i}" for i in range(300)]
    templates = []
    for k in range(3000):
        text = [rnd.choice(words) for _ in range(rnd.randint(2, 25))]
        a = rnd.randrange(len(text) - 1)
        templates.append((f"t{k % 500}", " ".join(text), " ".join(text[a : a + rnd.randint(1, 6)]), k % 10 == 0))
    texts = []
    for _ in range(60):
        parts = [rnd.choice(words) for _ in range(30)]
        for _ in range(rnd.randint(0, 3)):
            template = rnd.choice(templates)[1].split()
            if rnd.random() < 0.5:
                template[rnd.randrange(len(template))] = "changed"
            parts += template + [rnd.choice(words)]
        texts.append(" ".join(parts))
    got = scanned(spark, texts, templates)
    assert got == plain_scan(texts, templates) and sum(r[1] for r in got) > 5
