"""Small inputs that every operator must take, and plain versions to hold results against."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def random_texts(n: int, seed: int = 1, vocabulary: int = 12, longest: int = 160) -> list[str]:
    """Texts over few words with shared passages, exact and near copies."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Émile", "ß", "x,"]
    shared = [" ".join(rnd.choice(words) for _ in range(70)) for _ in range(3)]
    out: list[str] = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.15 and out:
            out.append(rnd.choice(out))
        elif kind < 0.4 and out:
            copy = rnd.choice(out).split(" ")
            for _ in range(rnd.randint(1, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append(" ".join(copy))
        else:
            parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, longest)))]
            if rnd.random() < 0.5:
                parts.insert(rnd.randint(0, 1), rnd.choice(shared))
            out.append(rnd.choice([" ", "\n", " \t "]).join(parts))
    return out


def awkward(spark, with_rows: bool = True):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with internal ones."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, kept boolean, score string, a string, b int, x0 string, component string"
    texts = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "a b c"), (7, "long words " * 9000), (7, "long words " * 9000), (8, "long words " * 9000), (None, "a b c d e f g h"), (None, None), (9, "all rights reserved CC BY"), (10, "ünï©ödé 漢字 🙂 text")]
    rows = [(k, t, None if k == 4 else "en", "s", len(t or ""), 99, True, "score", "a", 1, "x", "c") for k, t in texts]
    return spark.createDataFrame(rows if with_rows else [], schema)


def removed(texts: dict[int, str], window: int) -> dict[int, list[bool]]:
    """Each word's fate under the passage rule, by brute force."""
    words = {k: WORD.findall(t or "") for k, t in texts.items()}
    first: dict[tuple, tuple[int, int]] = {}
    for k in sorted(words):
        for s in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][s : s + window]), (k, s))
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (k, s):
                gone[s : s + window] = [True] * window
        out[k] = gone
    return out


def shingles(text: str | None, k: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(ids: list[int], linked) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
