"""Licence scan with a positional rare-token index. DataFrame functions only.

Templates are rows (label, text, key, base): a run of words, and a key phrase inside it that must be present word
for word. Any number of them can be given; how large their index is is checked before it is broadcast.

1. *Index.* Of each template's words the ``rare`` with the highest inverse document frequency in the
   corpus are posted with their places in the template (ties: smaller word, then smaller place).
2. *Look-up.* A posted word at file position p for template place q proposes the template at p - q. The
   postings of a template are intersected by relative position: ``agree`` of them must stand where the template
   has them. So one of the rarest ``rare - agree + 1`` is among them, and only these are looked up.
3. *Verify.* The key phrase must stand at its place. The share of the template's words that stand at their
   relative positions is the match's strength; the strongest gives the score.

A hit carries the words around it, as many as the longest template has on either side, so what is joined is
bounded by the templates and not by the text; hits are combined before they are shuffled, so a text sends one row.

Defined results: a null, empty or wordless text has no words, no places, null positions, empty
labels and score 0; a text of any length is taken whole; overlapping places all count; equal positions are
one place for each phrase; repeated rows, also under one id, each get their row, and a row without id gets one;
further columns are ignored, whatever their names; an empty table gives an empty result; a template whose key
phrase is not in its text is an error.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # words are what stands between these

# Fixed values: (label, template, key phrase). The first three are the base phrases.
BASE = [
    ("cc-by", "cc by", "cc by"),
    ("gpl", "general public license", "general public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
]
FURTHER = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
TEMPLATES = [(*t, True) for t in BASE] + [(*t, False) for t in FURTHER]
ENTRY = "word: string, place: int, rank: int, label: string, base: boolean, words: array<string>, key: array<string>, key_at: int, agree: int, posts: array<struct<word: string, place: int>>"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, BETWEEN), "")


def document_frequency(words: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Rows that hold each word. words: a column ``words``; the result has a row for each word of the vocabulary at most."""
    held = F.array_distinct(F.filter("words", lambda w: w.isin(list(vocabulary))))
    found = words.select(F.explode(held).alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in found}


def postings(templates: Sequence[tuple[str, str, str, bool]], frequency: dict[str, int], rare: int, agree: int) -> list[dict]:
    """The index: an entry for each word that is looked up, with its template."""
    out = []
    for label, text, key, base in templates:
        words, phrase = text.split(" "), key.split(" ")
        at = next((i for i in range(len(words)) if words[i : i + len(phrase)] == phrase), None)
        if at is None:
            raise ValueError(f"the key phrase {key!r} is not in its template")
        places = sorted(range(len(words)), key=lambda i: (frequency[words[i]], words[i], i))[:rare]
        enough = min(agree, len(places))
        posts = [{"word": words[i], "place": i} for i in places]
        for rank in range(len(places) - enough + 1):
            out.append(dict(posts[rank], rank=rank, label=label, base=base, words=words, key=phrase, key_at=at, agree=enough, posts=posts))
    return out


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str, str, bool]] = TEMPLATES, rare: int = 3, agree: int = 2, limit: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    vocabulary = sorted({w for _, text, *_ in templates for w in text.split(" ")})
    index = postings(templates, document_frequency(texts, vocabulary), rare, agree)
    written = json.dumps(index)
    if len(written) > limit:
        raise ValueError(f"the index of {len(templates)} templates takes {len(written)} bytes, more than limit ({limit})")
    entries = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(written), f"array<struct<{ENTRY}>>")))
    looked_up = sorted({e["word"] for e in index})
    longest = max(len(e["words"]) for e in index)
    numbers = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    seeds = F.filter(numbers, lambda i: F.get("words", i).isin(looked_up))
    around = lambda p: F.greatest(p - longest + 1, F.lit(0))
    hits = F.transform(seeds, lambda p: F.struct(p.alias("p"), F.get("words", p).alias("seed"), around(p).alias("since"), F.slice("words", around(p) + 1, p - around(p) + longest).alias("near")))
    rows = texts.select("row", "id", F.size("words").alias("n"), F.explode_outer(hits).alias("h")).select("row", "id", "n", "h.*")
    joined = rows.join(F.broadcast(entries), F.col("seed") == F.col("word"), "left")
    start = F.col("p") - F.col("place")
    at = lambda k: F.get("near", F.when(start + k >= F.col("since"), start + k - F.col("since")))
    agreeing = F.size(F.filter("posts", lambda x: at(x["place"]) == x["word"]))
    sooner = F.exists(F.slice("posts", 1, F.coalesce("rank", F.lit(0))), lambda x: at(x["place"]) == x["word"])  # a rarer word has proposed it
    key = start + F.col("key_at")
    phrase = F.when(key >= F.col("since"), F.slice("near", F.greatest(key - F.col("since"), F.lit(0)) + 1, F.size("key")) == F.col("key"))
    ok = F.coalesce((agreeing >= F.col("agree")) & ~sooner & phrase, F.lit(False))
    share = F.size(F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda k: at(k) == F.get("words", k))) / F.size("words")
    checked = joined.select("row", "id", "n", "label", "base", key.alias("key_at"), ok.alias("ok"), F.when(phrase, share).alias("share"))
    good, base = F.col("ok"), F.col("ok") & F.col("base")
    found = checked.select("row", "id", "n", F.when(good, F.col("label")).alias("label"), F.when(base, F.col("key_at")).alias("place"), F.when(base, F.col("label")).alias("base_label"), F.when(good, F.col("share")).alias("share"))
    named = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("row", "id", "n").agg(
        F.count("place").alias("n_base"), F.min("place").cast("bigint").alias("first_word"), F.max("place").cast("bigint").alias("last_word"), named("base_label").alias("base_labels"), named("label").alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score")
    ).select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
