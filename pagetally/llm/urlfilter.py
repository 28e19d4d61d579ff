"""URL filtering with a cascade of Bloom filters.

A rule is (host suffix, path prefix, verdict). Every URL has the keys ``suffix/prefix`` for all
suffixes of its host and all prefixes of its path that a rule could have; the listed keys are the
rules. Level 0 of the cascade encodes the listed keys; the corpus's key universe is run through it
and what passes without being listed is encoded in level 1; listed keys that pass level 1 go to
level 2, and so on until nothing passes wrongly. Over that universe membership is then exact, so
no URL needs a join with the list. The verdict of a rule that fits comes the same way: for each verdict but
one a cascade over the listed keys encodes those that have it, so the plan does not grow with the list.

The filters' bits come to a few for each listed key: level 0 takes its false-positive rate from
the sizes of list and universe, so that what passes is about as much as is listed. The bits are
set by an aggregation; the driver gets the finished filters only, and their size is checked before
they are broadcast inside the query.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; the
method's own verdict for URLs without a rule is ``allow``; of two fitting rules of one length the one with the
longer host wins, and of two rules for one host and path the one that comes first; a URL of any length is judged
whole; repeated rows, and rows without id, each get their row; further columns are ignored, whatever their names;
an empty table gives an empty result, and without rules every verdict is the method's own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import checkpointed

LIMIT = 64 << 20  # bytes of all levels together
WORD = 32  # bits of a filter's unit


def parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) of a URL; both empty where there is no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _prefixes(path: Column, lengths: Sequence[int]) -> Column:
    """The path's prefixes of the lengths that rules have (characters)."""
    fit = [F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in lengths]
    return F.array_compact(F.array(*fit))


def keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All ``suffix`` + ``prefix`` keys, as an array. Labels of the host are its parts between dots."""
    labels = F.split(host, r"\.", -1)
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.flatten(F.transform(suffix, lambda s: F.transform(_prefixes(path, lengths), lambda p: F.concat(s, p)))))


def _slots(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), F.lit(bits)) for i in range(hashes)]


class Cascade:
    """Levels of (bits, hashes, words). ``test`` is exact for every key of the universe it was built on."""

    def __init__(self, levels: list[tuple[int, int, list[int]]]):
        self.levels = levels

    def nbytes(self) -> int:
        return sum(len(words) * WORD // 8 for _, _, words in self.levels)

    def passes(self, key: Column, level: int) -> Column:
        bits, hashes, words = self.levels[level]
        held = F.array(*[F.lit(w) for w in words]) if len(words) <= 64 else F.from_json(F.lit(str(words)), "array<bigint>")
        hit = [F.bit_get(F.get(held, F.floor(s / WORD).cast("int")), (s % WORD).cast("int")) == 1 for s in _slots(key, level, bits, hashes)]
        return reduce(lambda a, b: a & b, hit)

    def test(self, key: Column) -> Column:
        """Listed iff the first level that the key does not pass is an odd one (counting from 0)."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self.passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def _build(keys_of: DataFrame, level: int, n: int, rate: float) -> tuple[int, int, list[int]]:
    bits = max(WORD, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    bits = -(-bits // WORD) * WORD
    if bits // 8 > LIMIT:
        raise ValueError(f"a level needs {bits // 8} bytes; at most {LIMIT} are broadcast. Split the list by host.")
    hashes = max(1, round(bits / max(n, 1) * math.log(2)))
    hashes = min(hashes, 24)
    slots = keys_of.select(F.explode(F.array(*_slots(F.col("key"), level, bits, hashes))).alias("slot"))
    word = F.floor(F.col("slot") / WORD).cast("int")
    rows = slots.groupBy(word.alias("w")).agg(F.bit_or(F.pow(F.lit(2.0), F.col("slot") % WORD).cast("bigint")).alias("v")).collect()  # at most bits / WORD rows
    words = [0] * (bits // WORD)
    for r in rows:
        words[r.w] = r.v
    return bits, hashes, words


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """universe, listed: one column ``key``. Listed keys that the universe lacks are kept as well."""
    listed = listed.select("key").where(F.col("key").isNotNull()).distinct()
    others = universe.select("key").where(F.col("key").isNotNull()).join(listed, "key", "left_anti")
    r = listed.count()
    if r == 0:
        return Cascade([])
    s = others.agg(F.approx_count_distinct("key").alias("n")).first().n
    cascade = Cascade([])
    rate = max(1e-6, min(0.5, r * math.sqrt(2) / max(s, 1)))
    include, exclude, n = listed, others, r
    for level in range(64):
        cascade.levels.append(_build(include, level, n, rate if level == 0 else 0.5))
        if cascade.nbytes() > LIMIT:
            raise ValueError("the cascade is too large to broadcast; split the list by host")
        wrong = checkpointed(exclude.where(cascade.passes(F.col("key"), level)).distinct())
        passed = wrong.count()  # about as much as is listed, however large the universe
        if not passed:
            return cascade
        include, exclude, n = wrong, include, passed
    raise ValueError("the cascade does not end")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict). rules: (host, path, verdict), all with distinct host + path;
    the fitting rule with the longest host + path wins."""
    lengths = sorted({len(p) for _, p, _ in rules})
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    keyed = rows.withColumn("keys", keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys").alias("key"))
    of: dict[str, str] = {}
    for h, p, v in rules:
        of.setdefault(h + p, v)
    listed = pages.sparkSession.createDataFrame(list(of.items()), "key string, verdict string")
    cascade = build_cascade(universe, listed)
    hits = F.filter("keys", cascade.test) if cascade.levels else F.array().cast("array<string>")
    best = F.reduce(hits, F.lit(""), lambda a, k: F.when(F.length(k) > F.length(a), k).otherwise(a))
    verdicts = sorted(set(of.values()))
    verdict = F.lit(verdicts[-1]) if verdicts else F.lit(default)
    for v in verdicts[:-1]:
        verdict = F.when(build_cascade(listed, listed.where(F.col("verdict") == v)).test(F.col("rule")), v).otherwise(verdict)
    verdict = F.when(F.col("rule").isNull(), default).otherwise(verdict)
    out = keyed.withColumn("rule", F.nullif(best, F.lit("")))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"))
