"""Importance resampling to a target distribution, by hashed n-gram features.

A feature is a run of 1 to ``longest`` consecutive words. Each has a bucket, and a bucket's gain is the log ratio of its
smoothed shares in the target texts and in the documents. A document's weight is the sum of its features' gains; with a
seeded Gumbel value added, the highest scores are a draw without replacement in proportion to the importance weights.

1. *Dictionary.* A task counts the different features of a slice of text (2 MiB), and sums by feature string meet in one
   shuffle, so what every text holds leaves a task once a slice. The dictionary (feature, count) goes to a checkpoint.
2. *Buckets.* Each feature of the dictionary is hashed once; counts are summed by bucket. The table of gains has as
   many rows as there are buckets.
3. *Documents.* Texts are counted document by document. Gains of features that make up more than 1 / ``often`` of all
   occurrences, so at most ``often`` features, 24 bytes each, are sent to the tasks and joined there, by 128 bits of each
   feature; the other features leave as (row, feature, count), join the dictionary by feature, no key of which is a hot one,
   and are summed by row.
4. *Draw.* ``ranked`` numbers the scores over all tasks.

Defined results: words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased; null and
empty texts have no feature and weight 0; a text of any length is counted whole. Repeated rows count as often as they
occur and each is scored and drawn for itself. A row without id has the hash of an empty id and comes after those with
ids at equal scores; of equal rows any may come first. Without target texts, or without documents, the gains come from
the smoothing alone. Further columns are ignored, whatever their names. An empty table gives an empty result. ``docs``
is to have rows in a fixed order (a stored table or a checkpoint), as any result of reading files has: rows are told apart by place.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import NO_WORD, Words, checkpointed, joined, slices, tune
from pagetally.operators.ranks import ranked

GAP = 0x20
OFTEN = 1 << 20


def _spans(words: Words, longest: int):
    """(first word, words, fingerprints) of all features."""
    for k in range(1, longest + 1):
        at = np.flatnonzero(words.fits(k))
        a, b = words.windows(k, double=True)
        yield at, np.full(len(at), k), a[at], b[at]


def _features(words: Words, longest: int) -> tuple[np.ndarray, ...]:
    found = list(_spans(words, longest))
    return tuple(np.concatenate([x[c] for x in found]) for c in range(4))


def _strings(words: Words, at: np.ndarray, k: np.ndarray) -> pa.Array:
    """Features as strings, one blank between words whatever the text has there."""
    if not len(at):
        return pa.array([], pa.string())
    word = np.repeat(at, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    size = words.end[word] - words.start[word] + 1  # and a blank after each
    place = np.repeat(words.start[word], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    data = np.concatenate([words.data, np.zeros(1, np.uint8)])[place]
    data[np.cumsum(size) - 1] = GAP
    stop = np.cumsum(np.add.reduceat(size, np.cumsum(k) - k))
    keep = np.ones(len(data), bool)
    keep[stop - 1] = False  # no blank at the end
    offsets = np.r_[0, stop - np.arange(1, len(stop) + 1)]
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep])]).cast(pa.string())


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an index of each different row of keys, how often it occurs)"""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.r_[first, len(order)])


def _count(longest: int):
    def run(batches):
        for batch in slices(batches, 0):
            words = Words(*joined(batch.column(0), GAP), lower=True, gaps=NO_WORD)
            at, k, a, b = _features(words, longest)
            pick, times = _distinct(b, a)
            for part in np.array_split(np.arange(len(pick)), len(pick) // 50_000 + 1):
                some = pick[part]
                yield pa.record_batch([_strings(words, at[some], k[some]), pa.array(times[part])], names=["feature", "times"])

    return run


def dictionary(texts: DataFrame, text_col: str, longest: int) -> DataFrame:
    """(feature, times): every feature of the texts and how often it occurs."""
    found = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(longest), "feature string, times bigint")
    return found.groupBy("feature").agg(F.sum("times").alias("times"))


def bucket(feature: str, buckets: int):
    return (F.crc32(F.encode(F.col(feature), "UTF-8")) % buckets).cast("int")


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """(bucket, times): at most ``buckets`` rows."""
    return features.groupBy(bucket("feature", buckets).alias("bucket")).agg(F.sum("times").alias("times"))


def gains(ours: DataFrame, wanted: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """((bucket, gain) of all buckets, the number of our features)."""
    spark = ours.sparkSession
    s_all, t_all = ours.agg(F.sum("times")).first()[0] or 0, wanted.agg(F.sum("times")).first()[0] or 0
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(ours.select("bucket", F.col("times").alias("s")), "bucket", "left").join(wanted.select("bucket", F.col("times").alias("t")), "bucket", "left")
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = ((t + 1.0) * F.lit(float(s_all + buckets))) / ((s + 1.0) * F.lit(float(t_all + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("bigint").alias("gain")), s_all


def _known(longest: int, often):
    """(row, feature, times, id, words, features, gain): one row for each text, with what the frequent features gain, and
    one for each other feature of a text. A text's own row has a feature that no text has, so that such rows are dealt evenly."""

    def run(batches):
        a_known, b_known, gain = often.value
        for batch in slices(batches):
            row = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            n = batch.num_rows
            words = Words(*joined(batch.column(1), GAP), lower=True, gaps=NO_WORD)
            at, k, a, b = _features(words, longest)
            doc = words.doc[at]
            features = np.bincount(doc, minlength=n)
            total = np.zeros(n, np.int64)
            rare = np.ones(len(at), bool)
            if len(a_known):
                g = np.minimum(np.searchsorted(a_known, a), len(a_known) - 1)
                hit = (a_known[g] == a) & (b_known[g] == b)
                np.add.at(total, doc[hit], gain[g[hit]])
                rare = ~hit
            left = np.flatnonzero(rare)
            pick, times = _distinct(b[left], a[left], doc[left])
            pick = left[pick]
            own = pa.array([f"\0{r}" for r in row.tolist()], pa.string())
            yield pa.record_batch([pa.array(row), own, pa.nulls(n, pa.int64()), batch.column(2), pa.array(words.count), pa.array(features), pa.array(total)], names=NAMES)
            for part in np.array_split(np.arange(len(pick)), len(pick) // 50_000 + 1):
                some, m = pick[part], len(part)
                none = pa.nulls(m, pa.int64())
                yield pa.record_batch([pa.array(row[doc[some]]), _strings(words, at[some], k[some]), pa.array(times[part]), pa.nulls(m, batch.column(2).type), none, none, none], names=NAMES)

    return run


NAMES = ["row", "feature", "times", "id", "words", "features", "gain"]


def _fingerprints(longest: int):
    """Features and gains -> 128 bits as texts give them, and gains."""

    def run(batches):
        for batch in slices(batches, 0):
            words = Words(*joined(batch.column(0), GAP), lower=True, gaps=NO_WORD)
            a, b = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            for k in range(1, longest + 1):
                own = np.flatnonzero(words.count == k)
                if len(own):
                    x, y = words.windows(k, double=True)
                    a[own], b[own] = x[words.first[own]], y[words.first[own]]
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column(1)], names=["a", "b", "gain"])

    return run


def weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", often: int = OFTEN) -> DataFrame:
    """(id, n_words, n_features, weight), a row for each row of docs, stored."""
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    own = checkpointed(dictionary(docs, text_col, longest))
    gain, total = gains(bucket_counts(own, buckets), bucket_counts(dictionary(target, target_text, longest), buckets), buckets)
    gain = checkpointed(gain)
    known = own.withColumn("bucket", bucket("feature", buckets)).join(F.broadcast(gain), "bucket").select("feature", "times", "gain")
    frequent = F.col("times") * F.lit(often).cast("decimal(20,0)") > total
    found = known.where(frequent).select("feature", "gain").mapInArrow(_fingerprints(longest), "a bigint, b bigint, gain bigint").toArrow()  # at most ``often`` rows
    a, b, g = (found[c].to_numpy() for c in ("a", "b", "gain"))
    order = np.lexsort((b.view(np.uint64), a.view(np.uint64)))
    a, b, g = a.view(np.uint64)[order], b.view(np.uint64)[order], g[order]
    if len(a) and (a[1:] == a[:-1]).any():  # 64 bits that two features share: those are joined by name
        alone = np.r_[True, a[1:] != a[:-1]] & np.r_[a[1:] != a[:-1], True]
        a, b, g = a[alone], b[alone], g[alone]
    sent = docs.sparkSession.sparkContext.broadcast((a, b, g))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    counted = rows.mapInArrow(_known(longest, sent), f"row bigint, feature string, times bigint, id {kind}, words bigint, features bigint, gain bigint")
    named = known.select(F.col("feature"), F.col("gain").alias("each"))
    met = counted.join(named, "feature", "left")
    weight = F.sum(F.coalesce(F.col("times") * F.col("each"), F.lit(0)) + F.coalesce("gain", F.lit(0)))
    out = met.groupBy("row").agg(F.max("id").alias("id"), F.max("words").alias("n_words"), F.max("features").alias("n_features"), weight.alias("weight"))
    return checkpointed(out.drop("row"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, seed: int = 2024, longest: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", often: int = OFTEN) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank): of the documents with ``least`` words or more ``percent`` of a
    hundred are drawn; rank numbers them from 1 on, the others have none."""
    scored = weights(docs, target, longest, buckets, id_col, text_col, target_text, often)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")
    scored = scored.withColumn("score", F.col("weight") + gumbel)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    placed = ranked(scored.withColumn("able", F.col("n_words") >= least), ["able"], order)
    drawn = F.col("able") & ((F.col("rank") + 1) * 100 <= F.col("total") * percent)
    return placed.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.when(drawn, F.col("rank") + 1).alias("rank"))


