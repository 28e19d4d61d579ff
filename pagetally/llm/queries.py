"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetally.llm.common import tune
from pagetally.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return table(spark, sf_dir, "documents")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagetally.llm.packing import pack

    return pack(_documents(spark, sf_dir), _tokenizer(), capacity=1024)


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagetally.llm.tokens import token_counts

    return token_counts(_documents(spark, sf_dir), _tokenizer(), limit=1024)


#: Fixed by the query's contract: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagetally.llm.urlfilter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op6_url_filter"] = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules(h, pre, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT page_id, h || pre AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC) AS k
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)
)
SELECT p.page_id, p.host, p.path, m.rule AS rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagetally.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"), rare=3, agree=2)


def _license_sql() -> str:
    from pagetally.llm.licenses import TEMPLATES

    rows = []
    for n, (label, text, key, base) in enumerate(TEMPLATES):
        words, phrase = text.split(" "), key.split(" ")
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        rows.append(f"({n}, {base}, '{label}', {words}, {phrase}, {at})")
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), t(no, base, label, tw, ph, place) AS (VALUES {", ".join(rows)}
), f AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS word FROM d) GROUP BY word
), tp AS (SELECT no, unnest(range(0, len(tw))) AS k, unnest(tw) AS word FROM t
), ranked AS (SELECT no, k, tp.word, row_number() OVER (PARTITION BY no ORDER BY coalesce(n, 0), tp.word, k) AS r FROM tp LEFT JOIN f USING (word)
), post AS (SELECT no, list({{'k': k, 'word': word}}) AS posts FROM ranked WHERE r <= 3 GROUP BY no
), hit AS (
  SELECT doc_id, w, base, label, tw, place, posts, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1] = ph[1] AND w[i + 1 : i + len(ph)] = ph)) AS p
  FROM d, t JOIN post USING (no) WHERE list_has_all(w, ph)
), scored AS (
  SELECT doc_id, base, label, p, len(list_filter(range(0, len(tw)), lambda k: p - place + k >= 0 AND w[p - place + k + 1] = tw[k + 1])) / len(tw) AS share FROM hit
  WHERE len(list_filter(posts, lambda x: p - place + x.k >= 0 AND w[p - place + x.k + 1] = x.word)) >= least(2, len(posts))
), agg AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(p) FILTER (base) AS first_word, max(p) FILTER (base) AS last_word,
         coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ','), '') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
  FROM scored GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN agg USING (doc_id)
"""


ORACLES["op8_license_scan"] = _license_sql()


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagetally.llm.factors import factor_duplicates

    out = factor_duplicates(_documents(spark, sf_dir), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each span of words (from 0, stop exclusive) that repeats earlier text; other documents have none."""
    from pagetally.llm.suffixes import suffix_duplicates

    out = suffix_duplicates(_documents(spark, sf_dir), window=50)
    span = F.explode("spans").alias("span")
    return out.select("doc_id", "n_words", span).select("doc_id", F.col("span.start").alias("start_word"), F.col("span.stop").alias("stop_word"), F.col("n_words").alias("doc_words"))


def _repeats_sql(window: int) -> str:
    """c: (doc_id, word x) of all repeated words; d: documents and their words."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), p AS (SELECT doc_id, unnest(range(0, len(w) - {window - 1})) AS s, w FROM d WHERE len(w) >= {window}
), h AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + {window}], ' ') AS k FROM p
), r AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM h) WHERE n > 1
), c AS (SELECT DISTINCT doc_id, unnest(range(s, s + {window})) AS x FROM r)
"""


ORACLES["op5_substring_dedup"] = _repeats_sql(20) + """
, g AS (SELECT doc_id, list(x) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_where(w, [NOT list_contains(coalesce(gone, []), i) FOR i IN range(0, len(w))]), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
ORACLES["op9_suffix_dedup"] = _repeats_sql(50) + """
, i AS (SELECT doc_id, x, x - row_number() OVER (PARTITION BY doc_id ORDER BY x) AS island FROM c)
SELECT doc_id, CAST(min(x) AS BIGINT) AS start_word, CAST(max(x) + 1 AS BIGINT) AS stop_word, CAST(any_value(len(w)) AS BIGINT) AS doc_words
FROM i JOIN d USING (doc_id) GROUP BY doc_id, island
"""


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagetally.llm.setsketch import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), shingle=4, percent=80)


ORACLES["op10_near_dedup"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, greatest(len(w) - 2, 2))]) AS g FROM d WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT u, v FROM l JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id
), c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagetally.llm.quantised import similar_vectors

    return similar_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


ORACLES["op7_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_inner_product(x, x) > 0
), e AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT e.w, r.c FROM r JOIN e ON e.u = r.vec_id
), c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id
), n AS (SELECT u AS vec_id, count(*) AS n FROM e GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it copies; clean documents have none."""
    from pagetally.llm.decontam import contaminated

    return contaminated(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), n=3, identity=0.8)


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagetally.llm.toxicity import toxicity

    return toxicity(_documents(spark, sf_dir), table(spark, sf_dir, "labels"), sample=4000, threshold=0.3)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagetally.llm.merkle import fold, merkle_manifest, siblings

    chars = F.col("n_chars").cast("decimal(20,0)")
    later = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, chars + 1).otherwise(chars)
    out = merkle_manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], group="lang", fan=2, presented={"n_chars": later})
    out = out.withColumn("folded_root", fold(F.col("presented_leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes (polynomial 0xEDB88320, reflected)."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2))::BIGINT)"
    step = "list_reduce([xor(c, d)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(4294967295, list_reduce([4294967295] || {octets}, lambda c, d: {step}))"


def _field_sql(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode({value})) AS VARCHAR) || ':' || {value}, '-')"


def _leaf_sql(n_chars: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(map(_field_sql, fields)) + ")"


ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS later FROM documents
), l AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("later")} AS seen FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER () AS k FROM l
), low(t, lvl, i, n, h) AS (
  SELECT g, 0, pos, n, leaf FROM p
  UNION ALL SELECT t, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY t, lvl, i // 2, n
), high(t, lvl, i, n, h) AS (
  SELECT -1, 0, t, count(*) OVER (), h FROM low WHERE n = 1
  UNION ALL SELECT t, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY t, lvl, i // 2, n
), nd AS (SELECT * FROM low UNION ALL SELECT * FROM high
), up(k, g, t, lvl, i, h, proof) AS (
  SELECT k, g, g, 0, pos, seen, '' FROM p
  UNION ALL
  SELECT k, g, CASE WHEN e.n > 1 THEN up.t ELSE -1 END, CASE WHEN e.n > 1 THEN up.lvl + 1 ELSE 0 END, CASE WHEN e.n > 1 THEN up.i // 2 ELSE g END,
         CASE WHEN e.n = 1 THEN up.h WHEN s.h IS NULL THEN sha256(up.h) WHEN up.i % 2 = 0 THEN sha256(up.h || s.h) ELSE sha256(s.h || up.h) END,
         CASE WHEN e.n = 1 THEN proof ELSE proof || coalesce(s.h, '') END
  FROM up JOIN nd e ON e.t = up.t AND e.lvl = up.lvl AND e.i = up.i LEFT JOIN nd s ON s.t = up.t AND s.lvl = up.lvl AND s.i = xor(up.i, 1)
  WHERE e.n > 1 OR up.t >= 0
)
SELECT doc_id, leaf, b.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, up.h AS folded_root, up.h = r.h AS verified
FROM up JOIN nd r ON r.t = -1 AND up.t = -1 AND r.lvl = up.lvl AND r.n = 1 JOIN p USING (k) JOIN low b ON b.t = p.g AND b.n = 1
"""


@query
def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagetally.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents"), weights=[5, 2, 1], share=1.0, epochs=3, seed=2024)
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op12_source_mixing"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source
), lv(level, last) AS (
  SELECT CAST(0 AS DOUBLE), CAST(-1 AS DOUBLE)
  UNION ALL
  SELECT ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * source_size) FROM s WHERE 3 * source_size <= level * w), 0)) / (SELECT CAST(sum(w) AS DOUBLE) FROM s WHERE 3 * source_size > level * w), level
  FROM lv WHERE level > last
), t AS (
  SELECT *, least(CAST(3 * source_size AS DOUBLE), (SELECT max(level) FROM lv) * w) AS target FROM s
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), v AS (SELECT *, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS rest FROM u
), g AS (SELECT source, key, doc_id, size, count(*) AS m FROM d GROUP BY ALL
), c AS (SELECT *, sum(size * m) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size) AS upto FROM g)
SELECT c.doc_id, c.size, v.source_size, v.target, CAST(v.whole * c.size + CASE WHEN upto <= rest THEN c.size WHEN upto - c.size * m < rest THEN (rest - (upto - c.size * m)) // m ELSE 0 END AS BIGINT) AS taken
FROM d JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.key = d.key AND c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.size = d.size
JOIN v ON v.source IS NOT DISTINCT FROM d.source
"""


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagetally.llm.resampling import resample

    out = resample(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), percent=10, least=20, seed=2024, longest=1, buckets=10_000)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_FEATURES = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op13_importance_resampling"] = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_FEATURES} AS w FROM documents
), o AS (SELECT k, f, count(*) AS n FROM (SELECT k, unnest(w) AS f FROM d) GROUP BY k, f
), own AS (SELECT f, sum(n) AS n FROM o GROUP BY f
), wanted AS (SELECT f, count(*) AS n FROM (SELECT unnest({_FEATURES}) AS f FROM benchmark) GROUP BY f
), dict AS (SELECT f, {_crc32_sql("f")} % 10000 AS b FROM (SELECT f FROM own UNION SELECT f FROM wanted)
), s AS (SELECT b, sum(n) AS n FROM own JOIN dict USING (f) GROUP BY b
), t AS (SELECT b, sum(n) AS n FROM wanted JOIN dict USING (f) GROUP BY b
), gain AS (
  SELECT b, CAST(floor(1000.0::DOUBLE * ln(((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM own) + 10000)::DOUBLE) / ((s.n::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM wanted) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (b)
), wt AS (SELECT k, sum(n * gain) AS weight FROM o JOIN dict USING (f) JOIN gain USING (b) GROUP BY k
), x AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE AS h FROM d LEFT JOIN wt USING (k)
), y AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x
), z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) FILTER (n_features >= 20) OVER () AS able FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= able * 10 // 100 THEN r END AS rank FROM z
"""
