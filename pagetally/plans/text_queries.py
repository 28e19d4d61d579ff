"""Queries of the text and number scalars, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetally.functions import distance, figures, text
from pagetally.plans.registry import query
from pagetally.tables import table

# SQL pieces that several oracles share.
WEST = "translate({0}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"
NUMBERS = (
    "list_filter(list_transform(regexp_extract_all(" + WEST + ", '-?\\(?[0-9][0-9,]*\\.?[0-9]*\\)?'), lambda s: "
    "CASE WHEN (starts_with(s, '(') OR starts_with(s, '-')) AND {V} <> 0 THEN -{V} ELSE {V} END), lambda v: v IS NOT NULL)"
)
# Figures of 1e15 and more have no places behind the point.
CAST = "TRY_CAST(regexp_replace(s, '[(),\\-]', '', 'g') AS DOUBLE)"
NUMBERS = NUMBERS.replace("{V}", f"(CASE WHEN abs({CAST}) >= 1e15 THEN {CAST} ELSE round({CAST}, 2) END)")
LINES = "list_filter(string_split({0}, chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g')) <> '')"


@query("SELECT doc_id, md5(translate(text, '0123456789', '٠١٢٣٤٥٦٧٨٩')) AS arabic, md5(text) AS back, md5(text) AS persian FROM documents")
def b01_b16_digit_scripts(spark, sf):
    arabic = text.arabic_digits(F.col("text"))
    persian = F.translate("text", text.ASCII_DIGITS, text.PERSIAN)
    return table(spark, sf, "documents").select("doc_id", F.md5(arabic).alias("arabic"), F.md5(text.western_digits(arabic)).alias("back"), F.md5(text.western_digits(persian)).alias("persian"))


@query("SELECT doc_id, regexp_replace(translate(text, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٬٫', '01234567890123456789,.'), '[^0-9.,()]', '', 'g') AS bare FROM documents")
def b02_number_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.number_text(F.col("text")).alias("bare"))


@query()
def b03_nfkc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.nfkc(F.col("text"))).alias("composed"))


@query(
    "SELECT page_id, md5(trim(regexp_replace(translate(regexp_replace(regexp_replace(" + WEST.format("html") + ", '<[^>]+>', ' ', 'g'), '[|*_#`—–-]', ' ', 'g'), 'إأآىة', 'ااايه'), '\\s+', ' ', 'g'))) AS normal FROM pages"
)
def b04_normalise(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.normalise(F.col("html"))).alias("normal"))


@query("SELECT doc_id, CAST(len(v) AS BIGINT) AS n, list_max(v) AS largest, CAST(len(list_filter(v, lambda x: x < 0)) AS BIGINT) AS negative FROM (SELECT doc_id, " + NUMBERS.format("text") + " AS v FROM documents)")
def b05_figures(spark, sf):
    v = figures.figures(F.col("text"))
    df = table(spark, sf, "documents").select("doc_id", v.alias("v"))
    return df.select("doc_id", F.size("v").cast("bigint").alias("n"), F.array_max("v").alias("largest"), F.size(F.filter("v", lambda x: x < 0)).cast("bigint").alias("negative"))


@query(
    "SELECT doc_id, CAST(len(list_filter(v, lambda x: abs(x) >= 1000 OR x <> floor(x))) AS BIGINT) AS financial, CAST(len(list_filter(v, lambda x: abs(x) >= 1000)) AS BIGINT) AS large FROM (SELECT doc_id, " + NUMBERS.format("text") + " AS v FROM documents)"
)
def b06_financial(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", figures.figures(F.col("text")).alias("v"))
    return df.select("doc_id", F.size(figures.financial(F.col("v"))).cast("bigint").alias("financial"), F.size(figures.financial(F.col("v"), fractions=False)).cast("bigint").alias("large"))


@query("SELECT p_partkey, CASE WHEN length(p_name) = 0 THEN CAST('nan' AS DOUBLE) ELSE levenshtein(p_name, p_type) / length(p_name) END AS cer FROM part")
def b07_character_error_rate(spark, sf):
    return table(spark, sf, "part").select("p_partkey", distance.cer(F.col("p_name"), F.col("p_type")).alias("cer"))


@query(
    """WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS r, string_split(p_type || ' ' || p_name || ' ' || p_brand, ' ') AS h FROM part),
    v AS (SELECT *, list_sort(list_distinct(list_concat(r, h))) AS voc FROM w)
    SELECT p_partkey, levenshtein(array_to_string([chr(CAST(64 + list_position(voc, x) AS INTEGER)) FOR x IN r], ''), array_to_string([chr(CAST(64 + list_position(voc, x) AS INTEGER)) FOR x IN h], '')) / len(r) AS wer FROM v"""
)
def b08_word_error_rate(spark, sf):
    r, h = F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_name", "p_brand")
    return table(spark, sf, "part").select("p_partkey", distance.wer(r, h).alias("wer"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[0-9٠-٩]+'), lambda s: regexp_full_match(s, '20[12][0-9]|٢٠[١٢][٠-٩]')))), ',') AS years FROM documents")
def b09_years(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(figures.years(F.col("text")), ",").alias("years"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(regexp_extract_all(text, '[0-9٠-٩]+'), lambda s: regexp_full_match(s, '20[12][0-9]|[٠-٩]{4}')), lambda s: CAST(" + WEST.format("s") + " AS INTEGER)), lambda y: y BETWEEN 2015 AND 2030), ',') AS years FROM documents")
def b10_loose_years(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(figures.loose_years(F.col("text")), ",").alias("years"))


@query(
    "WITH n AS (SELECT o_orderkey, [CAST(floor(o_totalprice) AS INTEGER) % 40 + 2000, CAST(o_orderkey AS INTEGER) % 40 + 2000] AS v FROM orders) SELECT o_orderkey, CASE WHEN len(list_filter(v, lambda x: x NOT BETWEEN 2015 AND 2030)) = 0 THEN array_to_string(v, ',') ELSE '' END AS years FROM n"
)
def b11_row_years(spark, sf):
    cells = F.array((F.floor("o_totalprice").cast("int") % 40 + 2000).cast("string"), (F.col("o_orderkey").cast("int") % 40 + 2000).cast("string"))
    years = F.transform(figures.row_years(cells), lambda y: y.cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(years, ",").alias("years"))


@query()
def b12_b13_fuzzy_ratios(spark, sf):
    pairs = table(spark, sf, "part").select("p_name", "p_type").distinct()
    return pairs.select("p_name", "p_type", distance.ratio(F.col("p_name"), F.col("p_type")).alias("ratio"), distance.partial_ratio(F.col("p_name"), F.col("p_type")).alias("partial"))


@query("SELECT page_id, md5(trim(regexp_replace(translate(regexp_replace(" + WEST.format("html") + ", '[0-9,.()|-]+', ' ', 'g'), 'إأآىة', 'ااايه'), '\\s+', ' ', 'g'))) AS label FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[|*_#`—–-]', ' ', 'g') AS html FROM pages)")
def b14_label_key(spark, sf):
    plain = F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"[|*_#`\-—–]", " ")
    return table(spark, sf, "pages").select("page_id", F.md5(text.label_key(plain)).alias("label"))


@query("WITH d AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS a, CAST(p_partkey + 10 AS VARCHAR) AS b FROM part) SELECT p_partkey, length(a) = length(b) AND len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1 AS misread FROM d")
def b15_one_digit_apart(spark, sf):
    a, b = F.col("p_partkey").cast("string"), (F.col("p_partkey") + 10).cast("string")
    return table(spark, sf, "part").select("p_partkey", figures.one_digit_apart(a, b).alias("misread"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS plain FROM pages")
def b17_strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("plain"))


@query(
    """SELECT p_partkey, p_brand || CASE WHEN p_type IS NOT NULL AND NOT ends_with(p_type, '.pdf') THEN ' (' || p_type || ')' ELSE '' END AS entity,
    CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS decoded,
    CASE WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'small') THEN 'small' ELSE 'other' END AS first_match FROM part"""
)
def b18_b20_names_and_classes(spark, sf):
    entity = text.entity_name(F.concat("p_brand", F.lit(" — x")), F.col("p_type"))
    size = F.when(F.col("p_size") == 1, "1").when(F.col("p_size") == 2, "2").otherwise("0")
    return table(spark, sf, "part").select("p_partkey", entity.alias("entity"), text.decode(size, {"1": "one", "2": "two"}).alias("decoded"), text.first_of(F.col("p_type"), [("steel", "steel"), ("small", "small")], "other").alias("first_match"))


@query(
    """WITH l(l) AS (VALUES ('Table'), ('Page-header'), ('Section-header'), ('Page-footer'), ('Picture'), ('Footnote'), ('Image'), ('number'), ('paragraph_header'), ('Formula'), ('Stamp'))
    SELECT e.event_id, l, CASE WHEN l = 'Table' THEN 'table' WHEN l = 'Page-header' THEN 'header' WHEN l IN ('Page-footer', 'number') THEN 'footer' WHEN l IN ('Picture', 'Image') THEN 'picture' WHEN l IN ('Section-header', 'Footnote', 'Formula') THEN 'text' ELSE 'other' END AS detector,
    CASE WHEN l = 'Table' THEN 'table' WHEN l = 'Page-header' THEN 'header' WHEN l = 'Page-footer' THEN 'footer' WHEN l = 'Picture' THEN 'picture' WHEN l IN ('Section-header', 'Footnote') THEN 'text' ELSE 'other' END AS block
    FROM events e JOIN l ON true"""
)
def b21_layout_labels(spark, sf):
    labels = ["Table", "Page-header", "Section-header", "Page-footer", "Picture", "Footnote", "Image", "number", "paragraph_header", "Formula", "Stamp"]
    df = table(spark, sf, "events").select("event_id", F.explode(F.array(*map(F.lit, labels))).alias("l"))
    return df.select("event_id", "l", text.detector_label(F.col("l")).alias("detector"), text.block_label(F.col("l")).alias("block"))


@query("SELECT doc_id, len(list_filter((" + LINES.format("text") + ")[1:14], lambda s: contains(s, 'USD') OR contains(s, 'دولار'))) > 0 AS dollar FROM documents")
def b22_second_currency(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.names_dollar(text.lines_of(F.col("text"))).alias("dollar"))


@query(
    """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
    c AS (SELECT *, list_min(list_filter(range(0, greatest(len(l) - 2, 0)), lambda i: l[i + 1] <> '' AND len(list_distinct(l[i + 1 : i + 3])) = 1)) AS pos FROM l)
    SELECT doc_id, md5(CASE WHEN pos IS NULL THEN text ELSE array_to_string(l[1 : pos + 1], chr(10)) END) AS cut FROM c"""
)
def b23_cut_loops(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.cut_loops(F.col("text"), times=3)).alias("cut"))


@query(
    """SELECT l_orderkey, l_linenumber, 'r' || l_linenumber AS ref, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS sign, printf('%s_p%02d', 'f' || l_orderkey, l_linenumber) AS page, printf('p%03d', l_linenumber) AS long_page, printf('%.1f%%', l_discount * 100) AS pct, format('{:,}', CAST(l_partkey AS BIGINT) * 1000) AS thousands FROM lineitem"""
)
def b24_b26_references_and_formats(spark, sf):
    raw = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "-r").otherwise("r"), F.col("l_linenumber"))
    ref, sign = text.signed_reference(raw)
    page = text.page_key(F.concat(F.lit("f"), F.col("l_orderkey")), F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ref.alias("ref"), sign.alias("sign"), page.alias("page"), text.page_number(F.col("l_linenumber")).alias("long_page"), text.percent(F.col("l_discount")).alias("pct"), text.thousands(F.col("l_partkey").cast("bigint") * 1000).alias("thousands"))


@query(
    """WITH y AS (SELECT doc_id, list_transform((""" + LINES.format("text") + """)[1:40], lambda l: list_filter(list_transform(list_filter(regexp_extract_all(l, '[0-9٠-٩]+'), lambda s: regexp_full_match(s, '20[12][0-9]|[٠-٩]{4}')), lambda s: CAST(""" + WEST.format("s") + """ AS INTEGER)), lambda y: y BETWEEN 2015 AND 2030)) AS ys FROM documents)
    SELECT doc_id, coalesce(array_to_string((list_filter(ys, lambda y: len(y) >= 2)[1])[1:2], ','), '') AS years FROM y"""
)
def f09_f10_first_years(spark, sf):
    """The years of the first of a text's first 40 lines that has two."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(figures.first_years(text.lines_of(F.col("text"))), ",").alias("years"))
