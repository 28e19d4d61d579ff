"""Literal cases of the scalars."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagetally.functions import distance, figures, predicates, text


@pytest.fixture(scope="module")
def value(spark):
    def get(column):
        return spark.range(1).select(column.alias("v")).first().v

    return get


@pytest.mark.parametrize(
    "given, want",
    [
        ("(1,234)", [-1234.0]),
        ("(5", [-5.0]),
        ("2023-2024", [2023.0, -2024.0]),
        ("١٬٢٣٤", [1.0, 234.0]),
        ("-0", [0.0]),
        ("1,234.567", [1234.57]),
        ("no", []),
        ("٣٢,٥٤٦ and 0.78", [32546.0, 0.78]),
        ("1.2.3", [1.2, 3.0]),
        ("１,２３４ (５)", [1234.0, -5.0]),
        ("9" * 30, [1e30]),
    ],
)
def test_figures(value, given, want):
    got = value(figures.figures(F.lit(given)))
    assert got == want and all(math.copysign(1, v) == 1 for v in got if v == 0)


def test_digits_and_separators(value):
    assert value(text.number_text(F.lit("ر ١٬٢٣٤٫٥ x(۶)"))) == "1,234.5(6)"
    assert value(text.western_digits(F.lit("٠١٩۰۹"))) == "01909"
    assert value(text.arabic_digits(F.lit("2024"))) == "٢٠٢٤"


def test_normalise(value):
    raw = "<td>ﷲ  إجمالي</td>|**الأصول** ـ ٣   ة ى—–"
    folded = text.normalise(F.lit(raw))
    assert value(folded) == " ".join(unicodedata.normalize("NFKC", "ﷲ  اجمالي الاصول ـ 3 ه ي").split())
    assert value(text.nfkc(F.lit("ﬁ²"))) == "fi2"
    assert value(text.label_key(F.lit("إيراد 1,234 (5)"))) == "ايراد"
    assert value(text.strip_tags(F.lit("<b>a</b>\n b"))) == "a b"


def test_years(value):
    assert value(figures.years(F.lit("12023 2024, ٢٠٢٤ 2009 2030 2010"))) == ["2010", "2024", "٢٠٢٤"]
    assert value(figures.loose_years(F.lit("٢٠٢٥ ١٤٤٥ 2014 2016"))) == [2025, 2016]
    assert value(figures.row_years(F.array(F.lit("2024"), F.lit("(2023)")))) == [2024.0, 2023.0]
    assert value(figures.row_years(F.array(F.lit("2024"), F.lit("17")))) == []
    assert value(figures.row_years(F.array(F.lit("x")))) == []


def test_first_years(value):
    lines = lambda *x: F.array(*map(F.lit, x))
    assert value(figures.first_years(lines("2016", "2020 2019 2018", "2024 2023"))) == [2020, 2019]
    assert value(figures.first_years(lines("x", "2024"))) == [] and value(figures.first_years(lines(*["x"] * 40, "2024 2023"))) == []


def test_predicates(value):
    assert value(predicates.listed(F.lit("a"), ["a"])) and value(predicates.listed(F.lit("a"), [])) and not value(predicates.listed(F.lit("ab"), ["a"]))
    assert value(predicates.listed_in_part(F.lit("xaby"), ["q", "ab"])) and not value(predicates.listed_in_part(F.lit("x"), ["q"]))
    assert [value(predicates.large_value(F.lit(v).cast("double"))) for v in (None, 0.0, 999.0, -1000.0)] == [False, False, False, True]
    assert value(predicates.close_to(F.lit(5.0), F.lit(-5.5), 0.5)) and not value(predicates.close_to(F.lit(-5.0), F.lit(-5.0), 0.5))
    assert [value(predicates.complete(F.lit(t).cast("string"), n)) for t, n in ((None, 0), ("", 0), ("a", 0), ("a" * 100, 100), ("a" * 101, 100))] == [False, False, True, False, True]


def test_medians_and_misreads(value):
    assert value(figures.upper_median(F.array(*map(F.lit, (9, 2, 10, 3))))) == 9
    assert value(figures.upper_median(F.array().cast("array<int>"))) is None
    assert value(figures.middle(F.array(*map(F.lit, (9, 2, 10, 3))))) == 6 and value(figures.middle(F.array(*map(F.lit, (9, 2, 3))))) == 3
    assert value(figures.distinct_figures(F.array(*map(F.lit, (1.0, -1.0, 2.0))))) == 2
    apart = lambda a, b: value(figures.one_digit_apart(F.lit(a), F.lit(b)))
    assert apart("123", "133") and not apart("123", "132") and not apart("12", "123") and not apart("12", "12")


def levenshtein(a, b, substitution=1):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (0 if x == y else substitution)))
    return row[-1]


def test_error_rates(value):
    assert math.isnan(value(distance.cer(F.lit(""), F.lit("x")))) and math.isnan(value(distance.wer(F.lit(" "), F.lit("x"))))
    assert value(distance.cer(F.lit("اصول"), F.lit("اسول"))) == 0.25
    assert value(distance.wer(F.lit("a b c d e f"), F.lit("a x c d f"))) == pytest.approx(2 / 6)


def test_ratios(value):
    rnd = random.Random(1)
    for _ in range(100):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        total = len(a) + len(b)
        want = 100 * (1 - levenshtein(a, b, 2) / total) if total else 100.0
        assert distance.similarity(a, b) == pytest.approx(want)
        short, long = sorted((a, b), key=len)
        sides = [(short, long), (long, short)][: 1 + (len(a) == len(b))]  # of equal lengths either may be the shorter
        windows = [distance.similarity(x, y[max(0, i) : i + len(x)]) for x, y in sides for i in range(1 - len(x), len(y))]
        assert distance.best_window(a, b) == pytest.approx(max(windows) if short else 0.0 if long else 100.0) and distance.best_window(a, b) == distance.best_window(b, a)
    assert distance.best_window("bcxx", "abcd") == distance.best_window("abcd", "bcxx") == pytest.approx(200 / 3)
    assert value(distance.partial_ratio(F.lit("assets"), F.lit("total assets 12"))) == 100.0
    assert value(distance.ratio(F.lit("ab"), F.lit(None).cast("string"))) is None


def test_similarities_of_many_pairs():
    """A batch gets what each pair gets by a plain table of distances."""
    rnd = random.Random(8)
    word = lambda letters, most: "".join(rnd.choice(letters) for _ in range(rnd.randrange(most)))
    pairs = [(word(x, 12), word(x, k)) for x in ("ab", "abcdef", "نص ab", "a😀b") for k in (3, 12, 30) for _ in range(25)] + [(word("ab", 150), word("ab", 300)) for _ in range(2)]
    for (a, b), one, window in zip(pairs, distance.similarities(*zip(*pairs)), distance.best_windows(*zip(*pairs)), strict=True):
        alike = lambda x, y: 100.0 * (1 - levenshtein(x, y, 2) / (len(x) + len(y))) if x or y else 100.0
        assert one == pytest.approx(alike(a, b)) and distance._distance(a, b) == levenshtein(a, b)
        if len(a) + len(b) < 50:
            sides = [(x, y) for x, y in ((a, b), (b, a)) if len(x) <= len(y)]
            assert window == pytest.approx(max(alike(x, y[max(0, i) : i + len(x)]) for x, y in sides for i in range(1 - len(x), len(y))) if a and b else 0.0 if a or b else 100.0)
    assert len(distance.similarities([], [])) == len(distance.best_windows([], [])) == 0



def test_classes(value):
    label = lambda s: (value(text.detector_label(F.lit(s))), value(text.block_label(F.lit(s))))
    assert label("Page-header") == ("header", "header") and label("Section-header") == ("text", "text")
    assert label("Image") == ("picture", "other") and label("paragraph_header") == ("other", "other") and label("page_number") == ("footer", "other")
    assert value(text.page_format(F.lit("Scanned images"))) == "scanned" and value(text.page_format(F.lit(None).cast("string"))) == "text layer"
    assert value(text.entity_name(F.lit("Name — old"), F.lit("اسم"))) == "Name (اسم)" and value(text.entity_name(F.lit("Name"), F.lit("x.pdf"))) == "Name"


def test_lines_and_loops(value):
    assert value(text.lines_of(F.lit("a\n \n \nb"))) == ["a", "b"]
    assert value(text.cut_loops(F.lit("x\n" + "loop\n" * 9 + "y"))) == "x\nloop"
    assert value(text.cut_loops(F.lit("a\na\nb"))) == "a\na\nb"
    assert value(text.names_dollar(F.array(*[F.lit("x")] * 14, F.lit("USD")))) is False


def test_formats(value):
    assert value(text.page_key(F.lit("f"), F.lit(3))) == "f_p03" and value(text.page_key(F.lit("f"), F.lit(3), 3)) == "f_p003"
    assert value(text.percent(F.lit(0.1234))) == "12.3%" and value(text.thousands(F.lit(1234567))) == "1,234,567"
    assert value(text.page_number(F.lit(7))) == "p007" and value(text.document_of(F.lit("aa_FY_p01"))) == "aa"
    ref, sign = text.signed_reference(F.lit("-r12"))
    assert value(ref) == "r12" and value(sign) == -1


def test_only_texts_with_changing_figures_leave_the_jvm(spark, monkeypatch):
    """Composition is given no other text, and the figures are those of composed text."""
    import unicodedata

    from pyspark.sql import functions as F

    from pagetally.functions import text
    from pagetally.functions.figures import figures

    rows = ["über 1,200 für 3", "１２３ und ½", "…5", "（7）", "x²", "٣٤", "é 1.5", None]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        if x is not None and unicodedata.normalize("NFKC", x) == x:
            seen.add(1)
        return None if x is None else unicodedata.normalize("NFKC", x)

    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    want = [r.v for r in spark.createDataFrame([(k, t and unicodedata.normalize("NFKC", t)) for k, t in enumerate(rows)], "k int, t string").select("k", figures(F.col("t"), compose=False).alias("v")).orderBy("k").collect()]
    monkeypatch.setattr(text, "_nfkc", counted)
    got = [r.v for r in df.select("k", figures(F.col("t")).alias("v")).orderBy("k").collect()]
    assert got == want and seen.value == 0
