"""Text scalars: Column in, Column out. All are built-in expressions but ``nfkc``."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digit scripts and Arabic separators.
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"
PERSIAN = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
THOUSANDS, DECIMAL = "٬", "٫"


def western_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_INDIC + PERSIAN, ASCII_DIGITS * 2)


def arabic_digits(c: Column) -> Column:
    return F.translate(c, ASCII_DIGITS, ARABIC_INDIC)


def number_text(c: Column) -> Column:
    """Digits and separators in ASCII, everything but digits, points, commas and parentheses dropped."""
    ascii_text = F.translate(c, ARABIC_INDIC + PERSIAN + THOUSANDS + DECIMAL, ASCII_DIGITS * 2 + ",.")
    return F.regexp_replace(ascii_text, r"[^0-9.,()]", "")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column, changing: str = r"[^\x00-\x7F]") -> Column:
    """Compatibility composition of text that holds a character of the class ``changing``; other text stays in the JVM: a function
    under a condition is given all rows, so those that it is not for are null."""
    held = c.rlike(changing)
    return F.when(held, _nfkc(F.when(held, c))).otherwise(c)


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"(?U)\s+", " "))


def _folded(c: Column) -> Column:
    """What follows compatibility composition in normalisation."""
    c = F.regexp_replace(western_digits(c), r"<[^>]+>", " ")
    c = F.regexp_replace(c, r"[|*_#`\-—–]", " ")
    c = F.translate(c, "إأآىة", "ااايه")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise(c: Column, compose: bool = True) -> Column:
    """Comparison form: composed, western digits, no tags or markup, letter variants folded, single blanks.
    ``compose=False`` leaves composition out, for text that is known to be composed."""
    return _folded(nfkc(c) if compose else c)


def label_key(c: Column) -> Column:
    """A row label without its figures and their punctuation."""
    return normalise(F.regexp_replace(western_digits(c), r"[\d,.()\-|]+", " "), compose=False)


_DIGITS = str.maketrans(ARABIC_INDIC + PERSIAN, ASCII_DIGITS * 2)
_LETTERS = str.maketrans("إأآىة", "ااايه")
_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def key_of(label: str) -> str:
    """``label_key`` of one label, for functions that look at each different label once."""
    t = re.sub(r"[0-9,.()\-|]+", " ", label.translate(_DIGITS))
    t = re.sub(r"[|*_#`\-—–]", " ", re.sub(r"<[^>]+>", " ", t))
    return _BLANK.sub(" ", t.translate(_LETTERS)).strip(" ")


def entity_name(name: Column, arabic: Column) -> Column:
    """The name before a dash, with the Arabic file name behind it unless that is a PDF's."""
    short = F.regexp_replace(name, r" — .*", "")
    return F.when(arabic.isNotNull() & ~F.endswith(arabic, F.lit(".pdf")), F.concat(short, F.lit(" ("), arabic, F.lit(")"))).otherwise(short)


def decode(c: Column, names: dict[str, str]) -> Column:
    """An enumeration's names; null where there is none."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.try_element_at(table, c)


def first_of(c: Column, needles: list[tuple[str, str]], default: str) -> Column:
    """The class of the first needle that the lower-cased text contains."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return _first([(F.contains(low, F.lit(needle)), name) for needle, name in needles], default)


def page_format(c: Column) -> Column:
    return first_of(c, [("scanned", "scanned"), ("images", "images")], "text layer")


# Words in the class names of layout detectors, and in those of stored blocks.
PICTURE_WORDS = ["picture", "figure", "image", "seal", "chart", "signature"]
TEXT_WORDS = ["text", "title", "section", "caption", "list", "footnote", "formula", "abstract", "content", "reference"]
FOOTER_NAMES = ["number", "page_number", "pagefooter"]
TEXT_BLOCKS = ["Text", "Section-header", "Caption", "List-item", "Footnote", "Title"]


def detector_label(c: Column) -> Column:
    """One of six layout classes for a detector's class name; the first that fits."""
    low = F.lower(c)
    has = lambda words: low.rlike("|".join(words))
    page_header = has(["header"]) & ~has(["section", "paragraph"])
    page_footer = has(["footer"]) | low.isin(FOOTER_NAMES)
    ordered = [(has(["table"]), "table"), (page_header, "header"), (page_footer, "footer"), (has(PICTURE_WORDS), "picture"), (has(TEXT_WORDS), "text")]
    return _first(ordered, "other")


def block_label(c: Column) -> Column:
    """The same classes for a stored block's category, whose spelling is fixed; these rules differ."""
    low = F.lower(c)
    ordered = [(F.contains(low, F.lit(part)), name) for part, name in (("table", "table"), ("page-header", "header"), ("page-footer", "footer"), ("picture", "picture"))]
    return _first([*ordered, (c.isin(TEXT_BLOCKS), "text")], "other")


def _first(ordered: list[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for test, name in reversed(ordered):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def lines_of(c: Column) -> Column:
    """Non-blank lines, in order."""
    return F.filter(F.split(c, "\n"), lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")) != "")


def names_dollar(lines: Column, first: int = 14) -> Column:
    """Whether one of the first lines names the second currency."""
    return F.exists(F.slice(lines, 1, first), lambda s: s.rlike("دولار|USD"))


def cut_loops(c: Column, times: int = 8) -> Column:
    """The text up to where one line begins to repeat ``times`` times in a row; the first of them is kept.
    The rule is this library's own: stored outputs of generative readers can end in such loops."""
    lines = F.split(c, "\n")
    n = F.size(lines)
    looping = lambda i: F.forall(F.sequence(F.lit(1), F.lit(times - 1)), lambda k: F.get(lines, i + k).eqNullSafe(F.get(lines, i)))
    at = F.filter(F.when(n >= times, F.sequence(F.lit(0), n - times)).otherwise(F.array().cast("array<int>")), lambda i: (F.get(lines, i) != "") & looping(i))
    return F.when(F.size(at) > 0, F.array_join(F.slice(lines, 1, F.get(at, 0) + 1), "\n")).otherwise(c)


def signed_reference(c: Column) -> tuple[Column, Column]:
    """(row id, +1 or -1) of a component; a leading minus subtracts."""
    return F.regexp_replace(c, r"^-+", ""), F.when(F.startswith(c, F.lit("-")), -1).otherwise(1)


def page_key(filing: Column, page: Column, digits: int = 2) -> Column:
    return F.format_string(f"%s_p%0{digits}d", filing, page)


def thousands(c: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(c, 0)


def document_of(page: Column) -> Column:
    """The document's key: what stands before the first underscore of a page's name."""
    return F.split_part(page, F.lit("_"), F.lit(1))


def page_number(page: Column) -> Column:
    """A page's name by number alone, three digits."""
    return F.format_string("p%03d", page)


def percent(c: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", c.cast("double") * 100)
