"""Figures in text: arrays of doubles as Columns."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetally.functions.text import ARABIC_INDIC, ASCII_DIGITS, PERSIAN, nfkc, western_digits

# What counts as a number, a year token (2010-2029), and a loose one.
NUMBER = r"-?\(?\d[\d,]*\.?\d*\)?"
YEAR = r"(?<![\d٠-٩])(?:20[12]\d|٢٠[١٢][٠-٩])(?![\d٠-٩])"
LOOSE_YEAR = r"(?<![\d٠-٩])(?:20[12]\d|[٠-٩]{4})(?![\d٠-٩])"


@cache
def composed_into_figures() -> str:
    """A class of the characters whose compatibility composition may hold a character of a number: those below U+2000 that do, and
    all from there on (few ranges, as every character is held against them). Text without them has the same numbers before
    composition: what else it changes is no part of a number either way."""
    part = set(ASCII_DIGITS + ARABIC_INDIC + PERSIAN + "(),.-")
    found = [c for c in range(0x80, 0x2000) if chr(c) not in part and part & set(unicodedata.normalize("NFKC", chr(c)))]
    return "[" + "".join(f"\\x{{{c:X}}}" for c in found) + r"\x{2000}-\x{10FFFF}]"


def parse_figure(s: Column) -> Column:
    """A matched number's value to two places; negative if it begins with a parenthesis or a minus."""
    value = F.round(F.translate(s, "(),-", "").try_cast("double"), 2)
    negative = s.startswith("(") | s.startswith("-")
    return F.when(negative & (value != 0), -value).otherwise(value)


def figures(c: Column, compose: bool = True) -> Column:
    """All numbers of a text, in order, with repeats. Compatibility forms (full-width digits) count as what they
    stand for; ``compose=False`` is for text that is known to be composed."""
    composed = nfkc(c, composed_into_figures()) if compose else c
    found = F.transform(F.regexp_extract_all(western_digits(composed), F.lit(NUMBER), F.lit(0)), parse_figure)
    return F.filter(found, lambda v: v.isNotNull())


def financial(values: Column, fractions: bool = True) -> Column:
    """Values of at least a thousand; with ``fractions`` also those that are not whole."""
    big = lambda v: F.abs(v) >= 1000
    return F.filter(values, (lambda v: big(v) | (v != F.floor(v))) if fractions else big)


def years(c: Column) -> Column:
    """Distinct year tokens (2010-2029, in either script, as written), sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(YEAR), F.lit(0))))


def loose_years(c: Column) -> Column:
    """Years 2015-2030 in order of appearance; any four Arabic-Indic digits are looked at."""
    found = F.transform(F.regexp_extract_all(c, F.lit(LOOSE_YEAR), F.lit(0)), lambda s: western_digits(s).cast("int"))
    return F.filter(found, lambda y: y.between(2015, 2030))


def loose_years_of(text: str) -> list[int]:
    """``loose_years`` of one text."""
    return [y for y in map(int, re.findall(LOOSE_YEAR, text, re.ASCII)) if 2015 <= y <= 2030]


def row_years(cells: Column) -> Column:
    """A row's years if all its numbers are years, else none. Cells are composed text."""
    values = F.flatten(F.transform(cells, lambda c: figures(c, compose=False)))
    is_years = (F.size(values) > 0) & F.forall(values, lambda v: F.abs(v).between(2015, 2030))
    return F.when(is_years, F.transform(values, F.abs)).otherwise(F.array().cast("array<double>"))


def one_digit_apart(a: Column, b: Column) -> Column:
    """Equal length, exactly one position differs."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return (F.length(a) == F.length(b)) & (F.size(F.filter(pairs, lambda d: d)) == 1)


def first_years(lines: Column, most: int = 40) -> Column:
    """The first two years of the first line, of so many, that has two valid years or more; else none."""
    in_lines = F.filter(F.transform(F.slice(lines, 1, most), loose_years), lambda y: F.size(y) >= 2)
    return F.slice(F.coalesce(F.get(in_lines, 0), F.array().cast("array<int>")), 1, 2)


def distinct_figures(values: Column) -> Column:
    """How many different absolute values there are."""
    return F.size(F.array_distinct(F.transform(values, F.abs)))


def middle(values: Column) -> Column:
    """The median: the mean of the two middle values of an even number."""
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def upper_median(values: Column) -> Column:
    """The middle value, the upper one of two; null for an empty array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))
