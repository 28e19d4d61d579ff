"""Conditions on pages, cells and outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(name: Column, names: Sequence[str]) -> Column:
    """One of the names asked for; without names, every one."""
    return name.isin(list(names)) if names else F.lit(True)


def listed_in_part(name: Column, parts: Sequence[str]) -> Column:
    """Holds one of the parts asked for; without parts, every one does."""
    tests = [F.contains(name, F.lit(p)) for p in parts]
    out = tests[0] if tests else F.lit(True)
    for t in tests[1:]:
        out = out | t
    return out


def large_value(value: Column, least: float = 1000) -> Column:
    """A cell's value is there, not zero, and at least so large in amount."""
    return (F.coalesce(value, F.lit(0.0)) != 0) & F.coalesce(F.abs(value) >= least, F.lit(False))


def close_to(a: Column, b: Column, tolerance: float) -> Column:
    """a lies within the tolerance of the amount of b."""
    return F.abs(a - F.abs(b)) <= tolerance


def complete(text: Column, more_than: int = 0) -> Column:
    """An output is there and longer than so many characters."""
    return F.coalesce(F.length(text) > more_than, F.lit(False))
