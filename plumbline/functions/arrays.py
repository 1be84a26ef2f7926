"""Arrays as ordered sets, subsequences and coerced arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def find(items: Column, pattern: Column) -> Column:
    """Zero-based place where ``pattern`` first begins within ``items``; -1 if nowhere."""
    n = F.size(pattern)
    places = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)))
    hits = F.filter(places, lambda i: F.slice(items, i, F.greatest(n, F.lit(1))) == pattern)
    return F.coalesce(F.try_element_at(hits, F.lit(1)) - 1, F.lit(-1))


def without_padding(items: Column, pad: Column) -> Column:
    """Without the run of ``pad`` at the end."""
    kept = F.filter(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))), lambda i: F.get(items, i - 1) != pad)
    return F.slice(items, 1, F.coalesce(F.array_max(kept), F.lit(0)))


def clean_strings(items: Column) -> Column:
    """Stripped, non-empty, distinct strings in order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def clamped_int(raw: Column, least: int, most: int, default: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(raw.try_cast("int"), F.lit(default))))


def set_scores(found: Column, gold: Column, empty_is_right: bool) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two arrays as sets.

    With ``empty_is_right`` two empty sets score 1 throughout; without, any
    empty set scores 0.
    """
    a, b = F.size(F.array_distinct(found)), F.size(F.array_distinct(gold))
    hit = F.size(F.array_intersect(found, gold))
    p = F.when(a > 0, hit / a).otherwise(0.0)
    r = F.when(b > 0, hit / b).otherwise(0.0)
    f1 = F.when(a + b > 0, 2.0 * hit / (a + b)).otherwise(0.0)
    if empty_is_right:
        nothing = (a == 0) & (b == 0)
        p, r, f1 = (F.when(nothing, 1.0).otherwise(x) for x in (p, r, f1))
    return p, r, f1
