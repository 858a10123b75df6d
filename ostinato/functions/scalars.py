"""Column expressions that many operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the twelve pitch classes.
PITCH_CLASSES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def round6(x: Column) -> Column:
    return F.round(x, 6)


def mean6(x: Column) -> Column:
    """The mean at six places, from a sum of whole billionths: the same in whatever order the rows come."""
    return F.round(F.sum(F.round(x * 1e9).cast("long")) / F.count(x) / 1e9, 6)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def share(part: Column, whole: Column) -> Column:
    """part / max(1, whole)"""
    return part / F.greatest(F.lit(1), whole)


def ratio_or(x: Column, y: Column, fallback) -> Column:
    """x / y, or ``fallback`` where y isn't over 0."""
    return F.when(y > 0, x / y).otherwise(fallback)


def pitch_class(note: Column) -> Column:
    return F.pmod(note, F.lit(12))


def pitch_class_name(pc: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in PITCH_CLASSES]), pc)


def slug(text: Column) -> Column:
    """Runs of other characters than letters, digits, dot, underscore and dash become one underscore; none at either end."""
    return F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9._-]+", "_"), "^_+|_+$", "")


def number_or(x: Column, fallback: float) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(float(fallback)))


def joined(items: Column, separator: str = " ") -> Column:
    """An array as text, for results that are compared as scalars."""
    return F.array_join(items, separator)


def counts_of(values: Column, n: int) -> list[Column]:
    """How often 0 .. n-1 occur in a column of whole numbers, as aggregates."""
    return [F.count_if(values == i) for i in range(n)]
