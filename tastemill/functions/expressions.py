"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def tidy_text(value: Column | str) -> Column:
    return F.lower(F.trim(_col(value)))


def genre_list(value: Column | str) -> Column:
    """Comma string to a sorted array of trimmed lower-case text."""
    return F.array_sort(F.split(tidy_text(value), ","))


def tidy_list(value: Column | str) -> Column:
    """Normalised comma string: lower case, parts sorted."""
    return F.array_join(genre_list(value), ",")


def flag_names(flags: Sequence[str]) -> Column:
    """Names of the 0/1 columns that are 1, lower case, sorted, comma joined."""
    if not flags:
        return F.lit("")
    marks = F.array(*(F.when(F.col(f"`{name}`") == 1, F.lit(name.lower())) for name in flags))
    return F.array_join(F.array_sort(F.array_compact(marks)), ",")


def missing_as_null(value: Column | str) -> Column:
    """NaN plays the part of "missing" in the source files; NULL does here."""
    return F.when(~F.isnan(_col(value)), _col(value))


def quantize(value: Column | str, step: int) -> Column:
    """Floor to a multiple of `step`."""
    return (F.floor(_col(value) / step) * step).cast("int")


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Distance between two arrays of doubles of equal length."""
    squares = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def as_doubles(value: Column | str) -> Column:
    return F.transform(_col(value), lambda x: x.cast("double"))


def steady(value: Column | str, digits: int = 9) -> Column:
    """Round half up. Sums of doubles differ in the last bits with the order of the rows; scores
    that agree to `digits` places become equal, so ties fall to the id and results repeat."""
    scale = float(10**digits)
    return F.floor(_col(value) * scale + 0.5) / scale
