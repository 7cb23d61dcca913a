"""Column expressions that the operators share. All are built-ins, and safe under ANSI mode."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
#: Date formats tried after the ISO forms, in order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd")
PERIODS = ("daily", "weekly", "monthly", "quarterly", "yearly")


def normalize_name(name: str) -> str:
    """A column name in lower case with runs of other characters as one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def finite(c: Column) -> Column:
    """NaN and infinities as null, for columns of floating point."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as double, null where ``b`` is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def to_number(c: Column) -> Column:
    """A string as double, null unless the whole string is a number."""
    s = c.cast("string")
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def to_time(c: Column) -> Column:
    """A string as timestamp: ISO forms, then the listed formats; null for all else."""
    s = F.trim(c.cast("string"))
    return F.coalesce(F.try_to_timestamp(s), *(F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS))


def clean_number(c: Column) -> Column:
    """The number in a decorated string: percent signs dropped, ``(5)`` as ``-5``, currency signs, commas, blanks and
    letters at either end dropped. ``50%`` is 50."""
    s = F.regexp_replace(c.cast("string"), "%", "")
    s = F.when(s.rlike(r"^\s*\(.+\)\s*$"), F.concat(F.lit("-"), F.regexp_replace(s, r"[()\s]", ""))).otherwise(s)
    s = F.regexp_replace(s, r"[$€£¥₹₩₫¢,\s]", "")
    return to_number(F.regexp_replace(F.regexp_replace(s, "[A-Za-z]+$", ""), "^[A-Za-z]+", ""))


def clean_number_late(c: Column) -> Column:
    """As ``clean_number``, with brackets looked at after the other signs are gone."""
    s = F.regexp_replace(c.cast("string"), r"[$€£¥₹₩₫¢,%\s]", "")
    s = F.when(s.rlike(r"^\(.+\)$"), F.concat(F.lit("-"), F.regexp_replace(s, "[()]", ""))).otherwise(s)
    return to_number(F.regexp_replace(F.regexp_replace(s, "[A-Za-z]+$", ""), "^[A-Za-z]+", ""))


def plain_number(c: Column) -> Column:
    """The number in a string less commas, dollar and percent signs."""
    return to_number(F.translate(F.trim(c.cast("string")), ",$%", ""))


def period(c: Column, every: str) -> Column:
    """The calendar label of a time: 2024-01-07, 2024-01-01/2024-01-07 (Monday to Sunday), 2024-01, 2024Q1 or 2024."""
    monday = F.to_date(F.date_trunc("week", c))
    labels = {
        "daily": F.date_format(c, "yyyy-MM-dd"),
        "weekly": F.concat_ws("/", F.date_format(monday, "yyyy-MM-dd"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd")),
        "monthly": F.date_format(c, "yyyy-MM"),
        "quarterly": F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string")),
        "yearly": F.year(c).cast("string"),
    }
    return labels[every]


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; null for a constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def skew(c: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant, null below three values."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.when(F.stddev_pop(c) == 0, 0.0).otherwise(F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))))


def kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant, null below four values."""
    n = F.count(c).cast("double")
    value = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n >= 4, F.when(F.stddev_pop(c) == 0, 0.0).otherwise(value))


def quantile(c: Column, *at: float) -> Column:
    """Exact quantiles with linear interpolation."""
    return F.percentile(c, at[0]) if len(at) == 1 else F.percentile(c, F.array(*(F.lit(a) for a in at)))


def approx_quantile(c: Column, *at: float) -> Column:
    """Quantiles from a bounded sketch, for columns that one task cannot count value by value."""
    return F.percentile_approx(c, at[0] if len(at) == 1 else list(at), 10_000)


def clip(c: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """``c`` within bounds; a null bound is none, and null stays null."""
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def tokens(c: Column) -> Column:
    """How many words a string has, cut at white space."""
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))


def any_of(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether a string has any of the words as a part."""
    return functools.reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def format_number(v: float | int | None) -> str:
    """A number for people: a dash for none, no decimals for whole numbers, two for others."""
    if v is None or v != v:
        return "-"
    return f"{v:,.0f}" if float(v).is_integer() and abs(v) < 1e6 else f"{v:,.2f}"
