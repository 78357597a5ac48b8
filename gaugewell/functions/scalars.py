"""Column functions: nulls mean missing everywhere and NaN never leaves a source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Untrimmed texts that a raw file uses for missing values, and tags that say nothing (fixed values).
NULL_TOKENS = ["", "NA", "N/A", "None", "null", "NULL", "nan", "NaN", "n/a", "<NA>"]
EMPTY_TAGS = ["", "nan", "none", "null", "na", "n/a", "unknown"]
BANDS = [(10.0, "Very Low (<10)"), (30.0, "Low (10-30)"), (70.0, "Medium (30-70)"), (None, "High (>70)")]

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def null_tokens(c: Column) -> Column:
    return F.when(~c.isin(NULL_TOKENS), c)


def clean_text(c: Column) -> Column:
    """White space trimmed on both ends; an empty text, ``nan`` and ``None`` are missing."""
    t = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.when(~t.isin("", "nan", "None"), t)


def numeric(c: Column) -> Column:
    """A double, or null if the text isn't a plain decimal number."""
    return F.when(c.cast("string").rlike(_NUMBER), F.trim(c.cast("string")).try_cast("double"))


def not_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def non_negative(c: Column) -> Column:
    return F.when(c >= 0, c)


def outside(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """True where a value is out of range, false where it is missing."""
    return F.coalesce((c < low) | (c > high), F.lit(False))


def within(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(c.between(low, high), c)


def span(start: Column, end: Column, unit: float = 1.0) -> Column:
    """end - start in ``unit`` seconds; missing if either is or the end comes first."""
    return F.when(end >= start, (end - start) / unit)


def safe_log1p(c: Column) -> Column:
    return F.when(c >= 0, F.log1p(c))


def safe_ratio(n: Column, d: Column) -> Column:
    return F.try_divide(n, d)


def exact_mean(c: Column) -> Column:
    """The mean of a group as the same double for every order of its rows: a sum of doubles depends on that in its last
    bits, so equal groups would not tie. Whole numbers, multiples of 2^-26 and of 2^-54 are added apart, each without
    rounding while the whole numbers stay under 2^53 and the rows under 2^26; beyond that it is a plain mean."""
    whole = F.rint(c)
    rest = F.when(F.abs(c) < float(1 << 52), c - whole).otherwise(0.0)  # also for infinite values
    upper = F.rint(rest * float(1 << 26)) / float(1 << 26)
    lower = F.rint((rest - upper) * float(1 << 54)) / float(1 << 54)
    return F.try_divide(F.sum(whole) + (F.sum(upper) + F.sum(lower)), F.count(c))


def clip(c: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Null stays null, though least and greatest skip nulls."""
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), out)


def coverage_ratio(part: Column, whole: Column) -> Column:
    """part / whole, at most 1; 0 where there is no whole or no part."""
    return F.when((whole > 0) & part.isNotNull(), F.least(F.lit(1.0), part / whole)).otherwise(0.0)


def flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0)) > 0, 1).otherwise(0)


def band(c: Column, bands=BANDS) -> Column:
    """Label of the right-closed band that holds the value."""
    out = None
    for high, label in bands:
        hit = c.isNotNull() if high is None else c <= high
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def skew_class(c: Column) -> Column:
    return F.when(F.abs(c) < 0.5, "approximately symmetric").when(F.abs(c) <= 1.0, "moderately skewed").when(c.isNotNull(), "highly skewed")


def tag(c: Column) -> Column:
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(~F.lower(t).isin(EMPTY_TAGS), t)


def cluster_name(c: Column) -> Column:
    return F.when(c == -1, "NOISE").otherwise(F.concat(F.lit("CLUSTER_"), c.cast("string")))


def stratum(*columns: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("NA")) for c in columns])


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
