"""Null-safe arithmetic, coercion and scoring maths as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column, to: str = "double") -> Column:
    """Coercing cast: bad text and NaN become null."""
    if to in ("double", "float"):
        v = c.try_cast(to)
        return F.when(F.isnan(v), None).otherwise(v)
    return c.try_cast(to)


def finite_or_zero(c: Column) -> Column:
    d = c.cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(d)


def loose_bool(c: Column) -> Column:
    """True for true/1/yes in any case; null is false."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes"), F.lit(False))


def safe_rate(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is 0 or either side is missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def shrink(n: Column, k: float) -> Column:
    return n / (n + F.lit(float(k)))


def flag(c: Column) -> Column:
    """Boolean to 0/1, null to 0."""
    return F.coalesce(c.cast("int"), F.lit(0))


def true(c: Column) -> Column:
    """Boolean with null read as false."""
    return F.coalesce(c, F.lit(False))


def erf(x: Column) -> Column:
    """Error function to about 1e-15.

    Up to |x| = 3 the series 2x/sqrt(pi) e^(-x^2) sum (2x^2)^n / (2n+1)!! in nested
    form; beyond it the continued fraction of erfc. Both are folds over a term index, so
    the expression stays small.
    """
    a, sq = F.abs(x), x * x
    series = F.aggregate(
        F.sequence(F.lit(70), F.lit(1), F.lit(-1)), F.lit(1.0),
        lambda s, n: F.lit(1.0) + sq * F.lit(2.0) / (F.lit(2.0) * n + F.lit(1.0)) * s,
    )
    near = F.lit(2.0 / math.sqrt(math.pi)) * a * F.exp(-sq) * series
    fraction = F.aggregate(
        F.sequence(F.lit(40), F.lit(1), F.lit(-1)), a, lambda f, n: a + n / F.lit(2.0) / f
    )
    far = F.lit(1.0) - F.exp(-sq) / (F.lit(math.sqrt(math.pi)) * fraction)
    return F.signum(x) * F.when(a <= 3.0, near).otherwise(far)


def normal_cdf(x: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(x / F.lit(math.sqrt(2.0))))


def squash(x: Column, scale: float) -> Column:
    return F.lit(scale) * F.tanh(x / F.lit(scale))


def with_missing(df: DataFrame, columns: dict[str, str], default=None) -> DataFrame:
    """Add each absent column (name -> type) holding ``default``."""
    return df.withColumns(
        {c: F.lit(default).cast(t) for c, t in columns.items() if c not in df.columns}
    ) if any(c not in df.columns for c in columns) else df


def zero_filled(df: DataFrame, columns: list[str], to: str = "double") -> DataFrame:
    """Coerce to a number, null to 0, adding absent columns."""
    df = with_missing(df, {c: to for c in columns})
    return df.withColumns({c: F.coalesce(number(F.col(c), to), F.lit(0).cast(to)) for c in columns})
