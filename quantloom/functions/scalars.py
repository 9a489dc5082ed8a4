"""Column functions: no shuffle, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def invert(x: Column) -> Column:
    """1/x, null where |x| <= 1e-8."""
    return F.when(F.abs(x) > 1e-8, 1 / x)


def log_pos(x: Column) -> Column:
    """ln x, null where x <= 0."""
    return F.when(x > 0, F.ln(x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a/b, null where b is 0 (ANSI mode would raise)."""
    return a / F.nullif(b, F.lit(0.0))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate, null where a side is constant (the built-in one raises in ANSI mode)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body reads it inside lambdas."""
    return F.transform(F.array(value), body)[0]
