"""Expressions shared by the operators.

Missing is NULL, never NaN. A comparison with missing counts as false, a
division by zero gives NULL, and a rolling value needs a full frame of
non-missing rows. Rows of a series are ordered by (timestamp, seq).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "series_key"
ORDER = ("timestamp", "seq")


def series_window() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(F.col(ORDER[0]).asc_nulls_last(), F.col(ORDER[1]).asc_nulls_last())


def rows(first: int, last: int = 0) -> WindowSpec:
    return series_window().rowsBetween(first, last)


def so_far() -> WindowSpec:
    return series_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def roll(agg: Callable[[Column], Column], c: Column | str, n: int) -> Column:
    """Aggregate of the last n rows, NULL unless all of them have a value."""
    c, w = F.col(c) if isinstance(c, str) else c, rows(1 - n)
    return F.when(F.count(c).over(w) >= n, agg(c).over(w))


def lag(c: Column | str, k: int = 1) -> Column:
    return F.lag(c, k).over(series_window())


def lead(c: Column | str, k: int = 1) -> Column:
    return F.lead(c, k).over(series_window())


def change(c: str, k: int = 1) -> Column:
    """Relative change against the row k before."""
    return ratio(F.col(c) - lag(c, k), lag(c, k))


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b), NULL unless both are positive."""
    return F.when((a > 0) & (b > 0), F.log(ratio(a, b)))


def clip(x: Column, low: float, high: float) -> Column:
    """Keeps NULL: greatest and least would skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def sign_of(positive: Column, negative: Column) -> Column:
    """1, -1 or 0; a missing condition is false."""
    return F.when(negative, -1).when(positive, 1).otherwise(0)


def compounded(r: Column | str) -> Column:
    """Running product of 1 + r; NULL where r is, and going on after it."""
    r = F.col(r) if isinstance(r, str) else r
    return F.when(r.isNotNull(), F.product(1 + r).over(so_far()))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Of pairs without a missing side; NULL where a side does not vary, for which the engine's own has an error."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    own = lambda a, b: F.stddev_pop(F.when(b.isNotNull(), a))
    return ratio(F.covar_pop(x, y), own(x, y) * own(y, x))


def sample_skew(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(x) + 6))


def day(c: str = "timestamp") -> Column:
    return F.to_date(c)
