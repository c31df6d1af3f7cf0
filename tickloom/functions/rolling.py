"""Rolling windows with warm-up: a frame of n rows has no value before it holds n values that aren't null."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SYMBOL, TIME = ("symbol",), ("bar_start",)


def ordered(keys: tuple[str, ...] = SYMBOL, time: tuple[str, ...] = TIME) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*time)


def last(n: int, by: WindowSpec | None = None) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return (by or ordered()).rowsBetween(-(n - 1), 0)


def upto(by: WindowSpec | None = None) -> WindowSpec:
    return (by or ordered()).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, of: Column, n: int, w: WindowSpec) -> Column:
    return F.when(F.count(of).over(w) == n, value)


def mean(c: Column, n: int, by: WindowSpec | None = None) -> Column:
    w = last(n, by)
    return full(F.avg(c).over(w), c, n, w)


def std(c: Column, n: int, by: WindowSpec | None = None) -> Column:
    """Sample standard deviation."""
    w = last(n, by)
    return full(F.stddev_samp(c).over(w), c, n, w)


def std_pop(c: Column, n: int, by: WindowSpec | None = None) -> Column:
    w = last(n, by)
    return full(F.stddev_pop(c).over(w), c, n, w)


def lowest(c: Column, n: int, by: WindowSpec | None = None) -> Column:
    w = last(n, by)
    return full(F.min(c).over(w), c, n, w)


def highest(c: Column, n: int, by: WindowSpec | None = None) -> Column:
    w = last(n, by)
    return full(F.max(c).over(w), c, n, w)


def change(c: Column, n: int, by: WindowSpec | None = None) -> Column:
    """c / lag(c, n) - 1; null where the earlier value is 0."""
    return F.try_divide(c, F.lag(c, n).over(by or ordered())) - 1


def skew(c: Column, n: int, by: WindowSpec | None = None) -> Column:
    """Sample-adjusted skewness (G1)."""
    w = last(n, by)
    return full(F.skewness(c).over(w) * ((n * (n - 1)) ** 0.5 / (n - 2)), c, n, w)


def kurt(c: Column, n: int, by: WindowSpec | None = None) -> Column:
    """Sample-adjusted excess kurtosis (G2)."""
    w = last(n, by)
    return full((F.kurtosis(c).over(w) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3))), c, n, w)


def corr(x: Column, y: Column, n: int, by: WindowSpec | None = None) -> Column:
    """Pearson's r; null where a side is constant."""
    w = last(n, by)
    scale = F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)
    return full(F.try_divide(F.covar_samp(x, y).over(w), scale), x + y, n, w)


def forward_fill(c: Column, by: WindowSpec | None = None) -> Column:
    return F.last(c, ignorenulls=True).over(upto(by))
