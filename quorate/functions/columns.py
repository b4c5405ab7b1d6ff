"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def guarded_corr(x: str, y: str, n: str | None = None, least: int = 0) -> Column:
    """Pearson correlation from sums; null when a side is constant or rows are fewer than ``least``."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    k = F.count(a)
    cov = F.avg(a * b) - F.avg(a) * F.avg(b)
    va, vb = F.avg(a * a) - F.avg(a) * F.avg(a), F.avg(b * b) - F.avg(b) * F.avg(b)
    return F.when((k >= least) & (va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb))


def rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})
