"""Column helpers that every plan shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    """Six decimals, the precision in which results are compared."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def no_nan(c: Column | str) -> Column:
    """NaN becomes NULL, as every scan should deliver it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation over complete pairs; NULL where either side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def poisoned_avg(c: str) -> Column:
    """Mean that is NULL as soon as one value is (numpy's mean over NaN)."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))


def poisoned_std(c: str) -> Column:
    return F.when(F.count(F.lit(1)) == F.count(c), F.stddev_pop(c))
