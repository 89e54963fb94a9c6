"""Distribution statistics with the bias corrections of common statistics packages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import as_column


def sample_skewness(c: Column | str) -> Column:
    """Bias-corrected skewness (NULL below three values)."""
    col = as_column(c)
    n = F.count(col).cast("double")
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(c: Column | str) -> Column:
    """Bias-corrected excess kurtosis (NULL below four values)."""
    col = as_column(c)
    n = F.count(col).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n > 3, scale * ((n + 1) * F.kurtosis(col) + 6))


def share_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage that never divides by zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)
