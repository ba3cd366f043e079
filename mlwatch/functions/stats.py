"""Scalar statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b as double, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct_of(part: Column, whole: Column) -> Column:
    """Share in percent; 0.0 for an empty whole."""
    return F.coalesce(safe_div(part, whole) * 100.0, F.lit(0.0))


def sample_skewness(n: Column, var: Column, g1: Column) -> Column:
    """Bias-corrected skewness from the population skewness; 0 without spread, null below three values."""
    n = n.cast("double")
    corrected = safe_div(g1 * F.sqrt(n * (n - 1.0)), n - 2.0)
    return F.when(n < 3, F.lit(None)).when(var == 0, F.lit(0.0)).otherwise(corrected)


def sample_kurtosis(n: Column, var: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one; 0 without spread, null below four values."""
    n = n.cast("double")
    corrected = safe_div(n - 1.0, (n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0)
    return F.when(n < 4, F.lit(None)).when(var == 0, F.lit(0.0)).otherwise(corrected)


def ks_pvalue(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Two-sided asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic.

    The alternating series of the Kolmogorov distribution. Below lambda = 0.2 it has not converged, but the
    p-value is 1 to more digits than a double holds.
    """
    n1, n2 = n1.cast("double"), n2.cast("double")
    lam = d * F.sqrt(safe_div(n1 * n2, n1 + n2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series))
    return F.when(lam < 0.2, 1.0).when(lam.isNotNull(), bounded)


def equal_width_bin(v: str, lo: str, step: str, nb: str, most: int) -> Column:
    """Index 0..nb-1 of the equal-width, left-closed bin of a value; the last bin is closed on the right.

    The index is the number of inner bin edges at or below the value, for at most ``most`` bins. Arguments are SQL.
    """
    edges = [f"IF({nb} > {k} AND {v} >= {k} * {step} + {lo}, 1, 0)" for k in range(1, most)]
    return F.expr(" + ".join(edges))
