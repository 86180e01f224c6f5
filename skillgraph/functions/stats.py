"""Closed forms of test statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_two_tailed_p(t: Column, df: Column) -> Column:
    """Two-tailed p of Student's t with a whole number of degrees of freedom, by its finite series in cos(theta)."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    c, s = F.cos(theta), F.sin(theta)
    terms = lambda first, last: F.when(last >= first, F.sequence(first, last, F.lit(2))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def grow(acc: Column, k: Column) -> Column:
        term = acc["term"] * c * c * (k - 1).cast("double") / k.cast("double")
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    even = s * F.aggregate(terms(F.lit(2), df.cast("int") - 2), start, grow)["total"]
    odd_sum = F.aggregate(terms(F.lit(3), df.cast("int") - 2), start, grow)["total"]
    odd = F.lit(2.0) / F.lit(3.141592653589793) * (theta + F.when(df > 1, s * c * odd_sum).otherwise(0.0))
    return F.lit(1.0) - F.when(df % 2 == 0, even).otherwise(odd)


def normal_two_tailed_p(z: Column) -> Column:
    """Two-tailed p of a standard normal by the rational approximation of erfc (relative error below 1.2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    # fixed values: coefficients of the published Chebyshev fit of erfc, from the constant upwards
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    total: Column = F.lit(0.0)
    for coefficient in reversed(fit):
        total = total * t + coefficient
    return t * F.exp(-x * x + total)
