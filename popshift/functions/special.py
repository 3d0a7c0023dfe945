"""Distribution functions as columns: normal tails, Kolmogorov-Smirnov survival, Student t."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

#: erf's series is summed to this many terms; it has converged for every z below FAR, and beyond it the tail is 0.
TERMS, FAR = 160, 8.3


def normal_two_sided(z: Column) -> Column:
    """2 (1 - Phi(|z|)); null stays null."""
    x = F.least(F.abs(z), F.lit(FAR)) / math.sqrt(2)
    start = F.struct(x.alias("term"), x.alias("sum"))
    step = lambda a, n: F.struct((a["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (a["sum"] + a["term"] * 2 * x * x / (2 * n + 1)).alias("sum"))
    erf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["sum"]) * F.exp(-x * x) * (2 / math.sqrt(math.pi))
    return F.when(F.abs(z) >= FAR, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - erf))


NORMAL_SQL = "CASE WHEN abs({z}) >= 8.3 THEN 0.0 WHEN {z} = 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum([exp((2 * n + 1) * ln(abs({z}) / sqrt(2.0::DOUBLE)) - {z} * {z} / 2 - lgamma(n + 1.5)) FOR n IN range(161)])) END"


def ks_survival(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample p-value with Stephens' correction; null where a sample has fewer than two rows."""
    en = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when((n1 >= 2) & (n2 >= 2), F.when(lam < 0.27, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))))


def ks_survival_sql(d: str, n1: str, n2: str) -> str:
    en = f"sqrt({n1}::DOUBLE * {n2} / ({n1} + {n2}))"
    lam = f"(({en} + 0.12 + 0.11 / {en}) * {d})"
    series = f"list_sum([CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * {lam} * {lam}) FOR k IN range(1, 101)])"
    return f"CASE WHEN {n1} >= 2 AND {n2} >= 2 THEN CASE WHEN {lam} < 0.27 THEN 1.0 ELSE least(1.0, greatest(0.0, {series})) END END"


def t_cdf(t: float, dof: int) -> float:
    """Student's distribution function for whole degrees of freedom, by its finite trigonometric sums."""
    theta = math.atan2(t, math.sqrt(dof))
    cos2 = math.cos(theta) ** 2
    if dof % 2:
        total, term = 0.0, math.cos(theta)
        for k in range(1, dof - 1, 2):
            total += term
            term *= cos2 * (k + 1) / (k + 2)
        return 0.5 + (theta + math.sin(theta) * total) / math.pi
    total, term = 0.0, 1.0
    for k in range(0, dof - 1, 2):
        total += term
        term *= cos2 * (k + 1) / (k + 2)
    return 0.5 + math.sin(theta) * total / 2


def t_quantile(p: float, dof: int) -> float:
    lo, hi = -1.0, 1.0
    while t_cdf(lo, dof) > p:
        lo *= 2
    while t_cdf(hi, dof) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2


def _per_value(f: Callable[[float, int], float]):
    @F.pandas_udf("double")
    def column(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([f(a, int(n)) if a == a and a is not None and n == n and n > 0 else None for a, n in zip(x, dof, strict=True)], dtype="float64")

    return column


def t_quantile_column(p: Column, dof: Column) -> Column:
    return _per_value(t_quantile)(p.cast("double"), dof.cast("double"))


def t_two_sided_column(t: Column, dof: Column) -> Column:
    return _per_value(lambda x, n: 2 * (1 - t_cdf(abs(x), n)))(t.cast("double"), dof.cast("double"))
