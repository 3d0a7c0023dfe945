"""Quantile edges and bucket numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-6


def quantiles(value: Column, points: list[float]) -> Column:
    """Exact quantiles with linear interpolation, as an aggregate."""
    return F.percentile(value, F.array(*[F.lit(p) for p in points]))


def deciles(value: Column) -> Column:
    return quantiles(value, [round(0.1 * i, 1) for i in range(11)])


def interior(edges: Column) -> Column:
    """Distinct edges without the outer two, whose bins reach to infinity; empty if fewer than two are distinct."""
    unique = F.array_sort(F.array_distinct(edges))
    return F.when(F.size(unique) > 2, F.slice(unique, 2, F.size(unique) - 2)).otherwise(F.slice(unique, 1, 0))


def right_closed(value: Column, edges: Column) -> Column:
    """Number of the bin (lo, hi] that holds the value: how many edges lie below it."""
    return F.size(F.filter(edges, lambda e: e < value))


def left_closed(value: Column, edges: Column) -> Column:
    """Number of the bin [lo, hi): how many edges aren't above the value."""
    return F.size(F.filter(edges, lambda e: e <= value))


def psi_term(dev: Column, mon: Column) -> Column:
    return (mon - dev) * F.ln(mon / dev)


def psi_floored(dev: Column, mon: Column, floor: float = EPS) -> Column:
    """A bin's PSI with both shares at least floor."""
    return psi_term(F.greatest(dev, F.lit(floor)), F.greatest(mon, F.lit(floor)))


def psi_band(psi: Column) -> Column:
    return F.when(psi < 0.1, "Stable").when(psi <= 0.25, "Moderate Drift").otherwise("Significant Drift")


def suite_label(value: Column, stable: float, shift: float) -> Column:
    return F.when(value < stable, "stable").when(value < shift, "monitor").otherwise("shift")
