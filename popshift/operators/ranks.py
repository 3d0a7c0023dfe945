"""Exact quantiles of many groups at once, without a task that holds a group's values.

A histogram (keys, v, n) is searched for the rows of the wanted ranks: a group's range is cut into CELLS cells, whose counts say
in which cell each rank lies; such a cell's own range is cut again, until it has SMALL distinct values at most, which are put in
order. A round is a scan that gives CELLS counts for each cell with a rank; everything else is left out of the next one.
Quantiles are interpolated linearly between neighbouring ranks, as Spark's percentile does, and equal its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from popshift.sources.staging import discard, staged

CELLS, SMALL = 1024, 10_000
c = F.col


def histogram(long: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, v, n) of a long table, written: counts by distinct value, nulls included."""
    return staged(long.groupBy(*keys, c(value).alias("v")).agg(F.count("*").alias("n")), "histogram")


def _positions(points: list[float]) -> list[tuple[Column, Column, Column]]:
    """(place, the rank below, the rank above) of each point among _total rows."""
    places = [F.lit(p) * (c("_total") - 1) for p in points]
    return [(x, F.floor(x), F.ceil(x)) for x in places]


def quantiles_of(hist: DataFrame, keys: list[str], points: list[float]) -> DataFrame:
    """(keys, q, n): q the quantiles at the points, n the rows, of each group of a histogram that is cheap to read. Null values
    don't count; groups without values have no row. Groups are few enough for a broadcast of CELLS counts each: columns, or a
    bounded pool of candidates and their columns."""
    hist = hist.where("v is not null").select(*keys, c("v").cast("double").alias("v"), "n")
    ends = hist.groupBy(*keys).agg(F.sum("n").alias("_total"), F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count("*").alias("_rows"))
    ranks = F.array_distinct(F.array(*[r for _, below, above in _positions(points) for r in (below, above)]))
    cells = staged(ends.select(*keys, "_total", "_lo", "_hi", "_rows", F.lit(0).cast("long").alias("_base"), F.explode(ranks).alias("_r")), "ranks")
    kept = [cells]
    while (cells.agg(F.max("_rows")).first()[0] or 0) > SMALL:
        cells = staged(_refined(hist, cells, keys), "ranks")
        kept.append(cells)
    inside = _inside(hist, cells, keys)
    cum = F.sum("n").over(Window.partitionBy(*keys, "_lo").orderBy("v"))
    inside = inside.select(*keys, "_lo", "v", (c("_base") + cum - c("n")).alias("_a"), (c("_base") + cum).alias("_b"))
    found = cells.join(inside, [*keys, "_lo"]).where((c("_r") >= c("_a")) & (c("_r") < c("_b")))
    found = found.groupBy(*keys).agg(F.max("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_r", "v"))).alias("_at"))

    def at(place: Column, below: Column, above: Column) -> Column:
        lo, hi = c("_at")[below], c("_at")[above]
        return F.when((below == above) | (lo == hi), lo).otherwise((above - place) * lo + (place - below) * hi)

    out = staged(found.select(*keys, F.array(*[at(*x) for x in _positions(points)]).alias("q"), c("_total").alias("n")), "quantiles")
    for table in kept:
        discard(table)
    return out


def _inside(hist: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The histogram's rows that lie in a cell with a rank."""
    here = F.broadcast(cells.select(*keys, "_lo", "_hi", "_base").distinct())
    return hist.join(here, keys).where((c("v") >= c("_lo")) & (c("v") <= c("_hi")))


def _refined(hist: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The smaller cells in which the ranks lie."""
    share = (c("v") - c("_lo")) / (c("_hi") - c("_lo"))
    cell = F.when(c("_hi") <= c("_lo"), 0).when(F.isnan(share), CELLS - 1).otherwise(F.least(F.lit(CELLS - 1), F.floor(share * CELLS)))
    g = _inside(hist, cells, keys).groupBy(*keys, "_lo", "_base", cell.alias("_cell")).agg(F.sum("n").alias("_n"), F.min("v").alias("_first"), F.max("v").alias("_last"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_lo").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.select(*keys, "_lo", "_first", "_last", "_rows", (c("_base") + before).alias("_a"), (c("_base") + before + c("_n")).alias("_b"))
    found = cells.drop("_rows", "_base").join(g, [*keys, "_lo"]).where((c("_r") >= c("_a")) & (c("_r") < c("_b")))
    # A cell that holds all of its parent's values has a single one left apart from infinities, which sort at once.
    alone = (c("_first") == c("_last")) | ((c("_first") == c("_lo")) & (c("_last") == c("_hi")))
    return found.select(*keys, "_total", c("_first").alias("_lo"), c("_last").alias("_hi"), F.when(alone, F.least("_rows", F.lit(SMALL))).otherwise(c("_rows")).alias("_rows"), c("_a").alias("_base"), "_r")
