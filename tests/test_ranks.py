"""Exact quantiles by rank cells against Spark's percentile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from popshift.operators import ranks

POINTS = [0.0, 0.005, 0.1, 0.25, 0.5, 0.75, 0.9, 0.995, 1.0]


@pytest.mark.parametrize("small", [10_000, 20, 1])
def test_quantiles_equal_percentile(spark, small, monkeypatch):
    """small: none, one and several rounds. Skewed, tied, constant, infinite and single values."""
    monkeypatch.setattr(ranks, "SMALL", small)
    monkeypatch.setattr(ranks, "CELLS", 16 if small < 100 else 1024)
    rng = np.random.default_rng(2)
    rows = [("normal", s, float(v)) for s in (0, 1) for v in rng.normal(0, 1, 400)]
    rows += [("skewed", 0, float(v)) for v in np.exp(rng.normal(0, 8, 500))]
    rows += [("tied", 0, float(v)) for v in rng.integers(0, 4, 300)]
    rows += [("same", 0, 7.5)] * 50 + [("one", 0, -3.0), ("two", 0, 1.0), ("two", 0, 2.0), ("tiny", 0, 5e-324), ("tiny", 0, 0.0)]
    rows += [("endless", 0, v) for v in (float("inf"), float("-inf"), 1.0, 2.0, 3.0)] + [("nulls", 0, None), ("some", 1, None), ("some", 1, 4.0)]
    df = spark.createDataFrame(rows, "name string, side int, v double")
    hist = ranks.histogram(df, ["side", "name"])
    got = {(r["side"], r["name"]): (list(r["q"]), r["n"]) for r in ranks.quantiles_of(hist, ["side", "name"], POINTS).collect()}
    want = {(r["side"], r["name"]): (list(r["q"]), r["n"]) for r in df.where("v is not null").groupBy("side", "name").agg(F.percentile("v", F.array(*map(F.lit, POINTS))).alias("q"), F.count("*").alias("n")).collect()}
    assert {k: (repr(q), n) for k, (q, n) in got.items()} == {k: (repr(q), n) for k, (q, n) in want.items()}


def test_no_groups(spark):
    assert ranks.quantiles_of(spark.createDataFrame([], "k int, v double, n long"), ["k"], [0.5]).collect() == []
