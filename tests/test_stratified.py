"""Stratified samples and feature strength against plain versions."""

import hashlib
import math
import random

import pytest

from popshift.operators import cart, etl, evaluate as ev, generators as gen


@pytest.mark.parametrize("prefix", [1, 4])
def test_stratified_sample_is_the_rows_of_the_smallest_hashes(spark, prefix, monkeypatch):
    monkeypatch.setattr(etl, "PREFIX", prefix)
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "a", "a", "b", None, "one"][: 5 if k else 6])) for k in range(500)] + [(7, "a")] * 3 + [(None, "b")]
    df = spark.createDataFrame(rows, "k int, s string").withColumnRenamed("k", "key")
    for share in (0.0, 0.1, 0.5, 1.0):
        want = []
        for s in ("a", "b", None, "one"):
            own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, hashlib.md5(str(r[0]).encode()).hexdigest(), r[0] or 0))
            want += own[: math.ceil(share * len(own))]
        got = [tuple(r) for r in etl.stratified(df, "s", share, "key").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_strength_by_cells_equals_pairs(spark, monkeypatch):
    monkeypatch.setattr(cart, "CELLS", 5)
    rng = random.Random(3)
    rows = [(0, int(rng.random() < 0.3), float(rng.choice([1, 1, 2, 7, 100])) if rng.random() < 0.9 else None, 4.0, rng.choice("xyz")) for _ in range(300)]
    df = spark.createDataFrame(rows, "side int, y int, v double, same double, g string")
    got = {r["name"]: r["strength"] for r in gen.feature_strength(df, ev.Roles(numeric=("v", "same"), categorical=("g",))).collect()}
    bad, good = ([r[2] for r in rows if r[1] == y and r[2] is not None] for y in (1, 0))
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert got["v"] == pytest.approx(abs(auc - 0.5)) and got["same"] == pytest.approx(0.0) and got["g"] > 0
