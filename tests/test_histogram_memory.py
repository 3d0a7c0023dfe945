"""What a task holds while it counts candidates by value."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from popshift.operators import evaluate as ev


def rows(spark, n, values):
    return spark.range(0, n, 1, 1).select((F.col("id") % 2).cast("int").alias("side"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 50 / 50.0).alias("s"), (F.col("id") % 7).cast("double").alias("w"), (F.col("id") % values).cast("double").alias("x"))


def finder(cands):
    """Row i fits every candidate k that doesn't divide i + 1."""
    def of(arrays):
        i = arrays["i"].astype(int)
        fits = [np.flatnonzero((i + 1) % (k + 2) != 0) for k in range(cands)]
        return np.concatenate(fits), np.repeat(np.arange(cands), [len(f) for f in fits])

    return ev.Finder({"i": F.col("x")}, of, cands)


@pytest.mark.parametrize("counted", [7, 1_000_000])
def test_counts_in_turns_equal_a_plain_group_by(spark, monkeypatch, counted):
    monkeypatch.setattr(ev, "COUNTED", counted)
    df, roles = rows(spark, 3000, 300), ev.Roles(numeric=("x",))
    scores, counts = ev.histograms(df, roles, finder=finder(9))
    wide = df.withColumn("cand_id", F.explode(F.filter(F.sequence(F.lit(0), F.lit(8)), lambda k: (F.col("x") + 1) % (k + 2) != 0)))
    on = lambda i: F.count_if(F.col("side") == i)
    plain = wide.groupBy("cand_id", F.col("x").alias("v")).agg(on(0).alias("n0"), on(1).alias("n1"))
    take = lambda d: sorted((r["cand_id"], r["v"], r["n0"], r["n1"]) for r in d.collect())
    assert take(counts) == take(plain)
    bad = lambda d: sorted((r["cand_id"], r["s"], r["b0"], r["g0"], r["b1"], r["g1"], r["w0"], r["w1"]) for r in d.collect())
    assert bad(scores) == bad(ev.score_histogram(wide, roles))


def test_a_task_with_many_candidates_and_values_stays_small(spark, monkeypatch):
    """800 candidates by 20,000 values: 16 million cells, of which a task holds a bounded number at a time."""
    counting = {}
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema: counting.update(f=f, df=self) or spark.createDataFrame([], schema))
    df = rows(spark, 20_000, 20_000)
    ev.histograms(df, ev.Roles(numeric=("x",)), finder=finder(800))
    table = counting["df"].toArrow().combine_chunks()
    batches = table.to_batches(max_chunksize=1000)
    tracemalloc.start()
    pairs = sum(sum(x.column(x.schema.get_field_index("n0")).to_numpy() + x.column(x.schema.get_field_index("n1")).to_numpy()) for x in counting["f"](iter(batches)) if x.column(2)[0].as_py() == "x")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == sum((i + 1) % (k + 2) != 0 for k in range(800) for i in range(20_000))
    assert peak < 250e6
