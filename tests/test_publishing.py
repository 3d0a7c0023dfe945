"""Published versions and the stream's state: a writer that dies, replays, late events."""

import os

import pytest
from pyspark.sql import functions as F

from popshift.sources.publishing import POINTER, Published
from popshift.streaming import periods

BEFORE = "2024-01-11 00:00:00"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_rollback_and_clean(spark, tmp_path):
    store = Published(spark, f"file://{tmp_path}/store")
    with pytest.raises(LookupError):
        store.table("t")
    one, two = (spark.createDataFrame([(k,)], "k int") for k in (1, 2))
    first = store.publish({"t": one, "u": one})
    second = store.publish({"t": two, "u": two})
    assert store.versions() == [first, second] and rows(store.table("t")) == [(2,)] and rows(store.table("u", first)) == [(1,)]
    assert store.rollback() == first and rows(store.table("u")) == [(1,)]
    with pytest.raises(LookupError):
        store.rollback()
    with pytest.raises(LookupError):
        store.table("t", second)
    for k in range(4):
        store.publish({"t": one}, keep=2)
    assert len(store.versions()) == 2 and len([x for x in os.listdir(tmp_path / "store") if x.startswith("v-")]) == 2 and store.clean() == 0


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path):
    store = Published(spark, str(tmp_path / "store"))
    good = spark.range(5).select(F.col("id").alias("k"))
    store.publish({"a": good, "b": good})
    bad = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("dies"))).otherwise(F.col("id")).cast("long").alias("k"))
    with pytest.raises(Exception, match="dies"):
        store.publish({"a": good.where("k = 0"), "b": bad})
    assert rows(store.table("a")) == rows(store.table("b")) == [(k,) for k in range(5)] and len(store.versions()) == 1
    # it dies between the tables and the pointer
    old = store._point
    store._point = lambda history: (_ for _ in ()).throw(OSError("dies"))
    with pytest.raises(OSError):
        store.publish({"a": good.where("k = 0"), "b": good})
    store._point = old
    assert rows(Published(spark, str(tmp_path / "store")).table("a")) == [(k,) for k in range(5)]
    assert store.clean() == 2 and rows(store.table("b")) == [(k,) for k in range(5)]
    assert sorted(x for x in os.listdir(tmp_path / "store") if not x.startswith(".")) == sorted([POINTER, store.current()])


@pytest.fixture(scope="module")
def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").persist()


def shown(df):
    return {r.period: (r.n, round(r.psi, 9), r.error_rate) for r in df.collect()}


def test_stream_equals_batch(spark, events, tmp_path):
    src, out = str(tmp_path / "events"), str(tmp_path / "out")
    events.repartition(6).write.parquet(src)  # every batch holds events of every period: most come late
    periods.run_stream(spark, src, BEFORE, out, str(tmp_path / "cp"), files=2)
    want = shown(periods.drift(periods.windowed(events), periods.baseline(events, BEFORE)))
    assert shown(Published(spark, out).table("drift")) == want and len(Published(spark, out).versions()) == 3
    # more files come later, and only they are read
    more = events.limit(50)
    more.write.mode("append").parquet(src)
    periods.run_stream(spark, src, BEFORE, out, str(tmp_path / "cp"))
    got = shown(Published(spark, out).table("drift"))
    assert sum(n for n, _, _ in got.values()) == sum(n for n, _, _ in want.values()) + 50


def test_replayed_batches_and_folding(spark, events, tmp_path):
    state = periods.State(spark, str(tmp_path / "state"))
    parts = events.randomSplit([1.0, 1.0, 1.0, 1.0], 3)
    want = rows(periods.windowed(events).select("period", "event_type", "n"))
    now = lambda: rows(state.histograms().select("period", "event_type", "n"))
    assert now() == []
    for k in (0, 1, 1, 2):
        state.add(parts[k], k)
    state.fold(1)
    state.fold(1)
    state.add(parts[0], 0)  # a replay of what is folded
    state.add(parts[3], 3)
    state.add(parts[3], 3)
    assert now() == want
    state.fold(3)
    assert now() == want and not [x for x in os.listdir(tmp_path / "state" / "batches") if x.startswith("batch=")]
    # a fold that dies before its swap changes nothing
    again = periods.State(spark, str(tmp_path / "state"))
    again.add(parts[0], 4)
    again.folded._point = lambda history: (_ for _ in ()).throw(OSError("dies"))
    with pytest.raises(OSError):
        again.fold(4)
    double = rows(periods.merged(periods.windowed(events).unionByName(periods.windowed(parts[0]))).select("period", "event_type", "n"))
    assert rows(periods.State(spark, str(tmp_path / "state")).histograms().select("period", "event_type", "n")) == double
