"""Event-table monitoring as a batch query; the streaming run gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from popshift.plans.registry import query, rounded
from popshift.sources.publishing import Published
from popshift.sources.staging import shared_dir
from popshift.sources.tables import table
from popshift.streaming import periods

BEFORE = "2024-01-11 00:00:00"


PERIODS_SQL = f"""WITH p AS (SELECT strftime(ts, '%Y-%m-%d') AS period, event_type, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT event_type, count(*) / (SELECT count(*) FROM events WHERE ts < TIMESTAMP '{BEFORE}') AS p0 FROM events WHERE ts < TIMESTAMP '{BEFORE}' GROUP BY ALL), t AS (SELECT period, sum(n) AS t FROM p GROUP BY ALL),
g AS (SELECT t.period, t.t, b.event_type, greatest(p0, 1e-6) AS p0, greatest(coalesce(n, 0) / t.t, 1e-6) AS p1, coalesce(n, 0) / t.t AS share FROM t CROSS JOIN b LEFT JOIN p ON p.period = t.period AND p.event_type = b.event_type)
SELECT period, CAST(max(t) AS BIGINT) AS n, round(sum((p1 - p0) * ln(p1 / p0)), 6) AS psi, round(max(CASE WHEN event_type = 'error' THEN share END), 6) AS error_rate FROM g GROUP BY period"""


@query("event_periods", PERIODS_SQL)
def event_periods(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return rounded(periods.drift(periods.windowed(events), periods.baseline(events, BEFORE)))


@query("event_periods_stream", PERIODS_SQL)
def event_periods_stream(spark, sf_dir):
    """The same rows from the event table as a stream: batches merge into the state, and what is published is read back."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    periods.run_stream(spark, f"{sf_dir}/events.parquet", BEFORE, out, f"{out}-checkpoint")
    return rounded(Published(spark, out).table("drift"))


@query("published_rollback", f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE ts < TIMESTAMP '{BEFORE}' GROUP BY event_type")
def published_rollback(spark, sf_dir):
    """Two versions of a table are published and the second is rolled back: the first is the current one again."""
    events = table(spark, sf_dir, "events")
    counts = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    store = Published(spark, f"{shared_dir(spark)}/published-{uuid.uuid4().hex}")
    store.publish({"counts": counts(events.where(F.col("ts") < F.lit(BEFORE).cast("timestamp_ntz")))})
    store.publish({"counts": counts(events)})
    store.rollback()
    return store.table("counts").withColumn("value", F.round("value", 4))
