"""Incremental monitoring of an event table (an extension: the batch operators run once per period).

Events stream in; tumbling windows of event time are periods. A micro-batch adds the histogram of its events, by period and
event type, to a state of mergeable histograms: a folder for each batch id, which a replay of the batch overwrites, so nothing
counts twice. Late events merge into their period whenever they come. Now and then the batches are folded into one table, which
a pointer swap makes visible. Each period is compared with a static baseline by the same measures as the batch query, from the
merged histograms; events are never read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.functions.buckets import psi_floored
from popshift.sources.publishing import Published

c = F.col


def windowed(events: DataFrame, period: str = "1 day") -> DataFrame:
    """Counts and value sums by period and event type."""
    g = events.withColumn("ts", c("ts").cast("timestamp")).groupBy(F.window("ts", period), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("period"), "event_type", "n", "value")


def baseline(events: DataFrame, before: str) -> DataFrame:
    g = events.where(c("ts") < F.lit(before).cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n0"))
    total = g.agg(F.sum("n0").alias("t0"))
    return g.join(F.broadcast(total), how="cross").select("event_type", (c("n0") / c("t0")).alias("p0"))


def drift(periods: DataFrame, base: DataFrame) -> DataFrame:
    """PSI of the event mix and the error rate of each period."""
    total = periods.groupBy("period").agg(F.sum("n").alias("t"))
    grid = total.join(F.broadcast(base), how="cross").join(periods, ["period", "event_type"], "left")
    share = F.coalesce(c("n"), F.lit(0)) / c("t")
    return grid.groupBy("period").agg(F.max("t").alias("n"), F.sum(psi_floored(c("p0"), share)).alias("psi"), F.max(F.when(c("event_type") == "error", share)).alias("error_rate"))


def merged(histograms: DataFrame) -> DataFrame:
    return histograms.groupBy("period", "event_type").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))


_SCHEMA = "period string, event_type string, n long, value double"


class State:
    """Histograms of the batches so far. Batches up to `upto` are folded into a published table, later ones are folders."""

    def __init__(self, spark: SparkSession, root: str, period: str = "1 day"):
        self.spark, self.root, self.period = spark, root.rstrip("/"), period
        self.folded = Published(spark, f"{self.root}/folded")

    def _upto(self) -> int:
        return self.folded.table("upto").first()["upto"] if self.folded.current() else -1

    def add(self, events: DataFrame, batch_id: int) -> None:
        """The histogram of a batch's events; the same batch again replaces it, a batch that is folded already changes nothing."""
        if batch_id > self._upto():
            windowed(events, self.period).select(c("period"), c("event_type"), c("n").cast("long"), c("value").cast("double")).write.mode("overwrite").parquet(f"{self.root}/batches/batch={batch_id}")

    def histograms(self) -> DataFrame:
        """(period, event_type, n, value) of all batches."""
        upto = self._upto()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batches")
        parts = [self.folded.table("histograms")] if upto >= 0 else []
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            new = self.spark.read.schema(f"{_SCHEMA}, batch long").parquet(str(path))
            parts.append(new.where(c("batch") > upto).drop("batch"))
        if not parts:
            return self.spark.createDataFrame([], _SCHEMA)
        return merged(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))

    def fold(self, upto: int) -> None:
        """Folds the batches up to this id, which must be done, into one table; their folders go after the swap."""
        before = self._upto()
        if upto <= before:
            return
        self.folded.publish({"histograms": self._up_to(upto), "upto": self.spark.createDataFrame([(upto,)], "upto long")}, keep=2)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batches")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for k in range(before + 1, upto + 1):
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batches/batch={k}"), True)

    def _up_to(self, upto: int) -> DataFrame:
        new = self.spark.read.schema(f"{_SCHEMA}, batch long").parquet(f"{self.root}/batches").where((c("batch") > self._upto()) & (c("batch") <= upto)).drop("batch")
        return merged(self.folded.table("histograms").unionByName(new) if self.folded.current() else new)


#: Batches after which the state is folded.
FOLD = 100


def run_stream(spark: SparkSession, path: str, before: str, out: str, checkpoint: str, files: int | None = None) -> None:
    """Read the event files as a stream to its present end, at most `files` a batch. After each batch the periods' drift is
    published below out, as table `drift`; a batch that is replayed after a failure leaves the same tables."""
    history = spark.read.parquet(path)
    base = baseline(history, before)
    state, results = State(spark, f"{out}/state"), Published(spark, out)

    def sink(events: DataFrame, batch_id: int) -> None:
        state.add(events, batch_id)
        if batch_id % FOLD == FOLD - 1:
            state.fold(batch_id)
        results.publish({"drift": drift(state.histograms(), base)})

    reader, at = spark.readStream.schema(history.schema), spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads a folder's files
        reader, path = reader.option("pathGlobFilter", at.getName()), str(at.getParent())
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(sink).start().awaitTermination()
