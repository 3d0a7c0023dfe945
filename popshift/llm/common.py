"""Small helpers that the operators share: tables, the shared folder, Arrow columns as bytes."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a folder of our own, on
    one machine only: a cluster without a shared folder is an error, as nobody would read what executors write."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.popshift.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="popshift-")
        spark.conf.set("spark.popshift.dir", base)
    return base


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors.

    Once it is written its shuffle files are of no more use, so Spark is told to delete them with the execution.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a staged table that nothing will read any more."""
    jvm, files = df.sparkSession._jvm, df.inputFiles()
    if files:
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch, and its rows at most.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1_000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, so that very long texts fit a Python worker, whatever their number of rows.

    It holds for every operator here and is the same for all, so it doesn't matter which query of a session set it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_bytes(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, UTF-8 bytes of the text; null: empty), and no other column, so extra columns can't clash."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_b"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lower_ascii(col):
    """A-Z lower-cased, and nothing else."""
    return F.translate(col, UPPER, LOWER)


def share_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], tag: str) -> str:
    """Sends arrays to each executor once, as a file; the name under which tasks find it."""
    sc, name = spark.sparkContext, f"{tag}-{uuid.uuid4().hex}"
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 16) * 16
    said = json.dumps(head).encode()
    with open(path := os.path.join(sc._temp_dir, name), "wb") as f:  # the driver's own folder, from which Spark serves the file until the session ends
        f.write(len(said).to_bytes(16, "little") + said.ljust(-(-len(said) // 16) * 16))
        for a in arrays.values():
            f.write(a.tobytes().ljust(-(-a.nbytes // 16) * 16, b"\0"))
    sc.addFile(path)
    return name


def mapped_arrays(path: str) -> dict[str, np.ndarray]:
    """Views of the executor's file: all its tasks map the same pages."""
    whole = np.memmap(path, np.uint8, "r").view(np.ndarray)
    size = int.from_bytes(whole[:16].tobytes(), "little")
    start = 16 + -(-size // 16) * 16
    return {k: whole[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in json.loads(whole[16 : 16 + size].tobytes()).items()}
