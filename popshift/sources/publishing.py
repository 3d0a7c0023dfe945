"""Publishing result tables in versions: readers see one whole version, before and after.

A version is a folder with a Parquet table for each name. It is written first; then a pointer, a small file that names the
current version, is replaced by one rename, which file systems do at once or not at all. A writer that dies halfway leaves a
folder that nobody points to, and the old version readable. Older versions stay as a backup, so a publication can be rolled
back; superfluous ones are deleted after the swap, never the current one or the one before.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


class Published:
    """Versioned tables below a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._jvm = spark, root.rstrip("/"), spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *filter(None, parts)]))

    def _history(self) -> list[str]:
        """The versions that were current, the latest last: the pointer's lines."""
        path = self._path(POINTER)
        if not self._fs.exists(path):
            return []
        stream = self._fs.open(path)
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).split()
        finally:
            stream.close()

    def _point(self, history: list[str]) -> None:
        """Replaces the pointer: written beside it, then renamed over it."""
        new = self._path(f"_{uuid.uuid4().hex}")
        stream = self._fs.create(new, False)
        try:
            stream.write(bytearray("\n".join(history).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._path(POINTER), options)

    def publish(self, tables: Mapping[str, DataFrame], keep: int = 3) -> str:
        """Writes the tables as a new version, makes it the current one, and keeps that many versions."""
        version = f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self.root}/{version}/{name}")
        history = [*self._history(), version]
        kept = history[-max(2, keep) :]
        self._point(kept)
        for old in history[: -len(kept)]:
            self._fs.delete(self._path(old), True)
        return version

    def versions(self) -> list[str]:
        """Versions that can be read, the current one last."""
        return self._history()

    def current(self) -> str | None:
        return next(reversed(self._history()), None)

    def table(self, name: str, version: str | None = None) -> DataFrame:
        """A table of the current version, or of another one that is kept."""
        history = self._history()
        if not history or (version and version not in history):
            raise LookupError(f"nothing published as {name}" if not version else f"no version {version}")
        return self.spark.read.parquet(f"{self.root}/{version or history[-1]}/{name}")

    def rollback(self) -> str:
        """Makes the version before the current one current again; the current one goes."""
        history = self._history()
        if len(history) < 2:
            raise LookupError("no version before the current one")
        self._point(history[:-1])
        self._fs.delete(self._path(history[-1]), True)
        return history[-2]

    def clean(self) -> int:
        """Deletes what writers that died have left; not while others write. The number of folders and files deleted."""
        known, gone = {*self._history(), POINTER}, 0
        for status in self._fs.listStatus(self._path("")):
            name = status.getPath().getName()
            if name not in known and not name.startswith("."):
                gone += bool(self._fs.delete(status.getPath(), True))
        return gone
