"""Shared-folder staging: cut lineage with a written table that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a temporary one is set.

    On a cluster an unset folder is an error, as executors don't share local ones. The folder goes when the driver's JVM
    ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="solvara-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/solvara-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it: runs once, survives lost executors."""
    path = shared_dir(df.sparkSession) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """A folder of any file system that Spark reads: names, existence and deletion below it."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.folder = folder.rstrip("/")
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        """Names in a subfolder, in order; none if it isn't there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def files(self, name: str) -> dict[str, int]:
        """All files below a subfolder with their time of change."""
        found = {}
        for status in self._fs.listStatus(self._at(name)) if self.exists(name) else []:
            own = f"{name}/{status.getPath().getName()}"
            found |= self.files(own) if status.isDirectory() else {own: status.getModificationTime()}
        return found

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def rename(self, name: str, to: str) -> bool:
        return self._fs.rename(self._at(name), self._at(to))
