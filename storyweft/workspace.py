"""Shared scratch space for operators that cut their lineage.

A stage is a table written to the folder that every executor sees, so that the
loss of an executor costs a task retry and never the whole loop. The folder is
the one the session names in ``spark.checkpoint.dir``. A session without one gets a
folder of its own only where all of Spark is one process (``local[n]``); on a cluster
it is an error, since executors would each write to their own disk.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="storyweft-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_open: list[Workspace] = []


def sweep() -> None:
    """Delete the stages of all operators so far; what they returned can't be read after it."""
    while _open:
        _open.pop().close()


class Workspace:
    """One folder of stages, removed by ``close``; a stage can be dropped earlier."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _open.append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def stage(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Write ``df``, in folders ``by`` columns if given, and return it as a scan of what was written."""
        path = self.path(name)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        # the schema is known, so no file has to be opened to infer it
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *stages: DataFrame) -> None:
        """Delete stages that nothing reads any more."""
        for df in stages:
            path = getattr(df, "_stage_path", None)
            if path:
                remove_path(self.spark, path)

    def remove(self, path: str) -> None:
        remove_path(self.spark, path)

    def close(self) -> None:
        remove_path(self.spark, self.root)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
