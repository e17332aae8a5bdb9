"""Cutting lineage through tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def _one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where that is unset on a local master (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not _one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ratioscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables of one operator run.  A written table survives lost executors and has known statistics,
    so the optimizer may pick a broadcast for it only under the session's size threshold."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.one_machine = _one_machine(spark)
        atexit.register(self._remove, self.root, True)

    def write(self, df: DataFrame | Iterable[DataFrame], name: str) -> DataFrame:
        """A table of ``df``, or of several frames of one schema that are written one after another: what one of them shuffles is
        gone when the next one is made."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        for part in [df] if isinstance(df, DataFrame) else df:
            part.write.mode("append").parquet(path)
            schema = part.schema
            if not self.one_machine:
                gc.collect()  # Python's handles keep plans alive in the JVM
                self.spark._jvm.System.gc()  # lets the driver's cleaner remove the shuffle files of finished plans
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Free tables that no later plan reads."""
        for t in tables:
            self._remove(t._scratch_path)

    def _remove(self, path: str, closing: bool = False) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            if not closing:  # at exit the session may be gone already
                raise
