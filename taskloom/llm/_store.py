"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from taskloom.llm import _memory


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, as in tests, a folder of this process.

    Off a local master such a folder would be another one on each machine, so
    that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="taskloom-")
        atexit.register(shutil.rmtree, found, True)
        found = f"file://{found}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Written tables that cut lineage; a lost executor costs only the stage under way.

    A result may read them as long as the application runs; they are deleted as it ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        # What the driver's Python has freed goes back to the system.
        _memory.release()
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        fs, path = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, path: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # Rows may hold packed records of megabytes: pages are checked for their size at every row, not only each hundred.
        df.write.mode("overwrite").option("parquet.page.size.row.check.min", "1").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Has Spark's cleaner delete the shuffle files of steps whose results are written now, not at its next half-hourly round.

        It finds them when the driver collects garbage, for which Python has to let
        go of them first; Spark's setting that cleans up as a
        query ends leaves out queries that write a table.
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.2)
        _memory.release()

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        fs, path = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
