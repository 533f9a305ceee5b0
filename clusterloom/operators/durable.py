"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; only a session in this one process gets its own where none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="clusterloom-checkpoint-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


#: Bytes of a row group that a writing task holds in memory.
ROW_GROUP = 16 << 20


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """df computed once and kept as Parquet in the shared checkpoint folder, its lineage cut; it stays as long as the folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    return _write(df, path)


#: Rows of a batch that goes to Python workers; whole texts count by the thousand, so batches are kept short.
BATCH = 1000


def short_batches(spark: SparkSession) -> None:
    """From now on the session sends BATCH rows at a time to Python workers, or fewer if it is set so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, BATCH)


class Workspace:
    """Intermediate tables of one operator call; they are deleted as soon as they are dropped or the call ends.

    What an operator returns must not read them: it is settled before the workspace closes.
    """

    def __init__(self, spark: SparkSession) -> None:
        short_batches(spark)
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[df for df, _ in self.paths.values()])

    def table(self, df: DataFrame) -> DataFrame:
        """df written and read again; shuffle files of what it was made from may go."""
        path = f"{ensure_checkpoint_dir(self.spark)}/work-{uuid.uuid4().hex}"
        out = _write(df, path)
        self.paths[id(out)] = (out, path)
        release(self.spark)
        return out

    def counted(self, df: DataFrame, *figures) -> tuple[DataFrame, dict]:
        """table(df) and aggregates over its rows, taken as they are written."""
        seen = Observation()
        out = self.table(df.observe(seen, *figures))
        return out, seen.get

    def holds(self, table: DataFrame) -> bool:
        return id(table) in self.paths

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in tables:
            _, path = self.paths.pop(id(df))
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of lineage that nothing holds any more; it learns that from the driver's collections."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fingerprint(*columns: str) -> list:
    """Count and order-free hash of rows, as aggregates n and mark."""
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("mark")]
