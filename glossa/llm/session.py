"""Shared folder, lineage cuts and sizes, read from the running session."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a new local one is set, if all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='shared-')}")
    return os.path.dirname(sc._jsc.sc().getCheckpointDir().get())


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and the table's path (for `drop_folder`)."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size of the frame's input (file bytes for scans), 0 if it has none; no job runs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def ranges(df: DataFrame, each: int = 4 << 20) -> int:
    """Key ranges so that one range gets a bounded share of the input, however large it is."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, input_bytes(df) // each + 1)


def positional(df: DataFrame) -> DataFrame:
    """df with its columns named _0, _1, ... by place, so that no name of its own clashes with an operator's."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])
