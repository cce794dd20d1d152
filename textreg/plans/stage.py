"""Written stages in the folder the cluster shares between executors."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="textreg-")


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Without the setting a local folder is used on a local master only; elsewhere executors would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or _local_root()).rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/textreg/{label}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, label: str = "stage", codec: str = "snappy") -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts the lineage like a checkpoint does, but stays columnar: a later pass that needs
    one column reads one column, and a lost executor re-reads files instead of recomputing.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more.

    Spark does so when the driver collects its garbage, which a driver with free memory may put off for half an hour. A job of many written
    steps calls this between them, so that it keeps the shuffles of one step on disk and not those of all.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
