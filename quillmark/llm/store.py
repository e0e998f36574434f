"""Scratch tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one of our own only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark, "_quillmark_dir", None)
        if not found:
            found = "file:" + tempfile.mkdtemp(prefix="quillmark-")
            spark._quillmark_dir = found
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table called ``name``."""
    return f"{shared_dir(spark)}/quillmark/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage like a reliable checkpoint, but compressed and
    columnar; a lost executor takes none of it along.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillmark_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in tables:
        remove(df.sparkSession, df._quillmark_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: what hash-dealt groups are sized by."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the bytes of ``df``: files know their sizes; 0 where a plan's is unknown."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 55 else 0


def tidy(spark: SparkSession) -> None:
    """Let the driver's cleaner drop the shuffle files of plans that are done with.

    Spark frees them when their plans are collected as garbage, which a driver with
    a large heap may not do for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
