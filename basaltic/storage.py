"""Scratch tables in the storage that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where driver and executors are one process and no shared folder is named.
LOCAL_SCRATCH = "file:///tmp/checkpoints"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; it has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder in shared storage, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/basaltic/{tag}-{uuid.uuid4().hex}"
    store, place = _hadoop(spark, path)
    store.deleteOnExit(place)
    return path


def put_file(spark: SparkSession, local: str, path: str) -> None:
    """Copies a file of the driver's machine to shared storage."""
    store, place = _hadoop(spark, path)
    store.copyFromLocalFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), place)


def drop_scratch(spark: SparkSession, path: str) -> None:
    store, place = _hadoop(spark, path)
    store.delete(place, True)


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to shared storage and read it back: lineage ends there, so lost executors
    cost a reread and not the work before it. Returns the table and its path."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, tag: str) -> DataFrame:
    return materialize(df, tag)[0]
