"""What queries need from the session: tables, the shared folder, this package on the workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parents[1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; Python workers find this package as well."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH")])))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("/tmp/pulsegrid-checkpoints")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The store that holds a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def gone_at_the_end(spark: SparkSession, path: str) -> str:
    """The path of something that is there; it is deleted when the driver ends."""
    store, where = file_system(spark, path)
    store.deleteOnExit(where)
    return path
