"""A folder that the driver and all executors share, for files that queries write and read again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below spark.checkpoint.dir, or the folder of setCheckpointDir. Where neither is set a temporary folder serves in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or os.environ.get("TALLYSPARK_TEST_DIR")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        os.environ["TALLYSPARK_TEST_DIR"] = found = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
    root = (found if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)).rstrip("/")
    return f"{root}/tallyspark/{name}-{uuid.uuid4().hex}"


def stored(df, name: str):
    """df written below the shared folder and read again: what follows plans from there, and a lost executor redoes no more."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
