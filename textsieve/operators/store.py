"""Frames that are written once to the folder which driver and executors share, and read as often as needed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as Parquet files under spark.checkpoint.dir; a temporary folder only where that is unset (tests)."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="textsieve-")
    path = f"{root.rstrip('/')}/textsieve/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
