"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


FILE = 1 << 13  # documents in a file of their texts or of what is made of them


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="textsieve-")
    return path.rstrip("/")


def few(df: DataFrame, files: int | None) -> DataFrame:
    """df in no more partitions than these (but as many as there are cores; None: as it is), each of several one after the other.

    Small files cost more than their rows do: on a local folder without Hadoop's native library a file and its checksum are
    three processes that the executor forks, one for each mode that is set. Until it runs its own program, such a child has all of the
    executor's memory as its own, and is counted so by whoever looks."""
    return df if files is None else df.coalesce(max(files, df.sparkSession.sparkContext.defaultParallelism))


def cut(df: DataFrame, tag: str = "stage", files: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: later plans start from the files, which outlive executors. files: as in few()."""
    path = f"{shared_dir(df.sparkSession)}/textsieve/{tag}-{uuid.uuid4().hex}"
    few(df, files).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Removes the files behind a frame returned by cut()."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/textsieve/" in f:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def int_array(values) -> Column:
    """A constant array<int> that the JVM parses once."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<int>")


def release() -> None:
    """Gives a Python worker's free memory back to the system: idle workers stay beside the tasks of the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that what is made of one part at a time stays small."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)
    release()
