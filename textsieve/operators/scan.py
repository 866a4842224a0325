"""Ordered scans over one source that do not put a source into one task.

A source is cut into chunks of ``size`` line numbers. The scan runs inside each chunk; what it hands on to
the next chunks is one row a chunk, scanned by source and joined back. A file of 10^10 lines is then
10^5 tasks' worth of work and a second scan over 10^5 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 1 << 16


def _chunked(df: DataFrame, order: str, size: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / size).cast("bigint"))


def _join(df: DataFrame, carry: DataFrame, by: list[str]) -> DataFrame:
    on = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in [*by, "_chunk"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    kept = [F.col(f"_l.{c}").alias(c) for c in df.columns]
    return df.alias("_l").join(carry.alias("_r"), cond, "left").select(*kept, "_r._carry")


def forward_fill(df: DataFrame, value: Column, out: str, by: list[str], order: str = "line_no", size: int = SIZE) -> DataFrame:
    """out: the last non-null value up to and with the row."""
    df = _chunked(df.withColumn(out, value), order, size)
    local = F.last(out, ignorenulls=True).over(Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    tails = df.groupBy(*by, "_chunk").agg(F.max_by(out, F.when(F.col(out).isNotNull(), F.col(order))).alias("_tail"))
    carry = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("_tail")
    return _join(df.withColumn("_local", local), carry, by).withColumn(out, F.coalesce("_local", "_carry")).drop("_local", "_carry", "_chunk")


def running_sum(df: DataFrame, value: Column, out: str, by: list[str], order: str = "line_no", size: int = SIZE) -> DataFrame:
    """out: the sum of value up to and with the row."""
    df = _chunked(df.withColumn(out, value.cast("bigint")), order, size)
    local = F.sum(out).over(Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    tails = df.groupBy(*by, "_chunk").agg(F.sum(out).alias("_tail"))
    carry = tails.withColumn("_carry", F.sum("_tail").over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("_tail")
    return _join(df.withColumn("_local", local), carry, by).withColumn(out, F.col("_local") + F.coalesce("_carry", F.lit(0))).drop("_local", "_carry", "_chunk")


def previous(df: DataFrame, value: Column, out: str, by: list[str], order: str = "line_no", size: int = SIZE) -> DataFrame:
    """out: the value of the row before; null for the first."""
    df = _chunked(df.withColumn("_v", F.struct(value.alias("v"))), order, size)
    w = Window.partitionBy(*by, "_chunk").orderBy(order)
    tails = df.groupBy(*by, "_chunk").agg(F.max_by("_v", order).alias("_tail"))
    carry = tails.withColumn("_carry", F.lag("_tail").over(Window.partitionBy(*by).orderBy("_chunk"))).drop("_tail")
    return _join(df.withColumn("_local", F.lag("_v").over(w)), carry, by).withColumn(out, F.coalesce("_local", "_carry")["v"]).drop("_local", "_carry", "_chunk", "_v")
