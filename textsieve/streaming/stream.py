"""Streaming operators (STR-*) on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.reduce import MIN_BYTES, macro_category


def text_stream(spark: SparkSession, path: str, max_bytes: int = 65536) -> DataFrame:
    """STR-01/03: a folder of growing text files, a bounded number of bytes a trigger."""
    return spark.readStream.format("text").option("maxBytesPerTrigger", max_bytes).load(path).select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("line"))


def table_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """STR-01/04: a function for each micro-batch; without an interval all that is there is processed and the query ends."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class StreamDictionary:
    """STR-06: a dictionary that grows over batches: an append-only table; ids never change.

    New values get the numbers after the table's largest, in the order of their first appearance. A batch that
    is replayed finds its values there and adds nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        schema = "token string, id bigint, value string, category string, batch bigint"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def add(self, batch: DataFrame, number: int, value: str = "line") -> DataFrame:
        """(token, id, value, category) of the batch's values, new ones included."""
        own = batch.where(F.octet_length(value) >= MIN_BYTES["macro"]).groupBy(F.col(value).alias("value")).agg(F.min("line_no").alias("first"))
        known = self.table()
        fresh = own.join(known.select("value"), "value", "left_anti")
        start = known.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("m")).first()["m"]
        from ..operators.reduce import ranked

        made = ranked(fresh, F.col("first")).select((F.col("id") + start).alias("id"), "value").withColumns({"token": F.concat(F.lit("$M"), F.col("id").cast("string")), "category": macro_category(F.col("value")), "batch": F.lit(number).cast("bigint")})
        made.select("token", "id", "value", "category", "batch").write.mode("append").parquet(self.path)
        return self.table()


def window_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str | None = "1 day", time: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """STR-08 (an addition): tumbling or sliding event-time windows; with a watermark in streams."""
    df = events.withColumn(time, F.col(time).cast("timestamp"))
    if late and df.isStreaming:
        df = df.withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 day", time: str = "ts", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """STR-08 (an addition): session windows."""
    df = events.withColumn(time, F.col(time).cast("timestamp"))
    if late and df.isStreaming:
        df = df.withWatermark(time, late)
    return df.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


class Progress(StreamingQueryListener):
    """STR-05: start, done and error events of queries."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event):
        self.tell({"event": "start", "id": str(event.id)})

    def onQueryProgress(self, event):
        self.tell({"event": "progress", "id": str(event.progress.id), "rows": event.progress.numInputRows})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.tell({"event": "error" if event.exception else "done", "id": str(event.id)})
