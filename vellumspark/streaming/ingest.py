"""Streaming ingest: files as they arrive, each content once, and progress as events.

There is no event time in the source, so the rule is this library's own: a content that is seen again within the
watermark is dropped. The state grows with the contents of that time, not with the whole stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ingest import hashed

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, watermark: str = "1 day") -> DataFrame:
    """Files of a folder as a stream, without repeated contents."""
    read = spark.readStream.format("binaryFile").schema(_BINARY).load(path)
    return hashed(read).withWatermark("modified", watermark).dropDuplicatesWithinWatermark(["content_sha256"])


def windowed_counts(events: DataFrame, time_col: str, kind_col: str, width: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Events per kind and window of time; late ones count within the watermark."""
    return events.withWatermark(time_col, watermark).groupBy(F.window(time_col, width), kind_col).agg(F.count("*").alias("n"))


def event(kind: str, **fields: Column) -> Column:
    """An event as a JSON text."""
    return F.to_json(F.struct(F.lit(kind).alias("tipo"), *(v.alias(k) for k, v in fields.items())))


def write_events(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start writing a stream's rows to a folder as lines of JSON, each once; gives the running query."""
    lines = stream.select(F.to_json(F.struct("*")).alias("value"))
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
