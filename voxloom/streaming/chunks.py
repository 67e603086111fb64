"""Streams of events as tensors chunked in time. An extension: stores have no time of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.sources.chunkstore import write_chunks


def time_chunks(events: DataFrame, time_col: str, value: Column, width: str, late: str | None = None) -> DataFrame:
    """Count and sum of values by window of event time; with ``late``, a watermark closes windows."""
    if late:
        events = events.withWatermark(time_col, late)
    grouped = events.groupBy(F.window(time_col, width).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def upsert_stream(chunks: DataFrame, uri: str, group: str, checkpoint: str, order: str) -> StreamingQuery:
    """Writes a stream of chunk rows into a dataset, the last of each micro-batch by ``order`` winning."""

    def write(batch: DataFrame, _: int) -> None:
        write_chunks(batch, uri, group, order)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
