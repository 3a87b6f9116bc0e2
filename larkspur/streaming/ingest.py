"""Resumable ingestion as a stream, and windowed counts with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.runs import append_new


def ingest(stream: DataFrame, root: str, run: str, checkpoint: str, *, key: str = "trajectory_id") -> StreamingQuery:
    """Append each batch's rows with new keys to a run; a batch that is replayed adds nothing."""

    def save(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                append_new(batch, root, run, key=key)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_events(stream: DataFrame, *, key: str, time: str, delay: str) -> DataFrame:
    """Each key once, as long as its copies come within ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, *, time: str, by: str, width: str, delay: str) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
