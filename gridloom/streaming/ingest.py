"""Images that arrive in a folder, turned into patterns batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridloom.sources.images import supported


def image_stream(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length and content of supported images as they appear."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).where(supported("content"))


def per_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """handle(batch, number) for what is there now and has not been handled; handle should write idempotently by batch number."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
