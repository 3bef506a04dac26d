"""Evolving a stream: a rewrite is a projection and applies to batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.rewrite import Rewrite


def evolve(stream: DataFrame, rewrite: Rewrite, path: str, checkpoint: str) -> StreamingQuery:
    """Rows of ``stream`` in their new shape, appended to Parquet files; each row once, by the checkpoint."""
    return (
        rewrite.apply(stream).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
