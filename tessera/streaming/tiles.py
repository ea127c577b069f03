"""Streaming extension: keep per-tile counts current as feature files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def changed_tiles(features: DataFrame, tile: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's count per tile; batches are idempotent by their number, and readers sum over batches."""

    def upsert(batch: DataFrame, number: int) -> None:
        batch.groupBy(tile).count().write.mode("overwrite").parquet(f"{out}/batch={number}")

    return features.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
