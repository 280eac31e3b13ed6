"""Streaming ingest, an extension: new documents in a folder go through the batch upsert, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions.embedding import Backend
from siltstone.operators.ingest import DOCUMENTS, ingest
from siltstone.operators.store import Store


def follow(spark: SparkSession, folder: str, store: Store, backend: Backend, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Parquet files of documents that appear in ``folder``.  Orphans need a full listing and are left to the batch."""
    docs = spark.readStream.schema(DOCUMENTS).parquet(folder)

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest(Store(spark, store.path, store.dim), batch, backend, whole_source=False)

    w = docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
