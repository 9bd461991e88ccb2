"""Streaming candidates into a store: each micro-batch is one commit, replayed safely by its idempotency key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.plan import Provenance, ingest
from ..sources.store import Store


def ingest_stream(store: Store, stream: DataFrame, record_class: str, producer: str, checkpoint: str, clock_column: str | None = None) -> StreamingQuery:
    """Commit every micro-batch of a stream of candidates; a batch that is tried again after a failure is a replay."""

    def accept(batch: DataFrame, number: int) -> None:
        when = batch.agg(F.max(F.col(clock_column)).cast("string")).first()[0] if clock_column else None
        ingest(store, {record_class: batch}, Provenance(producer, f"{producer}:{number}"), when or f"micro-batch {number:012d}")

    return stream.writeStream.foreachBatch(accept).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
