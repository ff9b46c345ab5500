"""Streaming ingest: a stream of puts and deletes, each micro-batch one commit.

A batch that is run again after a failure is recognised by its number in the
manifest and left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Index

OPERATIONS = "op string, id string, vector array<float>, attributes map<string,string>"


def apply_batch(index: Index, batch: DataFrame, number: int) -> None:
    """Stage the deletes, put the vectors, commit.  Deletes of a batch without puts wait for the next commit."""
    last = index.manifest()
    if last and last["batch"] is not None and last["batch"] >= number:
        return
    batch = batch.persist()
    try:
        gone = batch.where("op = 'delete' and id is not null").select("id")
        if gone.limit(1).count():
            index.delete(gone)
        new = batch.where("op = 'put'").select("id", "vector", "attributes")
        if new.limit(1).count():
            index.put(new)
            index.commit(batch=number)
    finally:
        batch.unpersist()


def start(index: Index, operations: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """operations: a streaming DataFrame of OPERATIONS."""
    writer = operations.writeStream.foreachBatch(lambda df, n: apply_batch(index, df, n)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def event_rates(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Operations by window and kind, of a stream or a table, with late ones up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
