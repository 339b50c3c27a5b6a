"""A Structured Streaming sink: each micro-batch is one append, at most once for each batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.table import Table, TableLoader

QUERY, BATCH = "tarn.stream.query", "tarn.stream.batch"


def committed_batches(table: Table, query: str) -> set[int]:
    stats = [s.summary.stats for s in table.metadata.snapshots]
    return {int(s[BATCH]) for s in stats if s.get(QUERY) == query}


def write_stream(stream: DataFrame, url: str, query: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that appends each micro-batch to the table at url.

    The batch id is part of the snapshot's summary: a batch that is replayed after a crash, and was committed, is skipped.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        table = TableLoader(batch.sparkSession, url).load()
        if batch_id not in committed_batches(table, query):
            table.append(batch, {QUERY: query, BATCH: str(batch_id)})

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
