"""Upsert a stream into a keyed table, one append a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.keyed import KeyedTable


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """The table's manifest notes each batch with the rows it brings, by the checkpoint's name, so a batch that is repeated after a failure is left out."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: table.append(df, (checkpoint, n)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
