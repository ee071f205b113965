"""A stream of writes into an index, refreshed after every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from lexispark.operators.engine import Engine


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, interval: str | None = None, refresh: bool = True) -> StreamingQuery:
    """Start writing ``stream`` (_id, _source and optionally op) to the engine's log.

    A batch that runs again after a failure replaces what it had written, so every row counts once. Without an
    interval the stream runs over what is available and stops.
    """

    def write(batch: DataFrame, number: int) -> None:
        engine.append(batch, name=f"stream-{number}")
        if refresh:
            engine.refresh()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
