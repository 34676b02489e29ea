"""Continuous ingest: new chunk files are embedded and appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.embedding import Embedder, embedded
from lodestone.plans.collection import Collection
from lodestone.schema import CHUNK


def ingest_stream(spark: SparkSession, chunks_path: str, collection: Collection, embed: Embedder, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the chunks (JSON lines) of files that appear under chunks_path.

    An append costs work in its micro-batch alone.  The commit names the micro-batch, so one that
    is run again after a failure adds nothing twice.
    """
    if not collection.exists():
        collection.create()

    def append(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            collection.insert(embedded(batch, "text", embed, collection.dimension), source=f"{checkpoint}#{number}")

    stream = spark.readStream.schema(CHUNK).json(chunks_path)
    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
