"""Incremental ingest: new documents to an upserted chunk collection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.chunking import ChunkSize
from ..plans.ingest import chunk_documents, embed_chunks
from ..sources.collection import Collection


def ingest_stream(docs: DataFrame, collection: Collection, checkpoint: str, size: ChunkSize = ChunkSize(),
                  dim: int = 64, **trigger):
    """Write every micro-batch of ``doc_id, text`` rows as one batch of the collection.

    The writer is the stream, by the id that its checkpoint keeps, and the batch number its epoch: a replayed epoch
    overwrites itself, and neither another stream nor an append is touched.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        chunks = embed_chunks(chunk_documents(batch, size=size), dim=dim)
        collection.append(chunks.drop("embedding_error"), batch=epoch, writer=f"stream-{stream}")

    return (docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
