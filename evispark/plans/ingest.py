"""Documents to an embedded, tagged chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.vectors import embedding_prefix, embedding_text
from ..operators import chunking, embedding


def chunk_documents(docs: DataFrame, text: str = "text", size: chunking.ChunkSize = chunking.ChunkSize(),
                    lexicons: dict | None = None, source: str = fixed.GUIDELINE, run_ts: str | None = None,
                    separator: str = r"\n\n+") -> DataFrame:
    """Pages, chunks, tags: flat rows, all inside the document's row (no shuffle)."""
    chunks = chunking.chunk_documents(docs, text, size=size, separator=separator)
    return chunking.flatten_tags(chunking.enrich(chunks, lexicons, size.chars_per_token, run_ts, source))


def embed_chunks(flat: DataFrame, provider: embedding.Provider | None = None, dim: int = 768,
                 include_metadata: bool = True) -> DataFrame:
    prefixed = flat.withColumn("_prefix", embedding_prefix())
    texts = prefixed.withColumn("embedding_text", embedding_text(F.col("text"), F.col("_prefix"), include_metadata))
    return embedding.attach(texts.drop("_prefix"), provider=provider, dim=dim).withColumn(
        "metadata_enhanced", F.lit(include_metadata)).drop("embedding_text")
