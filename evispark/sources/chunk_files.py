"""Chunk tables as JSON, Parquet and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed, schemas
from ..functions.display import citation
from ..functions.text import strip
from ..operators.validation import with_defaults


def read_chunks_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Flat chunks from JSON (array or object per file, or one object per line).

    JSON lines split over tasks; an array file is read by one task, so large corpora
    should come as many files or as lines.
    """
    raw = spark.read.schema(schemas.ddl(schemas.FLAT_CHUNK)).option("multiLine", multiline).json(path)
    return with_defaults(raw, schemas.FLAT_DEFAULTS).select(*schemas.FLAT_CHUNK)


def write_embedded(df: DataFrame, path: str, fmt: str = "json", metadata_enhanced: bool = True) -> None:
    """Nested ``{chunk, embedding, metadata_enhanced}`` rows."""
    chunk = F.struct(*[F.col(c) for c in df.columns if c not in ("embedding", "metadata_enhanced", "embedding_error")])
    nested = df.select(chunk.alias("chunk"), "embedding", F.lit(metadata_enhanced).alias("metadata_enhanced"))
    nested.write.mode("overwrite").format(fmt).save(path)


def read_embedded(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    ddl = f"chunk {schemas.struct_ddl(schemas.FLAT_CHUNK)}, embedding array<double>, metadata_enhanced boolean"
    nested = spark.read.schema(ddl).format(fmt).load(path)
    return with_defaults(nested.select("chunk.*", "embedding", "metadata_enhanced"), schemas.FLAT_DEFAULTS)


def chunk_block() -> Column:
    """A flat chunk as a Markdown block; empty tag lines are left out."""
    def listed(name: str) -> Column:
        return F.replace(F.when(F.col(name) != "", F.col(name)), F.lit(","), F.lit(", "))

    return F.concat_ws(
        "\n", F.lit("---\n"), F.concat(F.lit("## "), F.col("chunk_id"), F.lit("\n")),
        F.concat(F.lit("- **Section:** "), F.coalesce(F.nullif("section", F.lit("")), F.lit("N/A"))),
        F.concat(F.lit("- **Pages:** "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string")),
        F.concat(F.lit("- **Type:** "), F.col("content_type")),
        F.concat(F.lit("- **Tokens:** "), F.col("token_count").cast("string")),
        F.concat(F.lit("- **Urgency:** "), F.col("urgency")),
        F.concat(F.lit("- **Citation:** "), citation(F.col("page_start"), F.col("page_end"),
                                                      F.col("section_hierarchy"), F.col("section"))),
        F.concat(F.lit("- **Cancers:** "), listed("cancer_types")),
        F.concat(F.lit("- **Symptoms:** "), listed("symptoms")),
        F.concat(F.lit("\n```\n"), F.col("text"), F.lit("\n```\n")))


def write_chunks_markdown(flat: DataFrame, path: str) -> None:
    flat.select(chunk_block().alias("value")).write.mode("overwrite").text(path)


def markdown_fields(block: Column) -> dict[str, Column]:
    """Id and metadata lines of one block; a missing field is an empty string."""
    def field(name: str) -> Column:
        return strip(F.regexp_extract(block, rf"(?Ud)\*\*{name}:\*\*\s*(.+)", 1))
    return {"cancer_types": field("Cancers"), "symptoms": field("Symptoms"), "urgency": field("Urgency"),
            "section": field("Section")}


def read_chunks_markdown(spark: SparkSession, path: str, prefix: str = fixed.GUIDELINE.lower() + "_") -> DataFrame:
    """Chunk metadata from exported Markdown.

    The block header is the record separator, so files of any size split over tasks.
    Records that do not open with a chunk id (preamble, headings inside a chunk's text)
    hold no metadata lines and are dropped.
    """
    raw = spark.read.option("lineSep", "\n## ").text(path)
    chunk_id = F.regexp_extract("value", r"(?Ud)^(?:## )?(" + prefix + r"\S+)", 1)
    return raw.select(chunk_id.alias("chunk_id"), *[c.alias(n) for n, c in markdown_fields(F.col("value")).items()]
                      ).where(F.col("chunk_id") != "")


def evaluation_fields(flat: DataFrame) -> DataFrame:
    """Id and the four fields evaluation needs; the scan reads no more columns."""
    return flat.select("chunk_id", *[F.coalesce(c, F.lit("")).alias(c)
                                     for c in ("cancer_types", "symptoms", "urgency", "section")])
