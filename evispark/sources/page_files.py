"""Page exports and the audit of incoming files."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def page_block() -> Column:
    """A page with its header lines."""
    return F.concat(
        F.lit("# Page "), F.col("page_number").cast("string"), F.lit("\n\n**Type:** "), F.col("content_type"), F.lit("\n\n"),
        F.when(F.size("sections") > 0, F.concat(F.lit("**Sections:** "), F.array_join("sections", ", "), F.lit("\n\n"))
               ).otherwise(F.lit("")),
        F.lit("**Has Tables:** "), F.initcap(F.col("has_tables").cast("string")), F.lit("\n\n---\n\n"), F.col("markdown"))


def document_header(title: Column, source: Column, total_pages: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n**Source:** "), source, F.lit("\n\n**Total Pages:** "),
                    total_pages.cast("string"), F.lit("\n\n---\n\n"))


def write_pages_markdown(pages: DataFrame, path: str, folders: int = 64) -> None:
    """Pages as Markdown in ``folders`` folders by a hash of the document, however many documents there are.

    A document's pages follow each other; each begins with a comment that names document and page.
    """
    mark = F.concat(F.lit("<!-- Document "), F.col("doc_id").cast("string"), F.lit(", page "), F.col("page_number").cast("string"), F.lit(" -->\n"))
    _write_folders(pages.select("doc_id", "page_number", F.concat(mark, page_block()).alias("value")), path, folders, ["doc_id", "page_number"])


def write_documents_markdown(docs: DataFrame, path: str, folders: int = 64) -> None:
    """Whole documents (``doc_id, title, source, total_pages, markdown``), in folders likewise."""
    text = F.concat(document_header(F.col("title"), F.col("source"), F.col("total_pages")), F.col("markdown"))
    _write_folders(docs.select("doc_id", text.alias("value")), path, folders, ["doc_id"])


def _write_folders(rows: DataFrame, path: str, folders: int, order: list[str]) -> None:
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(folders))
    (rows.withColumn("bucket", bucket).repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
     .select("bucket", "value").write.mode("overwrite").partitionBy("bucket").text(path))


#: Files up to so many bytes are one value of the source each, read and digested in a task.
WHOLE = 128 << 20


def _streamed(spark: SparkSession, path: str, length: int, head: int) -> tuple[str, int, str, str]:
    """Path, length, first bytes and SHA-256 of a file of any size, read as a stream by the JVM through the path's own store.

    The digest is a chain over all bytes, so a file is one reader's work in any case; no task can read it but as one value.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    begin = store.open(where)
    try:
        first = bytes(max(begin.read(), 0) for _ in range(head)).hex().upper()
    finally:
        begin.close()
    stream = store.open(where)
    try:
        return path, length, first, spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def audit_files(spark: SparkSession, path: str, magic: bytes = b"%PDF-", min_bytes: int = 1000,
                expected_sha256: str | None = None, glob: str = "*") -> DataFrame:
    """Size, file type and checksum of every file.  A checksum that differs only warns.

    Files of more than ``WHOLE`` bytes, which would be one value of a task each (2 GiB at most), are read as streams, a few at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    large = files.where(F.col("length") > WHOLE).select("path", "length").collect()     # names only
    seen = files.where(F.col("length") <= WHOLE).select("path", "length", F.hex(F.substring("content", 1, len(magic))).alias("head"),
                                                        F.sha2("content", 256).alias("sha256"))
    if large:
        with ThreadPool(min(4, len(large))) as readers:
            rows = readers.map(lambda f: _streamed(spark, f["path"], f["length"], len(magic)), large)
        seen = seen.union(spark.createDataFrame(rows, "path string, length long, head string, sha256 string"))
    out = seen.select("path", "length", (F.col("length") >= min_bytes).alias("size_ok"), (F.col("head") == magic.hex().upper()).alias("magic_ok"), "sha256")
    differs = F.lit(False) if expected_sha256 is None else F.col("sha256") != expected_sha256
    return out.withColumns({"valid": F.col("size_ok") & F.col("magic_ok"), "checksum_warning": differs})
