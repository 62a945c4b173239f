"""Sources and sinks: written to the shared folder and read back, checked against the rows that should be there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import search as S
from ..operators import turns
from ..plans.ingest import chunk_documents
from ..session import checkpointed, shared_folder
from ..sources import chunk_files
from ..sources.collection import Collection, read_or_build
from ..streaming.ingest import ingest_stream
from . import query
from .derived import table
from .search_queries import ANN, vectors
from .text_queries import FLAT_SQL, flat_notes


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("numbered_turns", """SELECT user_id AS conv_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS turn FROM events""")
def numbered_turns(spark, sf):
    """Places of a user's events, by ids that have gaps."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), "event_id")
    return turns.number_turns(events, "event_id").select("conv_id", "event_id", "turn")


def _versions(spark, sf: str, version: str, where: str = "true") -> DataFrame:
    """Documents as chunks of one version."""
    return table(spark, sf, "documents").where(where).select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.concat(F.lit(version), F.md5("text")).alias("text"),
        (F.col("doc_id") % 3 == 0).alias("is_urgent"), (F.col("doc_id") % 2 == 0).alias("has_recommendation"))


@query("collection_upsert", """SELECT 'c' || doc_id AS chunk_id, CASE lang WHEN 'de' THEN 'stream ' WHEN 'en' THEN 'later ' ELSE 'first ' END || md5(text) AS text,
  doc_id % 3 = 0 AS is_urgent FROM documents""")
def collection_upsert(spark, sf):
    """Two appends, the second with each id twice, then a stream's first batch, and that batch replayed."""
    store = Collection(spark, _folder(spark, "upsert"))
    store.append(_versions(spark, sf, "first "))
    store.append(_versions(spark, sf, "early ", "lang = 'en'").union(_versions(spark, sf, "later ", "lang = 'en'")))
    for version in ("lost ", "stream "):
        store.append(_versions(spark, sf, version, "lang = 'de'"), batch=0, writer="stream-a")
    return store.read().select("chunk_id", "text", "is_urgent")


@query("ingest_stream_rows", "SELECT doc_id, true AS once, true AS embedded, true AS as_batch FROM documents")
def ingest_stream_rows(spark, sf):
    """Documents streamed into a collection, the first epoch replayed as after a lost commit; per document: every chunk is there
    once and has a vector, and the chunks are those of the batch form (none for a text too short for one)."""
    store, state = Collection(spark, _folder(spark, "streamed")), _folder(spark, "stream-state")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    source = _folder(spark, "stream-source")
    docs.write.parquet(source)
    for _ in range(2):
        ingest_stream(spark.readStream.schema(docs.schema).parquet(source), store, state, dim=8).awaitTermination()
        commit = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/commits/0")
        commit.getFileSystem(spark._jsc.hadoopConfiguration()).delete(commit, False)

    def per_document(chunks, mark):
        rows = chunks.select(F.split("chunk_id", "_")[1].cast("long").alias("doc_id"), "chunk_id", F.xxhash64("chunk_id", "text", "section").alias("h"), mark)
        return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("ids"),
                                          F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.min("vector").alias("embedded"))
    streamed = per_document(store.read(), F.col("embedding").isNotNull().alias("vector"))
    batch = per_document(chunk_documents(docs), F.lit(True).alias("vector")).select("doc_id", F.col("n").alias("m"), F.col("h").alias("g"))
    return docs.select("doc_id").join(streamed, "doc_id", "left").join(batch, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("n") == F.col("ids"), F.lit(True)).alias("once"), F.coalesce("embedded", F.lit(True)).alias("embedded"),
        (F.col("n").eqNullSafe(F.col("m")) & F.col("h").eqNullSafe(F.col("g"))).alias("as_batch"))


def _steps(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "step string, added long, urgent long, recommendations long, held long")


_COUNTS_SQL = "count(*) AS added, count(*) FILTER (doc_id % 3 = 0) AS urgent, count(*) FILTER (doc_id % 2 = 0) AS recommendations"


@query("guarded_ingest", f"""WITH a AS (SELECT {_COUNTS_SQL}, count(*) AS held FROM documents), f AS (SELECT {_COUNTS_SQL}, count(*) AS held FROM documents WHERE lang = 'fr')
SELECT 'empty' AS step, * FROM a UNION ALL SELECT 'full', 0, 0, 0, held FROM a UNION ALL SELECT 'forced', * FROM f""")
def guarded_ingest(spark, sf):
    store, out = Collection(spark, _folder(spark, "guarded")), []
    for step, where, force in (("empty", "true", False), ("full", "true", False), ("forced", "lang = 'fr'", True)):
        told = store.ingest(_versions(spark, sf, "", where), force)
        out.append((step, told["added"], told["urgent"], told["recommendations"], store.count()))
    return _steps(spark, out)


@query("collection_clear", f"""WITH a AS (SELECT {_COUNTS_SQL}, count(*) AS held FROM documents), f AS (SELECT {_COUNTS_SQL}, count(*) AS held FROM documents WHERE lang = 'fr')
SELECT 'append' AS step, * FROM a UNION ALL SELECT 'clear', 0, 0, 0, 0 UNION ALL SELECT 'again', * FROM f UNION ALL SELECT 'reset', 0, 0, 0, 0""")
def collection_clear(spark, sf):
    store, out = Collection(spark, _folder(spark, "clear")), []
    for step, do in (("append", lambda: store.append(_versions(spark, sf, ""))), ("clear", store.clear),
                     ("again", lambda: store.append(_versions(spark, sf, "", "lang = 'fr'"))), ("reset", store.reset)):
        told = do() or {"added": 0, "urgent": 0, "recommendations": 0}
        out.append((step, told["added"], told["urgent"], told["recommendations"], store.count()))
    return _steps(spark, out)


_FLAT_FIELDS = ["chunk_id", "page_start", "page_end", "section", "content_type", "cancer_types", "symptoms", "urgency"]


@query("json_chunks", f"WITH {FLAT_SQL} SELECT {', '.join(_FLAT_FIELDS)}, md5(text) AS text_md5 FROM flat")
def json_chunks(spark, sf):
    """Flat chunks written as JSON lines and read back by the chunk source."""
    folder = _folder(spark, "json")
    flat_notes(spark, sf).write.json(folder)
    return chunk_files.read_chunks_json(spark, folder, multiline=False).select(*_FLAT_FIELDS, F.md5("text").alias("text_md5"))


@query("embedded_sink", f"""WITH {FLAT_SQL} SELECT fmt, chunk_id, symptoms, md5(text) AS text_md5, CAST(4 AS INTEGER) AS dims, CAST(1 AS DOUBLE) AS length, true AS metadata_enhanced
FROM flat, (VALUES ('json'), ('parquet')) f(fmt)""")
def embedded_sink(spark, sf):
    """Chunks with vectors, written in both formats and read back."""
    rows, out = checkpointed(flat_notes(spark, sf).withColumn("embedding", V.text_vector(F.col("text"), 4))), None
    for fmt in ("json", "parquet"):
        folder = _folder(spark, fmt)
        chunk_files.write_embedded(rows, folder, fmt)
        back = chunk_files.read_embedded(spark, folder, fmt).select(
            F.lit(fmt).alias("fmt"), "chunk_id", "symptoms", F.md5("text").alias("text_md5"), F.size("embedding").alias("dims"),
            F.round(V.norm(F.col("embedding")), 6).alias("length"), "metadata_enhanced")
        out = back if out is None else out.union(back)
    return out


@query("markdown_files", f"""WITH {FLAT_SQL} SELECT 'ng12_' || chunk_id AS chunk_id, replace(cancer_types, ',', ', ') AS cancer_types,
  replace(symptoms, ',', ', ') AS symptoms, urgency, CASE WHEN section <> '' THEN section ELSE 'N/A' END AS section FROM flat""")
def markdown_files(spark, sf):
    """Chunks written as Markdown files and their metadata read from them."""
    folder = _folder(spark, "markdown")
    chunk_files.write_chunks_markdown(flat_notes(spark, sf).withColumn("chunk_id", F.concat(F.lit("ng12_"), "chunk_id")), folder)
    return chunk_files.read_chunks_markdown(spark, folder)


@query("read_or_build", """SELECT 'built' AS step, count(*) AS held FROM documents UNION ALL SELECT 'reused', count(*) FROM documents
UNION ALL SELECT 'forced', count(*) FROM documents WHERE lang = 'en'""")
def read_or_build_steps(spark, sf):
    """A stage built, reused although another content is offered, and built again on force."""
    folder, out = _folder(spark, "stage"), []
    for step, where, force in (("built", "true", False), ("reused", "lang = 'en'", False), ("forced", "lang = 'en'", True)):
        out.append((step, read_or_build(spark, folder, lambda: _versions(spark, sf, "", where), force).count()))
    return spark.createDataFrame(out, "step string, held long")


@query("ann_recall", """SELECT 0::BIGINT AS wrong_scores, count(*) AS answered_in_full, true AS recall_reached FROM embeddings""")
def ann_recall(spark, sf):
    """Approximate neighbours: each score is the exact cosine, each query has five, and nine in ten of the exact ones are found."""
    q, c = vectors(spark, sf)
    found = checkpointed(S.approximate_top_k(q, c, k=5, **ANN))
    exact = S.top_k(q, c, k=5)
    sides = found.join(q.select("query_id", F.col("embedding").alias("qv")), "query_id").join(
        c.select("chunk_id", F.col("embedding").alias("cv")), "chunk_id")
    wrong = sides.where(F.abs(V.cosine(F.col("qv"), F.col("cv")) - F.col("score")) > 2e-6).count()
    full = found.groupBy("query_id").count().where(F.col("count") == 5).count()
    r = S.recall_against(found, exact).first()
    return spark.createDataFrame([(wrong, full, r["found_hits"] >= 0.9 * r["exact_hits"])], "wrong_scores long, answered_in_full long, recall_reached boolean")
