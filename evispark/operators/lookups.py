"""Chunk lookups, neighbours, statistics, citations and context texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.display import citation, snippet
from ..functions.tagging import parse_tag_field
from ..session import checkpointed
from .sizes import join_checked


def _range_nodes(first: Column, last: Column) -> Column:
    """The fewest dyadic nodes (level, number) that cover a range of whole numbers: at most two of each level."""
    def of(level: Column) -> Column:
        size = F.lit(1).cast("long") * F.pow(F.lit(2.0), level).cast("long")
        low, high = F.ceil(first / size), F.floor((last + 1) / size)
        return F.array_compact(F.array(
            F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), F.struct(level.alias("level"), low.cast("long").alias("node"))),
            F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), F.struct(level.alias("level"), (high - 1).cast("long").alias("node")))))
    top = F.floor(F.log2((last - first + 1).cast("double"))).cast("int")
    return F.when(first <= last, F.flatten(F.transform(F.sequence(F.lit(0), top), of)))


def _ancestors(page: Column, levels: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(
        level.alias("level"), F.floor(page / F.pow(F.lit(2.0), level)).cast("long").alias("node")))


def on_pages(chunks: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = (), levels: int = 31) -> DataFrame:
    """Chunks covering the wanted ``page`` (per document, with ``keys``).

    The range condition becomes an equi-join: a chunk's range of n pages is cut into at most 2 log n dyadic nodes, a wanted page
    stands for the nodes above it, and they share exactly one if the chunk covers the page.  Ranges without an end, or that end
    before they begin, cover nothing.  Score is 1.0, as this is not a similarity search.
    """
    at = ["_level", "_number"]
    covered = chunks.select("*", F.inline(_range_nodes(F.col("page_start"), F.col("page_end"))).alias(*at))
    asked = wanted.select(*keys, "page").distinct().select("*", F.inline(_ancestors(F.col("page"), levels)).alias(*at))
    return join_checked(covered, asked, [*keys, *at]).drop(*at).withColumn("score", F.lit(1.0))


def section_hit(number: str | Column, exact: bool = True) -> Column:
    """Whether a row of the flat table is of the section.

    ``exact`` matches an element of the hierarchy; otherwise the hierarchy string has
    to start with the prefix, which Parquet can filter on.
    """
    number = F.lit(number) if isinstance(number, str) else number
    return (F.contains(F.concat(F.lit("|"), "section_hierarchy", F.lit("|")), F.concat(F.lit("|"), number, F.lit("|")))
            if exact else F.col("section_hierarchy").startswith(number))


def in_section(chunks: DataFrame, number: str | Column, exact: bool = True) -> DataFrame:
    """Chunks of a section of the flat table."""
    return chunks.where(section_hit(number, exact)).withColumn("score", F.lit(1.0))


def sections_of(chunks: DataFrame, wanted: DataFrame, k: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """First ``k`` chunks of each wanted section (``section_number``), by chunk index."""
    order = [*(c for c in ("doc_id", "chunk_index") if c in chunks.columns), "chunk_id"]
    levels = chunks.withColumn("section_number", F.explode(F.split("section_hierarchy", r"\|")))
    hits = join_checked(levels, wanted.select(*keys, "section_number").distinct(), [*keys, "section_number"])
    w = Window.partitionBy(*keys, "section_number").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", F.lit(1.0))


def section_texts(chunks: DataFrame, wanted: DataFrame, k: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Joined text of each wanted section, or an error text where there is none.

    At most ``k`` chunks make up a section's text, so the list collected is bounded.
    """
    hits = sections_of(chunks, wanted, k, keys)
    by = [*keys, "section_number"]
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    joined = hits.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("content"),
                                   F.count(F.lit(1)).alias("chunks_count"))
    missing = F.concat(F.lit("Section "), F.col("section_number"), F.lit(" not found"))
    return (wanted.select(*by).distinct().join(joined, by, "left")
            .withColumn("error", F.when(F.col("content").isNull(), missing)).fillna(0, ["chunks_count"]))


def by_id(chunks: DataFrame, wanted: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row per wanted id; unknown ids give a row of nulls."""
    ids = wanted.select(key).distinct()
    return ids.join(join_checked(chunks, ids, key, "left_semi"), key, "left")


def with_neighbours(hits: DataFrame, chunks: DataFrame, hit_id: str = "chunk_id") -> DataFrame:
    """Add text of the previous and next chunk of each hit.

    The hits are written first and measured; the table's texts are read once, for the ids that the hits name, and only
    those texts meet the hits.
    """
    base = checkpointed(hits)
    if "prev_chunk_id" not in base.columns:
        own = base.select(F.col(hit_id).alias("chunk_id")).distinct()
        links = join_checked(chunks.select("chunk_id", "prev_chunk_id", "next_chunk_id"), own, "chunk_id", "left_semi")
        base = checkpointed(join_checked(base, checkpointed(links.withColumnRenamed("chunk_id", hit_id)), hit_id, "left"))
    named = base.select(F.col("prev_chunk_id").alias("chunk_id")).union(base.select("next_chunk_id")).where("chunk_id is not null").distinct()
    texts = checkpointed(join_checked(chunks.select("chunk_id", "text"), named, "chunk_id", "left_semi"))
    for link, name in (("prev_chunk_id", "prev_text"), ("next_chunk_id", "next_text")):
        base = join_checked(base, texts.select(F.col("chunk_id").alias(link), F.col("text").alias(name)), link, "left")
    return base


def statistics(chunks: DataFrame, collection: str = "guidelines", values: bool = False) -> DataFrame:
    """Totals of the flat table in one row; with ``values``, the sorted cancer types and urgency levels too (small sets by contract).

    Rows are counted per combination of tag list and urgency first; single values are made distinct before they are listed.
    """
    flags = {"urgent_chunks": "is_urgent", "recommendation_chunks": "has_recommendation", "table_chunks": "has_table"}
    counts = [F.count(F.lit(1)).alias("total_chunks"), *(F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(n) for n, c in flags.items())]
    name = F.lit(collection).alias("collection_name")
    if not values:
        return chunks.agg(name, *counts).fillna(0)
    combined = checkpointed(chunks.groupBy("cancer_types", "urgency").agg(*counts))
    types = combined.select(F.explode(parse_tag_field(F.col("cancer_types"))).alias("type")).distinct()
    levels = combined.select(F.nullif("urgency", F.lit("")).alias("level")).where("level is not null").distinct()
    rows = combined.select("total_chunks", *flags).unionByName(types, allowMissingColumns=True).unionByName(levels, allowMissingColumns=True)
    return rows.agg(name, F.coalesce(F.sum("total_chunks"), F.lit(0)).alias("total_chunks"), *(F.sum(n).alias(n) for n in flags),
                    F.array_sort(F.collect_list("type")).alias("cancer_types"), F.array_sort(F.collect_list("level")).alias("urgency_levels")).fillna(0)


def cancer_type_facet(chunks: DataFrame) -> DataFrame:
    """Distinct cancer types of the flat table with the number of chunks."""
    return (chunks.select(F.explode(parse_tag_field(F.col("cancer_types"))).alias("cancer_type"))
            .groupBy("cancer_type").agg(F.count(F.lit(1)).alias("chunks")))


def urgency_facet(chunks: DataFrame, descriptions: dict[str, str] | None = None) -> DataFrame:
    labels = descriptions or fixed.URGENCY_DESCRIPTIONS
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return (chunks.where(F.coalesce("urgency", F.lit("")) != "").groupBy("urgency")
            .agg(F.count(F.lit(1)).alias("chunks")).withColumn("description", table[F.col("urgency")]))


def with_citations(flat: DataFrame, label: str = fixed.GUIDELINE) -> DataFrame:
    return flat.withColumn("citation", citation(F.col("page_start"), F.col("page_end"), F.col("section_hierarchy"),
                                                F.col("section"), label))


def context_texts(hits: DataFrame, n: int = 5, form: str = "context") -> DataFrame:
    """Text of the first ``n`` hits per query (``query_id, rank, text, citation, page_start``).

    ``context`` heads each text with its citation; ``passages`` numbers them.
    The first n rows are cut before they are collected.
    """
    page = F.concat(F.lit("[Page "), F.col("page_start").cast("string"), F.lit("]"))
    if form == "passages":
        block = F.concat(F.lit("[Passage "), F.col("rank").cast("string"), F.lit("] ("), F.col("citation"),
                         F.lit("):\n"), F.col("text"))
        gap = "\n\n"
    else:
        head = F.when(F.col("citation") != "", F.concat(F.lit("["), "citation", F.lit("]"))).otherwise(page)
        block, gap = F.concat(head, F.lit("\n"), F.col("text")), "\n\n---\n\n"
    rows = hits.where(F.col("rank") <= n).select("query_id", F.struct("rank", block.alias("block"), "citation").alias("r"))
    ordered = F.array_sort(F.collect_list("r"))
    return rows.groupBy("query_id").agg(ordered.alias("_r")).select(
        "query_id", F.array_join(F.transform("_r", lambda r: r["block"]), gap).alias("context"),
        F.transform("_r", lambda r: r["citation"]).alias("citations"))


def snippets(hits: DataFrame, limit: int = 500) -> DataFrame:
    """Text cut for display and score to three digits."""
    return hits.withColumns({"text": snippet(F.col("text"), limit), "score": F.round("score", 3)})
