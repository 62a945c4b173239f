"""Chunking of whole corpora: one row per document, or pages of long documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import chunks as C
from ..functions import structure as S
from ..functions import tagging
from ..session import checkpointed
from .sizes import fits

PAGES_PER_PART = 64


@dataclass(frozen=True)
class ChunkSize:
    """Sizes in tokens; characters follow from ``chars_per_token``."""
    chunk: int = 512
    overlap: int = 100
    minimum: int = 100
    chars_per_token: float = 4.0
    keep_short: bool = False

    @property
    def max_chars(self) -> int:
        return int(self.chunk * self.chars_per_token)

    @property
    def overlap_chars(self) -> int:
        return int(self.overlap * self.chars_per_token)

    @property
    def min_chars(self) -> int:
        return int(self.minimum * self.chars_per_token)


def _rows(df: DataFrame, doc: str, key: Column | None) -> DataFrame:
    """Explode ``_chunks`` into linked rows; links come from the array, not from a window."""
    linked = df.withColumn("_chunks", F.transform("_chunks", lambda c, i: F.struct(
        C.chunk_id(c["text"], c["page_first"], i, key).alias("chunk_id"), c["text"].alias("text"),
        c["page_start"].alias("page_start"), c["page_end"].alias("page_end"), c["section"].alias("section"))))
    ids = F.transform("_chunks", lambda c: c["chunk_id"])
    none = F.array(F.lit(None).cast("string"))
    zipped = linked.select(doc, F.arrays_zip(
        F.col("_chunks").alias("c"),
        F.concat(none, ids).alias("p"),
        F.concat(F.slice(ids, F.lit(2), F.greatest(F.lit(0), F.size(ids) - 1)), none).alias("n")).alias("z"))
    # The outer form keeps the optimizer from pushing "array not empty" below the packing,
    # which would evaluate the packing again inside a filter.
    out = zipped.select(doc, F.posexplode_outer("z").alias("chunk_index", "z")).where(F.col("z.c").isNotNull())
    return out.select(doc, "chunk_index", "z.c.*", F.col("z.p").alias("prev_chunk_id"),
                      F.col("z.n").alias("next_chunk_id"))


def chunk_texts(df: DataFrame, text: str = "text", doc: str = "doc_id", size: ChunkSize = ChunkSize(),
                page: Column | int = 0, section: Column | None = None, separator: str = r"\n\n+",
                key_by_doc: bool = True) -> DataFrame:
    """Chunk one text per row.  Row-local: no shuffle at all."""
    page = F.lit(page) if isinstance(page, int) else page
    section = section if section is not None else F.lit(None).cast("string")
    paras = F.transform(C.paragraphs(F.col(text), size.max_chars, separator), lambda p: F.struct(
        page.cast("int").alias("page"), section.alias("sec"), p.alias("text")))
    packed = (df.select(doc, paras.alias("_paras"))
              .withColumn("_packed", C.pack(F.col("_paras"), size.max_chars, size.overlap_chars))
              .select(doc, C.close(F.col("_packed"), size.min_chars, size.keep_short).alias("_chunks")))
    return _rows(packed, doc, F.col(doc) if key_by_doc else None)


def _page_paragraphs(size: ChunkSize, separator: str) -> Column:
    """Paragraphs of ``_pages``; a page's section comes first, as an entry without text."""
    def one(p: Column) -> Column:
        mark = F.array(F.struct(p["page_number"].alias("page"), p["sec"].alias("sec"),
                                F.lit(None).cast("string").alias("text")))
        body = F.transform(C.paragraphs(p["markdown"], size.max_chars, separator), lambda t: F.struct(
            p["page_number"].alias("page"), F.lit(None).cast("string").alias("sec"), t.alias("text")))
        return F.concat(mark, body)
    return F.flatten(F.transform("_pages", one))


def chunk_documents(docs: DataFrame, text: str = "text", doc: str = "doc_id", size: ChunkSize = ChunkSize(),
                    separator: str = r"\n\n+", total_pages: int = 50, key_by_doc: bool = True) -> DataFrame:
    """Chunk one document per row, by its pages.

    All pages of a document are in its row, so pages, paragraphs and packing stay in
    that row: no shuffle.  Use ``chunk_pages`` for documents that come as page rows.
    """
    def page(p: Column, i: Column) -> Column:
        kind = S.page_type(p["markdown"], p["page_number"], total_pages)
        return F.struct(i.alias("o"), p["page_number"].alias("page_number"), p["markdown"].alias("markdown"),
                        F.get(S.sections(p["markdown"]), F.lit(0)).alias("sec"), (kind == "content").alias("content"))

    split = docs.select(doc, S.split_pages(F.col(text)).alias("_split"))
    typed = split.select(doc, F.transform("_split", page).alias("_all"))
    kept = typed.select(doc, F.when(F.exists("_all", lambda p: p["content"]), F.filter("_all", lambda p: p["content"])
                                    ).otherwise(F.col("_all")).alias("_pages"))
    packed = (kept.select(doc, _page_paragraphs(size, separator).alias("_paras"))
              .withColumn("_packed", C.pack(F.col("_paras"), size.max_chars, size.overlap_chars))
              .select(doc, C.close(F.col("_packed"), size.min_chars, size.keep_short).alias("_chunks")))
    return _rows(packed, doc, F.col(doc) if key_by_doc else None)


def chunk_pages(pages: DataFrame, doc: str = "doc_id", size: ChunkSize = ChunkSize(),
                order: str = "page_number", separator: str = r"\n\n+",
                pages_per_part: int = PAGES_PER_PART, key_by_doc: bool = True) -> DataFrame:
    """Chunk documents given as page rows.

    Pages are grouped by (document, block of ``pages_per_part`` pages), so no group
    grows with a document.  A document of one part is packed and closed in place.
    The few longer ones are packed part by part in rounds (``_relay``).
    """
    part = F.floor(F.col(order) / pages_per_part).cast("long")
    is_content = F.col("content_type") == "content"
    info = pages.groupBy(doc).agg(F.min(part).alias("_lo"), F.max(part).alias("_hi"),
                                  F.max(is_content).alias("_any")).where("_lo < _hi").select(doc, "_any")
    parts = (pages.select(doc, part.alias("_part"), F.struct(
                 F.col(order).alias("o"), F.col("page_number").cast("int").alias("page_number"), "markdown",
                 F.get("sections", F.lit(0)).alias("sec"), is_content.alias("content")).alias("_page"))
             .groupBy(doc, "_part").agg(F.array_sort(F.collect_list("_page")).alias("_pages"),
                                        F.max(F.col("_page.content")).alias("_part_any")))
    # Documents of more than one part are rare; one narrow pass tells whether there are any.
    n_long = not info.isEmpty()
    if n_long:
        parts = parts.join(F.broadcast(info) if fits(info) else info, doc, "left")
    else:
        parts = parts.withColumn("_any", F.lit(None).cast("boolean"))
    use = F.coalesce(F.col("_any"), F.col("_part_any"))
    kept = parts.withColumn("_pages", F.when(use, F.filter("_pages", lambda p: p["content"])).otherwise(F.col("_pages")))
    ready = kept.select(doc, "_part", F.col("_any").isNotNull().alias("_long"),
                        _page_paragraphs(size, separator).alias("_paras"))
    key = F.col(doc) if key_by_doc else None
    short = (ready.where(~F.col("_long"))
             .withColumn("_packed", C.pack(F.col("_paras"), size.max_chars, size.overlap_chars))
             .select(doc, C.close(F.col("_packed"), size.min_chars, size.keep_short).alias("_chunks")))
    out = _rows(short, doc, key)
    if not n_long:
        return out
    return out.unionByName(_relay(ready.where("_long").drop("_long"), doc, size, key))


def _relay(parts: DataFrame, doc: str, size: ChunkSize, key: Column | None) -> DataFrame:
    """Pack the parts of long documents in parallel, exactly.

    Every part is packed from a guessed open text (none); then each part gets the
    open text its predecessor really ended with, and only parts for which that
    differs are packed again.  Cuts fall back into step within a part, so this
    settles in a few rounds; each round settles at least one more part, so the
    result is always that of packing front to back.
    """
    before = Window.partitionBy(doc).orderBy("_part")
    neighbours = parts.select(doc, "_part").withColumns({
        "_prev": F.lag("_part").over(before), "_last": F.lead("_part").over(before).isNull()})
    parts = checkpointed(parts.join(neighbours, [doc, "_part"]))

    def packed(df: DataFrame) -> DataFrame:
        return df.withColumn("_packed", C.pack(F.col("_paras"), size.max_chars, size.overlap_chars, F.col("_carry")))

    # Each round writes only what it packed; where each part's open text stands is a narrow table of its own.
    narrow = [F.col(doc), F.col("_part"), F.col("_prev"), F.col("_carry"), F.col("_packed.tail").alias("_tail")]
    rounds = [checkpointed(packed(parts.withColumn("_carry", F.lit(None).cast(C.CARRY))).drop("_paras"))]
    redone: list[DataFrame] = []
    tails = rounds[0].select(*narrow)
    while True:
        ends = tails.select(doc, F.col("_part").alias("_prev"), F.col("_tail").alias("_next"))
        changed = F.struct("_next").eqNullSafe(F.struct("_carry"))
        again = checkpointed(tails.join(ends, [doc, "_prev"], "left").where(~changed).select(doc, "_part", F.col("_next").alias("_carry")))
        if again.isEmpty():
            break
        redone.append(again.select(doc, "_part"))
        rounds.append(checkpointed(packed(parts.join(again, [doc, "_part"])).drop("_paras")))
        tails = checkpointed(tails.join(again, [doc, "_part"], "left_anti").unionByName(rounds[-1].select(*narrow)))
    state = rounds[-1]
    later = None
    for done, keys in zip(reversed(rounds[:-1]), reversed(redone)):
        later = keys if later is None else later.union(keys)
        state = state.unionByName(done.join(later, [doc, "_part"], "left_anti"))

    chunks = F.when(F.col("_last"), C.close(F.col("_packed"), size.min_chars, size.keep_short)
                    ).otherwise(F.col("_packed.chunks"))
    closed = state.select(doc, "_part", chunks.alias("_chunks"))
    offset = closed.select(doc, "_part", F.size("_chunks").alias("_n")).select(doc, "_part", F.coalesce(
        F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rows = (closed.join(offset, [doc, "_part"])
            .select(doc, "_base", F.posexplode("_chunks").alias("_pos", "c"))
            .select(doc, (F.col("_base") + F.col("_pos")).cast("int").alias("chunk_index"), "c.*"))
    rows = rows.withColumn("chunk_id", C.chunk_id(F.col("text"), F.col("page_first"), F.col("chunk_index"), key))
    ids = rows.select(doc, "chunk_index", "chunk_id")
    prev = ids.select(doc, (F.col("chunk_index") + 1).alias("chunk_index"), F.col("chunk_id").alias("prev_chunk_id"))
    nxt = ids.select(doc, (F.col("chunk_index") - 1).alias("chunk_index"), F.col("chunk_id").alias("next_chunk_id"))
    return (rows.join(prev, [doc, "chunk_index"], "left").join(nxt, [doc, "chunk_index"], "left")
            .select(doc, "chunk_index", "chunk_id", "text", "page_start", "page_end", "section",
                    "prev_chunk_id", "next_chunk_id"))


def enrich(chunks: DataFrame, lexicons: dict | None = None, chars_per_token: float = 4.0,
           run_ts: str | None = None, source: str = fixed.GUIDELINE, strict: bool = True) -> DataFrame:
    """All derived chunk columns: sizes, content type, density, tags, flags."""
    lex = {"cancer_types": fixed.CANCER_TYPES, "symptoms": fixed.SYMPTOMS, "investigations": fixed.INVESTIGATIONS, **(lexicons or {})}
    text, low = F.col("text"), "text_lower"
    # Looked up once, for the tags and for the density.
    found = {k: f"_found_{k}" for k in ("cancer_types", "symptoms", "investigations")}
    looked_up = chunks.withColumn(low, F.lower("text")).withColumns({c: tagging.found_terms(low, lex[k]) for k, c in found.items()})
    out = looked_up.withColumns({
        "section_hierarchy": C.section_hierarchy(F.col("section")),
        "content_type": tagging.content_type(text, low),
        "token_count": tagging.token_estimate(text, chars_per_token),
        "char_count": F.length("text"),
        "semantic_density": tagging.density_of(text, list(found.values())),
        "created_at": F.lit(run_ts), "source": F.lit(source),
        **tagging.tag_fields("text", lex, strict=strict),
        **{k: F.array_distinct(c) for k, c in found.items()}}).drop(low, *found.values())
    return tagging.flags(out)


LIST_FIELDS = ["cancer_types", "symptoms", "age_thresholds", "timeframes", "actions",
               "risk_factors", "investigations"]


def flatten_tags(chunks: DataFrame) -> DataFrame:
    """Array form to the flat form: comma strings, ``|`` hierarchy, no nulls."""
    joined = {c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in LIST_FIELDS}
    return chunks.withColumns({
        **joined, "section_hierarchy": F.coalesce(F.array_join("section_hierarchy", "|"), F.lit("")),
        "section": F.coalesce("section", F.lit("")), "urgency": F.coalesce("urgency", F.lit(""))})


def chunk_statistics(chunks: DataFrame, target_tokens: int = 512, chars_per_token: float = 4.0) -> DataFrame:
    """One row: count, token sums and extremes, integer average, oversize count."""
    limit = int(target_tokens * chars_per_token) * 1.1
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("total_tokens"),
        F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"),
        F.min("char_count").alias("min_chars"), F.max("char_count").alias("max_chars"),
        F.floor(F.sum("token_count") / F.count(F.lit(1))).cast("long").alias("avg_tokens"),
        F.sum((F.col("char_count") > limit).cast("int")).alias("over_limit"))


def value_shares(df: DataFrame, *columns: str) -> DataFrame:
    """``field, value, n, pct``: count and integer percentage per value of each column, in one pass over the rows.

    The totals are one row per column, joined by its name, so no task sees all values.
    """
    each = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))))
    counts = each.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("field").agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(totals), "field").select(
        "field", "value", "n", F.floor(F.col("n") * 100 / F.col("_total")).cast("long").alias("pct"))


def top_terms(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent tags of an array column."""
    return (df.select(F.explode(column).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "term").limit(k))


def _with_actual_prev(chunks: DataFrame, doc: str) -> DataFrame:
    prev = chunks.select(doc, (F.col("chunk_index") + 1).alias("chunk_index"), F.col("chunk_id").alias("actual_prev"))
    rows = chunks.select(doc, "chunk_index", "chunk_id", "prev_chunk_id", "next_chunk_id").join(
        prev, [doc, "chunk_index"], "left")
    return rows.withColumn("broken", ~F.col("prev_chunk_id").eqNullSafe(F.col("actual_prev")))


def chain_breaks(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunks whose previous id is not the id at the previous index (equi-join, no window)."""
    return _with_actual_prev(chunks, doc).where("broken").drop("broken", "next_chunk_id")


def chain_report(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row: chunks, chunks with links, broken links."""
    return _with_actual_prev(chunks, doc).agg(
        F.count(F.lit(1)).alias("chunks"), F.count("prev_chunk_id").alias("with_prev"),
        F.count("next_chunk_id").alias("with_next"), F.sum(F.col("broken").cast("int")).alias("breaks"))


def overlap_check(chunks: DataFrame, doc: str = "doc_id", window: int = 400, shared: int = 5) -> DataFrame:
    """Words shared by the end of a chunk and the start of the next (joined on index)."""
    from ..functions.text import words
    # Written once: both sides of the join would chunk the texts again.
    edges = checkpointed(chunks.select(doc, "chunk_index", "chunk_id", F.right("text", F.lit(window)).alias("_end"),
                                       F.left("text", F.lit(window)).alias("_start")))
    ends = edges.drop("_start")
    starts = edges.select(doc, (F.col("chunk_index") - 1).alias("chunk_index"), "_start")
    common = F.size(F.array_intersect(words(F.lower("_end")), words(F.lower("_start"))))
    return (ends.join(starts, [doc, "chunk_index"])
            .select(doc, "chunk_index", "chunk_id", common.alias("shared_words"),
                    (common > shared).alias("overlaps")))
