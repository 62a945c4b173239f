import random
import re

import pytest
from pyspark.sql import functions as F

from evispark.functions import chunks as C
from evispark.operators import chunking as K
from evispark.operators import embedding

SIZE = K.ChunkSize(chunk=50, overlap=10, minimum=10)


def brute_pack(entries, size):
    """Straight loop over (page, section or None, text or None)."""
    out, cur, pages, sec = [], "", [], None
    for page, section, text in entries:
        sec = section or sec
        if text is None:
            continue
        if cur and len(cur) + len(text) > size.max_chars:
            out.append((cur, pages[0], min(pages), max(pages), sec))
            tail = cur if len(cur) <= size.overlap_chars else re.sub(
                r"\A[^.!?]*[.!?]\s+", "", cur[-size.overlap_chars:]).strip()
            cur, pages = (tail + "\n\n" if tail else "") + text, [page]
        else:
            cur = cur + "\n\n" + text if cur else text
            pages = pages if page in pages else [*pages, page]
    if len(cur) >= size.min_chars:
        out.append((cur, pages[0], min(pages), max(pages), sec))
    return out


def random_pages(n_docs, max_pages, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    rows = []
    for d in range(n_docs):
        kinds = ["content"] * 5 + ["toc"] if d % 4 else ["toc"]
        for p in range(rng.randint(1, max_pages)):
            paras = [" ".join(word() for _ in range(rng.randint(1, 30))) + rng.choice([".", "!", ""]) for _ in range(rng.randint(0, 4))]
            sections = [f"{d}.{p} Title"] if rng.random() < 0.3 else []
            rows.append((d, p + 1, "\n\n".join(paras), sections, rng.choice(kinds)))
    return rows


SCHEMA = "doc_id long, page_number int, markdown string, sections array<string>, content_type string"


@pytest.mark.parametrize("pages_per_part", [1000, 3])
def test_pages_match_brute_force(spark, pages_per_part):
    rows = random_pages(25, 20, seed=5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = K.chunk_pages(df, size=SIZE, pages_per_part=pages_per_part).orderBy("doc_id", "chunk_index").collect()
    paras = {(r.doc_id, r.page_number): r.p for r in df.select(
        "doc_id", "page_number", C.paragraphs(F.col("markdown"), SIZE.max_chars).alias("p")).collect()}
    expected = []
    for d in range(25):
        pages = [r for r in rows if r[0] == d]
        content = [r for r in pages if r[4] == "content"] or pages
        entries = [e for r in content for e in [(r[1], r[3][0] if r[3] else None, None),
                                                *[(r[1], None, t) for t in paras[(d, r[1])]]]]
        expected += [(d, i, *c) for i, c in enumerate(brute_pack(entries, SIZE))]
    assert [(r.doc_id, r.chunk_index, r.text, r.page_start, r.page_end, r.section) for r in got] == [
        (e[0], e[1], e[2], e[4], e[5], e[6]) for e in expected]
    assert K.chain_breaks(K.chunk_pages(df, size=SIZE, pages_per_part=pages_per_part)).count() == 0


def test_one_document_with_most_pages(spark):
    """A hot document in many parts gives the chunks of one pass."""
    rng = random.Random(1)
    rows = [(7, p, ". ".join("w" * rng.randint(3, 60) for _ in range(rng.randint(1, 6))), [], "content") for p in range(300)]
    df = spark.createDataFrame(rows + random_pages(5, 3, seed=2), SCHEMA)
    whole = K.chunk_pages(df, size=SIZE, pages_per_part=10**6)
    parts = K.chunk_pages(df, size=SIZE, pages_per_part=16)
    assert whole.count() == parts.count()
    assert whole.exceptAll(parts).count() == 0


def test_paragraph_groups(spark):
    text = "intro\n\n# 1.1 Head\n\nbody\n\nOffer a test\n\ncriteria\n| a |\n| b |\nafter"
    got = spark.createDataFrame([(text,)], "t string").select(C.paragraphs(F.col("t"), 2048)).first()[0]
    assert got == ["intro", "# 1.1 Head\n\nbody", "Offer a test\n\ncriteria\n\n| a |\n| b |\n\nafter"]


def test_table_protection(spark):
    cases = {"a\n| x |\n| y |\nb": "a\n\n| x |\n| y |\n\nb", "| x |": "| x |", "a\n\n| x |": "a\n\n| x |", "no table": "no table"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(C.protect_tables(F.col("t"))).collect()] == list(cases.values())


def test_short_and_oversize_texts(spark):
    df = spark.createDataFrame([(1, "tiny"), (2, "x" * 900)], "doc_id long, text string")
    assert [(r.doc_id, len(r.text)) for r in K.chunk_texts(df, size=SIZE).collect()] == [(2, 900)]
    kept = K.ChunkSize(50, 10, 10, keep_short=True)
    assert {r.doc_id for r in K.chunk_texts(df, size=kept).collect()} == {1, 2}


def test_chunk_id_and_hierarchy(spark):
    df = spark.createDataFrame([("1.2.3 T", 5), ("Appendix", 12345), (None, 0)], "s string, i int")
    rows = df.select(C.section_hierarchy(F.col("s")).alias("h"), C.chunk_id(F.lit("abc"), F.lit(7), F.col("i")).alias("id")).collect()
    assert [r.h for r in rows] == [["1", "1.2", "1.2.3"], ["Appendix"], []]
    assert rows[0].id.startswith("ng12_p7_0005_") and rows[1].id.startswith("ng12_p7_12345_")
    import hashlib
    assert rows[0].id.endswith(hashlib.md5(b"abc_7_5").hexdigest()[:8])


def test_documents_and_pages_agree(spark):
    body = "\n\n".join(f"<!-- Page {p} -->\n## 1.{p} Head\n\n" + "Some words here. " * 20 for p in range(1, 30))
    docs = spark.createDataFrame([(1, body), (2, body[:500]), (3, "")], "doc_id long, text string")
    from evispark.operators import pages as P
    a = K.chunk_documents(docs, size=SIZE)
    b = K.chunk_pages(P.to_pages(docs), size=SIZE, order="page_ordinal", pages_per_part=4)
    assert a.count() > 10 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_token_batches(spark):
    lengths = [4000, 8000, 8000, 70000, 40, 40, 59000, 4]
    df = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate(lengths)], "doc string, i long, text string")
    starts = embedding.batch_starts([n // 4 for n in lengths], 15000)
    for span in (4096, 3, 1):   # parts of any size give what one pass gives
        got = {r.i: r.batch for r in embedding.token_batches(df, "doc", "i", span=span).collect()}
        assert [got[i] for i in range(len(lengths))] == [sum(s <= i for s in starts) - 1 for i in range(len(lengths))]


def test_provider_failure_keeps_rows(spark):
    def provider(texts, mode):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "good"), (2, "x" * 60000 + "bad"), (3, "fine")], "i int, text string").coalesce(1)
    rows = {r.i: r for r in embedding.attach(df, "text", provider).collect()}
    assert rows[3].embedding == [4.0] and rows[2].embedding is None and "refused" in rows[2].embedding_error
    assert len(rows) == 3


def test_long_texts_take_linear_time(spark):
    """40,000 paragraphs in one document: the old folds took minutes."""
    import time
    from evispark.functions import structure as S
    n = 40_000
    headers = spark.createDataFrame([(1, "\n\n".join(f"## 1.{i} Head" for i in range(n)))], "doc_id long, text string")
    plain = spark.createDataFrame([(1, "word " * (n * 20))], "doc_id long, text string")
    begun = time.time()
    assert headers.select(F.size(C.paragraphs(F.col("text"), 1000))).first()[0] == n
    pages = plain.select(S.split_by_length(F.col("text")).alias("p")).select(F.inline("p")).collect()
    assert " ".join(p.markdown for p in pages).split() == ["word"] * (n * 20) or sum(len(p.markdown.replace(" ", "")) for p in pages) == n * 80
    assert time.time() - begun < 60


def test_provider_holds_few_megabytes(spark):
    """Texts go to the provider's task by bytes: 60 MB in one partition are never in one batch."""
    import sys

    def provider(texts, mode):
        held = sys._getframe(1).f_locals["texts"]   # of the batch that is worked on
        return [[float(sum(map(len, held)))] for _ in texts]

    df = spark.range(3000, numPartitions=1).select("id", F.repeat(F.lit("x"), 20_000).alias("text"))
    row = embedding.attach(df, "text", provider).agg(F.count("*"), F.max(F.get("embedding", F.lit(0))), F.count("embedding_error")).first()
    assert row[0] == 3000 and row[1] < 16 << 20 and row[2] == 0
