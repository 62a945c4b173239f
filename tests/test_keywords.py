"""BM25 search against a plain one, its blocks, and rank fusion; page lookups by dyadic nodes."""

import math
import os
import random
import re

import pytest
import pyspark.sql.functions as F

from evispark.operators import keywords, lookups


def plain_search(chunks, queries, k):
    words = {c: re.findall(r"[^\W_]+", (t or "").lower()) for c, t in chunks}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = {}
    for ws in words.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = []
    for q, text in queries:
        scores = []
        for c, ws in words.items():
            asked = [w for w in dict.fromkeys(re.findall(r"[^\W_]+", (text or "").lower())) if w in ws]
            if asked:
                s = sum(math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (.25 + .75 * len(ws) / mean)) for w in asked)
                scores.append((-round(s, 6), c))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def corpus(seed=2, n=300):
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(200)]
    chunks = [(i, " ".join(rng.choice(["the", "of", "The", "and"] if rng.random() < .6 else rare) for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    chunks += [(n, None), (n + 1, ""), (n + 2, "the the the"), (n + 3, chunks[0][1]), (n + 4, "Éa-b_c 12")]
    queries = [(i, " ".join(rng.choice(rare + ["the", "of", "unknown"]) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    return chunks, queries + [(100, None), (101, ""), (102, "the THE of"), (103, "éa 12 C")]


@pytest.mark.parametrize("block_rows", [1024, 8])
def test_keyword_search(spark, block_rows):
    chunks, queries = corpus()
    index = keywords.build_index(spark.createDataFrame(chunks, "chunk_id long, text string"), block_rows=block_rows)
    got = keywords.keyword_search(spark.createDataFrame(queries, "query_id long, query string"), index, 7)
    want = plain_search(chunks, queries, 7)
    rows = sorted(map(tuple, got.collect()))
    assert [r[:3] for r in rows] == [w[:3] for w in want]
    assert all(abs(r[3] - w[3]) < 2e-6 for r, w in zip(rows, want))
    if block_rows == 8:
        assert index.postings.groupBy("term", "level", "block").count().agg({"count": "max"}).first()[0] < 40      # stop words too
        assert index.blocks.where("term = 'the'").agg({"blocks": "sum"}).first()[0] > 20


def test_stored_index(spark, tmp_path):
    chunks, queries = corpus(5, 60)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    index = keywords.build_index(spark.createDataFrame(chunks, "chunk_id long, text string"))
    stored = index.write(f"{tmp_path}/index")
    again = keywords.KeywordIndex.read(spark, f"{tmp_path}/index")
    want = sorted(map(tuple, keywords.keyword_search(asked, index).collect()))
    assert want and want == sorted(map(tuple, keywords.keyword_search(asked, stored).collect())) == sorted(map(tuple, keywords.keyword_search(asked, again).collect()))


def test_empty_sides(spark):
    chunks, queries = corpus(5, 20)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    none = keywords.build_index(spark.createDataFrame([], "chunk_id long, text string"))
    assert keywords.keyword_search(asked, none).collect() == []
    index = keywords.build_index(spark.createDataFrame(chunks, "chunk_id long, text string"))
    assert keywords.keyword_search(asked.limit(0), index).collect() == []


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12)], "query_id long, rank int, chunk_id long")
    b = spark.createDataFrame([(1, 1, 12), (1, 2, 13), (2, 1, 10)], "query_id long, rank int, chunk_id long")
    rows = keywords.fuse({"x": a, "y": b}, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["chunk_id"], r["x_rank"], r["y_rank"], r["total_candidates"]) for r in rows] == [
        (1, 1, 12, 3, 1, 4), (1, 2, 10, 1, None, 4), (1, 3, 11, 2, None, 4), (2, 1, 10, None, 1, 1)]
    assert rows[0]["score"] == round(1 / 63 + 1 / 61, 9)


def test_pages_by_dyadic_nodes(spark):
    rng = random.Random(3)
    ranges = [(i, a, a + rng.choice([0, 1, 5, 63, 1000])) for i, a in enumerate(rng.randrange(-20, 1200) for _ in range(200))]
    ranges += [(900, None, 5), (901, 7, 3), (902, 0, 10 ** 6), (903, 5, None)]
    pages = [rng.randrange(-30, 1500) for _ in range(150)] + [None, 0, 999_999]
    chunks = spark.createDataFrame(ranges, "chunk_id int, page_start int, page_end int")
    got = lookups.on_pages(chunks, spark.createDataFrame([(p,) for p in pages], "page int"))
    want = {(c, p) for c, a, b in ranges for p in set(pages) if None not in (a, b, p) and a <= p <= b}
    rows = [(r["chunk_id"], r["page"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and got.columns == ["chunk_id", "page_start", "page_end", "page", "score"]
    cut = chunks.select("chunk_id", F.size(lookups._range_nodes(F.col("page_start"), F.col("page_end"))).alias("n"))
    assert cut.agg({"n": "max"}).first()[0] < 50


def test_long_questions_meet_the_postings_chunk_by_chunk(spark):
    rows = [(i, "common " * (i % 5 + 1) + f"word{i % 7} rare{i}") for i in range(60)]
    index = keywords.build_index(spark.createDataFrame(rows, "chunk_id long, text string"))
    asked = spark.createDataFrame([(q, "common " + " ".join(f"word{j}" for j in range(7))) for q in range(5)], "query_id long, query string")
    found = keywords.keyword_search(asked, index, 3)
    assert "LeftSemi" not in (plan := found._jdf.queryExecution().toString()) and "REPARTITION_BY_COL" in plan
    assert found.count() == 15


def test_index_and_long_questions_take_little_disk(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"c{i}", " ".join(f"w{int(rng.paretovariate(.6))}" for _ in range(80))) for i in range(3000)]
    queries = [(q, " ".join(f"w{j}" for j in range(1, 30))) for q in range(5)] + [(5, "w1"), (5, "w2 w1"), (6, "w3")]     # one id twice
    chunks = spark.createDataFrame(rows + [(None, "w1 w2 w2"), (None, "w1 w5 w6"), ("c0", rows[0][1]), ("c1", "w1 w1")], "chunk_id string, text string")
    asked = spark.createDataFrame(queries, "query_id long, query string")

    def used():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(spark.conf.get("spark.checkpoint.dir")) for f in names)
    before = used()
    index = keywords.build_index(chunks)
    assert used() - before < 20 * index.postings.count()
    monkeypatch.setattr(keywords, "TILE", 50)
    whole = keywords.keyword_search(asked, index, 7)
    assert "MapInArrow" in whole._jdf.queryExecution().toString()
    monkeypatch.setattr(keywords, "fits", lambda *_: False)
    joined = keywords.keyword_search(asked, index, 7)
    assert "MapInArrow" not in joined._jdf.queryExecution().toString()
    got, want = (sorted(map(tuple, x.collect()), key=str) for x in (whole, joined))
    assert len(got) == 49 and [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want))
