"""Plans keep work where it belongs: pushed filters, pruned columns, no needless shuffle."""

import pytest
from pyspark.sql import functions as F

from evispark.functions.predicates import compile_filter
from evispark.operators import chunking, lookups, search, triage
from evispark.operators import turns as conv

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tagging_and_chunking_do_not_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (chunking.chunk_texts(docs), chunking.enrich(chunking.chunk_documents(docs))):
        assert "Exchange" not in plan(df) and "Python" not in plan(df)


def test_triage_does_not_shuffle(spark):
    df = spark.createDataFrame([(1, 40, ["cough"], [])], "id int, age int, symptoms array<string>, risk_factors array<string>")
    text = plan(triage.assess(df))
    assert "Exchange" not in text and "Join" not in text


def test_metadata_filter_reaches_the_scan(spark):
    c = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "chunk_id")
    q = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "query_id")
    text = plan(search.top_k(q, c, 3, where=compile_filter({"label": {"$gte": 3}}, c.columns)))
    assert "PushedFilters: [IsNotNull(label), GreaterThanOrEqual(label,3)" in text
    assert "WindowGroupLimit" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_prefix_is_pushed_and_columns_are_pruned(spark, tmp_path):
    rows = [(f"c{i}", "text", f"{i % 3}|{i % 3}.1", True, False, False, "a") for i in range(9)]
    cols = "chunk_id string, text string, section_hierarchy string, is_urgent boolean, has_recommendation boolean, has_table boolean, urgency string"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "flat"))
    flat = spark.read.parquet(str(tmp_path / "flat"))
    assert "StringStartsWith(section_hierarchy,1|1)" in plan(lookups.in_section(flat, "1|1", exact=False))
    stats = plan(lookups.statistics(flat))
    assert "ReadSchema: struct<is_urgent:boolean,has_recommendation:boolean,has_table:boolean>" in stats


def test_one_shuffle_for_history(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert plan(conv.history_text(turns)).count("Exchange hashpartitioning") == 1


def test_page_lookup_is_an_equi_join(spark):
    flat = spark.createDataFrame([("c", 1, 3)], "chunk_id string, page_start int, page_end int")
    text = plan(lookups.on_pages(flat, spark.createDataFrame([(2,)], "page int")))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text


@pytest.mark.parametrize("n, copies", [(50, 0), (60, 40)])
def test_upsert_keeps_newest_of_many_copies(spark, tmp_path, n, copies):
    from evispark.sources.collection import Collection
    store = Collection(spark, str(tmp_path / "c"))
    for batch in range(2):
        rows = [(f"c{i}", f"b{batch}", False, False) for i in range(n)] + [("hot", f"b{batch}", False, False)] * copies
        store.append(spark.createDataFrame(rows, "chunk_id string, text string, is_urgent boolean, has_recommendation boolean"))
    got = store.read()
    assert got.count() == n + (1 if copies else 0) and got.where(F.col("text") != "b1").count() == 0


def test_a_vector_is_computed_once(spark):
    """However often it is used: by its norm, by the result and by the search."""
    from evispark.functions.vectors import text_vector
    from evispark.operators import search as S

    def uses(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("md5(")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "chunk_id long, text string")
    vectors = texts.withColumn("embedding", text_vector(F.col("text"), 8))
    queries = vectors.withColumnRenamed("chunk_id", "query_id")
    assert uses(vectors) == 2   # the text's digest and its components
    assert uses(S.top_k(queries, vectors, 3)) == 2


def test_runs_are_graded_without_pairs(spark):
    """The metrics' plan has no join of queries with chunks by tag other than over signatures."""
    from evispark.operators import evaluation as E
    queries = spark.createDataFrame([(1, ["a"], ["x", "y"], "u"), (2, ["b"], [], None)], "query_id long, cancers array<string>, symptoms array<string>, urgency string")
    chunks = spark.createDataFrame([(i, ["a"] if i % 2 else ["b", "a"], ["x", "y"][:i % 3], "u" if i % 5 else "v") for i in range(200)],
                                   "chunk_id long, cancer_types array<string>, symptoms array<string>, urgency string")
    run = spark.createDataFrame([(q, r, (q * 37 + r * 11) % 220) for q in (1, 2) for r in range(1, 6)], "query_id long, rank int, chunk_id long")
    pairs = E.per_query_metrics(run, E.build_qrels(queries, chunks), 3, queries=queries)
    graded = E.graded_metrics(E.grade_run(run, queries, chunks), E.grade_counts(queries, chunks), queries, 3)
    assert sorted(map(str, graded.collect())) == sorted(map(str, pairs.collect()))
    best = E.build_qrels(queries, chunks)
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "chunk_id")
    want = best.withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("query_id", "rank", "chunk_id")
    assert sorted(map(str, E.best_chunks(queries, chunks, 4).collect())) == sorted(map(str, want.collect()))


def test_clinical_conditions_tag_the_texts_once(spark):
    from evispark.catalog.lookup_queries import clinical_conditions
    plan = clinical_conditions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan


def test_overlap_check_chunks_texts_once(spark):
    """The plan of its result begins at written chunks: no document is read and packed for either side of the join."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(chunking.overlap_check(chunking.chunk_texts(docs)))
    assert "FileScan" not in text and "Generate" not in text
