import tracemalloc

import numpy as np
import pytest
from conftest import one
from pyspark.sql import functions as F

from evispark.functions import vectors as V
from evispark.functions.predicates import clinical_filter, compile_filter
from evispark.operators import search as S

rng = np.random.default_rng(3)


def frames(spark, n_queries=40, n_chunks=300, dim=8, hot=100):
    """A third of the chunks are copies of one vector; some vectors are zero."""
    c = rng.standard_normal((n_chunks, dim))
    c[:hot] = c[0]
    c[-3:] = 0
    q = np.vstack([rng.standard_normal((n_queries - 2, dim)), c[0], np.zeros(dim)])
    qs = spark.createDataFrame([(i, v.tolist(), i % 3 == 0, "lung" if i % 3 == 1 else None) for i, v in enumerate(q)],
                               "query_id long, embedding array<double>, urgent_only boolean, cancer string")
    cs = spark.createDataFrame([(i, v.tolist(), i % 2 == 0, "lung_cancer" if i % 5 == 0 else "skin_cancer") for i, v in enumerate(c)],
                               "chunk_id long, embedding array<double>, is_urgent boolean, cancer_types string")
    return q, c, qs, cs


def brute(q, c, k, keep=lambda i, j: True, floor=-2.0):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    s = np.round(unit(q) @ unit(c).T, 6) + 0.0
    out = {}
    for i in range(len(q)):
        order = sorted((-s[i, j], j) for j in range(len(c)) if keep(i, j) and s[i, j] >= floor)
        out[i] = [(j, -neg) for neg, j in order[:k]]
    return out


def collected(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return got


def same(got, expected):
    assert {k: v for k, v in expected.items() if v}.keys() == got.keys()
    for key, rows in got.items():
        assert [j for j, _ in rows] == [j for j, _ in expected[key]]
        assert np.allclose([s for _, s in rows], [s for _, s in expected[key]])


def test_top_k_matches_brute_force(spark):
    q, c, qs, cs = frames(spark)
    same(collected(S.top_k(qs, cs, 7)), brute(q, c, 7))
    same(collected(S.top_k(qs, cs, 7, min_score=0.4)), brute(q, c, 7, floor=0.4))


def test_grid_is_exact_with_hot_cells(spark):
    q, c, qs, cs = frames(spark)
    same(collected(S.top_k_grid(qs, cs, 7, pivots=6, seeds=50, block=30)), brute(q, c, 7))


def test_grid_takes_over_beyond_broadcast_size(spark):
    q, c, qs, cs = frames(spark)
    same(collected(S.top_k(qs, cs, 4, max_query_values=8)), brute(q, c, 4))


def test_routes(spark):
    q, c, qs, cs = frames(spark)

    def keep(i, j):
        return j % 2 == 0 if i % 3 == 0 else j % 5 == 0 if i % 3 == 1 else True
    same(collected(S.top_k(qs, cs, 5, routed=True)), brute(q, c, 5, keep))
    same(collected(S.top_k_grid(qs, cs, 5, routed=True, pivots=6, seeds=50, block=30)), brute(q, c, 5, keep))


def test_filter_before_and_after(spark):
    q, c, qs, cs = frames(spark)
    before = S.top_k(qs, cs, 5, where=compile_filter({"cancer_types": {"$contains": "lung"}}, cs.columns))
    same(collected(before), brute(q, c, 5, lambda i, j: j % 5 == 0))
    after = collected(S.filtered_after(qs, cs, "cancer_types", "LUNG", 5))
    wide = brute(q, c, 15)
    expected = {i: [(j, s) for j, s in rows if j % 5 == 0][:5] for i, rows in wide.items()}
    same(after, expected)


def test_approximate_finds_exact_copies(spark):
    _, _, qs, cs = frames(spark)
    hits = collected(S.approximate_top_k(qs, cs, 3, bands=4, bits=4, block=20))
    assert [j for j, _ in hits[38]] == [0, 1, 2]


def test_filter_language(spark):
    df = spark.createDataFrame([(1, "a,b", True), (2, "c", False)], "page int, tags string, flag boolean")
    ids = lambda w: [r.page for r in df.where(compile_filter(w, df.columns)).collect()]
    assert ids({"page": {"$lte": 1, "$gte": 1}}) == [1]
    assert ids({"$or": [{"flag": False}, {"page": 1}], "tags": {"$contains": "c"}}) == [2]
    assert ids({"unknown": 1}) == [] and ids(None) == [1, 2]
    with pytest.raises(ValueError):
        ids({"page": {"$ne": 1}})
    assert clinical_filter() is None
    assert clinical_filter(urgency="urgent", is_urgent=True) == {"$and": [{"urgency": "urgent"}, {"is_urgent": True}]}


def test_cosine_and_text_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0, 3.0], [-1.0, -2.0, -3.0]),
                                ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0]
    t = spark.createDataFrame([("x",), ("x",), ("y",)], "t string").select(V.text_vector(F.col("t"), 24).alias("v"))
    v = [r.v for r in t.collect()]
    assert v[0] == v[1] != v[2] and len(v[0]) == 24 and abs(sum(x * x for x in v[0]) - 1) < 1e-9


def test_plan_is_cut_before_the_shuffle(spark):
    _, _, qs, cs = frames(spark)
    plan = S.top_k(qs, cs, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_recall_report(spark):
    _, _, qs, cs = frames(spark)
    exact = S.top_k(qs, cs, 3)
    row = one(S.recall_against(exact, exact))
    assert row["exact_hits"] == row["found_hits"] == 120


def test_a_block_is_scored_in_bounded_memory():
    q, c = rng.standard_normal((600, 8)), np.repeat(rng.standard_normal((10, 8)), 4000, axis=0)
    q, c = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, c))
    tracemalloc.start()
    found = [np.array(rows) for rows in S._score(q, c, np.arange(len(c))[::-1], 5, None)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    last = brute(q[:1], c[::-1], 5)[0]
    assert [(len(c) - 1 - int(j), s) for i, j, s in zip(*found[0]) if i == 0] == last


def test_queries_alike_are_searched_once(spark):
    q, c, qs, cs = frames(spark)
    copies = qs.where("query_id < 6").crossJoin(spark.range(50).withColumnRenamed("id", "copy")).withColumn("query_id", F.col("query_id") * 50 + F.col("copy"))
    found = S.top_k(copies, cs, 4, max_query_values=6 * 8)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    expected = brute(q, c, 4)
    same(collected(found), {i * 50 + j: expected[i] for i in range(6) for j in range(50)})


def test_a_query_travels_once_to_neighbouring_cells():
    assert S._packs([3, 4, 5, 20, 1, 2], 10).tolist() == [0, 0, 1, 2, 3, 3]


def test_a_routed_block_is_scored_in_bounded_memory():
    q, c = (rng.standard_normal((n, 8)) for n in (2000, 20_000))
    mask = np.stack([np.arange(len(c)) % 2 == 0, np.ones(len(c), bool)]), np.arange(len(q)) % 2
    tracemalloc.start()
    found = [np.array(rows) for rows in S._score(q, c, np.arange(len(c)), 18, None, mask)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20
    for i in (0, 1):
        best = np.sort(np.round((c @ q[i])[mask[0][i]], S.DIGITS))[::-1][:18]
        assert [s for j, _, s in found[0].T if j == i] == best.tolist()
