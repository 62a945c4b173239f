import math
import random

import pytest
from conftest import one

from evispark import fixed
from evispark.operators import evaluation as E


@pytest.fixture(scope="module")
def golden(spark):
    run = spark.createDataFrame([(1, i + 1, f"c{i + 1}") for i in range(5)], "query_id int, rank int, chunk_id string")
    qrels = spark.createDataFrame([(1, c, 1) for c in ("c2", "c4", "c7")], "query_id int, chunk_id string, grade int")
    return run, qrels


def test_golden_row(golden):
    row = one(E.per_query_metrics(*golden, k=5))
    got = {k: round(row[k], 5) for k in E.METRICS}
    assert got == {"recall": 0.66667, "precision": 0.4, "mrr": 0.5, "ndcg": 0.49819, "average_precision": 0.33333, "hit_rate": 1.0}


def test_empty_sides(spark, golden):
    run, qrels = golden
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    row = [r for r in E.per_query_metrics(run, qrels, queries=queries).collect() if r.query_id == 2][0]
    assert all(row[m] == 0.0 for m in E.METRICS)
    mean = one(E.quality_gates(E.mean_metrics(E.per_query_metrics(run.limit(0), qrels.limit(0)))))
    assert mean["recall"] is None and mean["num_queries"] == 0


def test_random_runs_match_formulas(spark):
    rng = random.Random(8)
    run, qrels = [], []
    for q in range(30):
        ids = rng.sample(range(40), rng.randint(0, 12))
        run += [(q, i + 1, c) for i, c in enumerate(ids)]
        qrels += [(q, c, rng.randint(1, 3)) for c in rng.sample(range(40), rng.randint(0, 10))]
    rows = E.per_query_metrics(spark.createDataFrame(run, "query_id int, rank int, chunk_id int"),
                               spark.createDataFrame(qrels, "query_id int, chunk_id int, grade int"), k=5).collect()
    for r in rows:
        got = [c for q, _, c in run if q == r.query_id]
        rel = {c: g for q, c, g in qrels if q == r.query_id}
        top = got[:5]
        dcg = lambda gains: sum(g / math.log2(i + 2) for i, g in enumerate(gains))
        hits = [i for i, c in enumerate(top) if c in rel]
        ideal = dcg(sorted(rel.values(), reverse=True)[:5])
        first = [i for i, c in enumerate(got) if c in rel]
        expected = {"recall": len(hits) / len(rel) if rel else 0, "precision": len(hits) / 5, "mrr": 1 / (first[0] + 1) if first else 0,
                    "ndcg": dcg([rel.get(c, 0) for c in top]) / ideal if ideal else 0,
                    "average_precision": sum((n + 1) / (i + 1) for n, i in enumerate(hits)) / len(rel) if rel else 0,
                    "hit_rate": 1.0 if hits else 0.0}
        assert {m: pytest.approx(expected[m]) for m in E.METRICS} == {m: r[m] for m in E.METRICS}


def grade(q, c):
    cancer, symptoms = bool(set(q[1]) & set(c[1])), len(set(q[2]) & set(c[2]))
    base = 3 if cancer and symptoms >= 2 else 2 if cancer else 1 if symptoms else 0
    return max(0, base - int(bool(q[3]) and bool(c[3]) and q[3] != c[3]))


@pytest.mark.parametrize("broadcastable", [True, False])
def test_qrels_match_all_pairs(spark, monkeypatch, broadcastable):
    """One tag is on every chunk; the salted join and the broadcast join agree with all pairs."""
    monkeypatch.setattr(E, "fits", lambda df: broadcastable)
    rng = random.Random(2)
    chunks = [(f"c{i}", rng.sample(["lung_cancer", "breast_cancer"], rng.randint(0, 2)),
               ["persistent", *rng.sample(["cough", "lump", "fatigue"], rng.randint(0, 3))],
               rng.choice(["urgent_2_week", "unknown", ""])) for i in range(120)]
    queries = [(q, *r[1:]) for q, r in enumerate(fixed.EVALUATION_QUERIES)]
    got = E.build_qrels(spark.createDataFrame(queries, "query_id int, cancers array<string>, symptoms array<string>, urgency string"),
                        spark.createDataFrame(chunks, "chunk_id string, cancer_types array<string>, symptoms array<string>, urgency string"))
    expected = {(q[0], c[0]): grade(q, c) for q in queries for c in chunks if grade(q, c) > 0}
    assert {(r.query_id, r.chunk_id): r.grade for r in got.collect()} == expected


def test_missed_and_comparison(spark, golden):
    run, qrels = golden
    assert {r.chunk_id for r in E.missed_chunks(run, qrels, 3).collect()} == {"c4", "c7"}
    better = spark.createDataFrame([(1, 1, "c4"), (1, 2, "c7"), (1, 3, "c2")], "query_id int, rank int, chunk_id string")
    assert one(E.compare_runs(run, better, qrels, 3))["better"] == "second"
    assert one(E.compare_runs(run, run, qrels, 3))["better"] == "first"


def test_default_queries(spark):
    assert E.default_queries(spark).count() == 16
