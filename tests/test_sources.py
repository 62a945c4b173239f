import hashlib
import json

import pytest
from conftest import one
from pyspark.sql import functions as F

from evispark import schemas
from evispark.operators import lookups as L
from evispark.operators import retrieval
from evispark.functions import vectors as V
from evispark.sources import chunk_files, page_files
from evispark.sources import patients as patient_files
from evispark.sources.collection import Collection, read_or_build

# Five flat chunks: id, text, pages, section, hierarchy, type, urgent, cancers, symptoms, urgency.
ROWS = [
    ("c_lymphoma", "Lymphadenopathy with night sweats", 22, 22, "1.10 Haematological", "1|1.10|1.10.1", "text", True, "lymphoma", "night_sweats", "urgent_2_week"),
    ("c_lung", "Chest x-ray for cough", 9, 9, "1.1 Lung cancers", "1|1.1|1.1.2", "text", False, "lung_cancer", "cough", "urgent"),
    ("c_breast", "Breast lump aged 30 and over", 14, 15, "1.4 Breast cancers", "1|1.4|1.4.1", "text", True, "breast_cancer", "breast_lump", "urgent_2_week"),
    ("c_colon", "| FIT | value |", 12, 13, "1.3 Lower GI", "", "table", False, "colorectal_cancer", "rectal_bleeding", "routine"),
    ("c_ovary", "Bloating in women", 17, 17, "", "", "text", True, "ovarian_cancer", "bloating", "urgent_2_week"),
]


@pytest.fixture(scope="module")
def flat(spark):
    cols = ["chunk_id", "text", "page_start", "page_end", "section", "section_hierarchy", "content_type", "is_urgent",
            "cancer_types", "symptoms", "urgency"]
    ddl = ", ".join(f"{c} {schemas.FLAT_CHUNK[c]}" for c in cols)
    from evispark.operators.validation import with_defaults
    return with_defaults(spark.createDataFrame(ROWS, ddl), schemas.FLAT_DEFAULTS).withColumns(
        {"prev_chunk_id": F.lit(None).cast("string"), "next_chunk_id": F.lit(None).cast("string")}).select(*schemas.FLAT_CHUNK)


def test_json_round_trip(spark, flat, tmp_path):
    embedded = flat.withColumn("embedding", V.text_vector(F.col("text"), 8))
    for fmt in ("json", "parquet"):
        chunk_files.write_embedded(embedded, str(tmp_path / fmt), fmt)
        back = chunk_files.read_embedded(spark, str(tmp_path / fmt), fmt)
        assert back.count() == 5 and one(back.where("chunk_id = 'c_lung'"))["symptoms"] == "cough"


def test_json_defaults(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"chunk_id": "a", "text": "t", "page_start": 1, "page_end": 2},
                                                    {"chunk_id": "b", "symptoms": "cough"}]))
    (tmp_path / "single.json").write_text(json.dumps({"chunk_id": "c", "content_type": "table"}))
    rows = {r.chunk_id: r for r in chunk_files.read_chunks_json(spark, str(tmp_path)).collect()}
    assert (rows["a"].content_type, rows["a"].symptoms, rows["a"].source, rows["a"].prev_chunk_id) == ("text", "", "NG12", None)
    assert rows["b"].symptoms == "cough" and rows["b"].page_start == 0 and rows["c"].content_type == "table"


def test_markdown_round_trip(spark, flat, tmp_path):
    ids = flat.withColumn("chunk_id", F.concat(F.lit("ng12_"), "chunk_id")).withColumn(
        "text", F.concat("text", F.lit("\n## 1.1 inner heading\ntail")))
    chunk_files.write_chunks_markdown(ids, str(tmp_path / "md"))
    back = {r.chunk_id: r for r in chunk_files.read_chunks_markdown(spark, str(tmp_path / "md")).collect()}
    assert set(back) == {"ng12_" + r[0] for r in ROWS}
    assert back["ng12_c_breast"].cancer_types == "breast_cancer" and back["ng12_c_ovary"].section == "N/A"


def test_pages_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "one", ["1 A"], True, "content"), (1, 2, "two", [], False, "content")],
                               "doc_id long, page_number int, markdown string, sections array<string>, has_tables boolean, content_type string")
    page_files.write_pages_markdown(df, str(tmp_path / "pages"))
    text = "".join(r[0] for r in spark.read.text(str(tmp_path / "pages"), wholetext=True).select("value").collect())
    assert len(list((tmp_path / "pages").glob("bucket=*"))) == 1 and text.index("page 1 -->") < text.index("page 2 -->")
    assert text.split("<!-- Document 1, page 2 -->")[0].strip() == "<!-- Document 1, page 1 -->\n# Page 1\n\n**Type:** content\n\n**Sections:** 1 A\n\n**Has Tables:** True\n\n---\n\none"
    docs = spark.createDataFrame([(1, "T", "s", 2, "body")], "doc_id long, title string, source string, total_pages int, markdown string")
    page_files.write_documents_markdown(docs, str(tmp_path / "docs"))
    assert "**Total Pages:** 2" in spark.read.text(str(tmp_path / "docs"), wholetext=True).first()[0]


def test_file_audit(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"%PDF-" + b"x" * 2000)
    (tmp_path / "small.pdf").write_bytes(b"%PDF-")
    (tmp_path / "wrong.pdf").write_bytes(b"<html>" + b"x" * 2000)
    rows = {r.path.split("/")[-1]: r for r in page_files.audit_files(spark, str(tmp_path), expected_sha256="0").collect()}
    assert [rows[n].valid for n in ("good.pdf", "small.pdf", "wrong.pdf")] == [True, False, False]
    assert rows["good.pdf"].checksum_warning


def test_file_audit_of_files_too_large_for_a_value(spark, tmp_path, monkeypatch):
    (tmp_path / "good.pdf").write_bytes(b"%PDF-" + b"x" * 2000)
    (tmp_path / "large.pdf").write_bytes(b"%PDF-" + bytes(range(256)) * 40)
    (tmp_path / "wrong.pdf").write_bytes(b"%PD" + b"x" * 9000)
    monkeypatch.setattr(page_files, "WHOLE", 4000, raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 5000)      # as files of 2 GiB are an error of the source
    try:
        rows = {r.path.split("/")[-1]: r for r in page_files.audit_files(spark, str(tmp_path), expected_sha256="0").collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {n: (r.length, r.sha256) for n, r in rows.items()} == {
        p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.glob("*.pdf")}
    assert [rows[n].valid for n in ("good.pdf", "large.pdf", "wrong.pdf")] == [True, True, False] and rows["large.pdf"].checksum_warning


def test_patients(spark, tmp_path):
    p = [{"patient_id": "PT-1", "name": "Ann", "age": 3, "symptoms": ["a" * 60, "b" * 60]}, {"id": "x2", "age": 5}]
    (tmp_path / "list.json").write_text(json.dumps(p))
    (tmp_path / "dict.json").write_text(json.dumps({"patients": p}))
    for name in ("list.json", "dict.json"):
        df = patient_files.read_patients(spark, str(tmp_path / name))
        rows = {r.id: r for r in patient_files.patient_list(df).collect()}
        assert len(rows["PT-1"].presenting_complaint) == 100 and rows["x2"].name == "Unknown"
        assert [r.patient_id for r in patient_files.find_patients(df, "ANN").collect()] == ["PT-1"]
        assert patient_files.patient(df, "x2").count() == 1


def test_collection(spark, flat, tmp_path):
    store = Collection(spark, str(tmp_path / "store"))
    assert store.count() == 0 and store.read() is None
    assert store.ingest(flat) == {"added": 5, "urgent": 3, "recommendations": 0}
    assert store.ingest(flat) == {"added": 0, "urgent": 0, "recommendations": 0}
    store.append(flat.where("chunk_id = 'c_lung'").withColumn("text", F.lit("newer")))
    rows = {r.chunk_id: r.text for r in store.read().collect()}
    assert len(rows) == 5 and rows["c_lung"] == "newer" and store.count() == 5
    assert store.ingest(flat.limit(2), force=True)["added"] == 2 and store.count() == 2
    store.clear()
    assert store.count() == 0 and store.read().count() == 0
    store.append(flat)
    store.reset()
    assert store.read() is None


def test_stage_cache(spark, flat, tmp_path):
    path, builds = str(tmp_path / "stage"), []

    def build():
        builds.append(1)
        return flat

    assert read_or_build(spark, path, build).count() == 5
    read_or_build(spark, path, build)
    assert len(builds) == 1
    read_or_build(spark, path, build, force=True)
    assert len(builds) == 2
    for part in (tmp_path / "stage").glob("*.parquet"):
        part.write_bytes(b"damaged")
    for check in (tmp_path / "stage").glob(".*.crc"):
        check.write_bytes(b"")
    assert read_or_build(spark, path, build).count() == 5 and len(builds) == 3


def test_lookups(spark, flat):
    pages = spark.createDataFrame([(22,), (13,), (99,)], "page int")
    assert {(r.page, r.chunk_id) for r in L.on_pages(flat, pages).collect()} == {(22, "c_lymphoma"), (13, "c_colon")}
    assert [r.chunk_id for r in L.in_section(flat, "1.1").collect()] == ["c_lung"]   # not 1.10
    assert {r.chunk_id for r in L.in_section(flat, "1|1.1", exact=False).collect()} == {"c_lung", "c_lymphoma"}
    ids = spark.createDataFrame([("c_lung",), ("nope",)], "chunk_id string")
    assert {r.chunk_id: r.text for r in L.by_id(flat, ids).collect()} == {"c_lung": "Chest x-ray for cough", "nope": None}
    s = one(L.statistics(flat))
    assert (s["total_chunks"], s["urgent_chunks"]) == (5, 3)
    assert one(L.statistics(flat.limit(0)))["urgent_chunks"] == 0
    assert L.cancer_type_facet(flat).count() == 5
    wanted = spark.createDataFrame([("1.4",), ("9.9",)], "section_number string")
    texts = {r.section_number: r for r in L.section_texts(flat, wanted).collect()}
    assert texts["1.4"].content == "Breast lump aged 30 and over" and texts["9.9"].error == "Section 9.9 not found"


def test_citations(flat):
    got = {r.chunk_id: r.citation for r in L.with_citations(flat).collect()}
    assert got == {"c_lymphoma": "[NG12 Section 1.10.1, p.22]", "c_lung": "[NG12 Section 1.1.2, p.9]",
                   "c_breast": "[NG12 Section 1.4.1, pp.14-15]", "c_colon": "[NG12 1.3, pp.12-13]", "c_ovary": "[NG12 p.17]"}


def test_retrieval_end_to_end(spark, flat):
    embed = lambda c: V.text_vector(c, 16)
    chunks = flat.withColumn("embedding", embed(F.col("text")))
    queries = spark.createDataFrame([(1, "Bloating in women"), (2, "Chest x-ray for cough")], "query_id int, query string")
    hits = retrieval.retrieve(queries, chunks, embed, k=2, expand=False, threshold=0.99)
    shown = retrieval.hit_rows(hits, flat)
    assert {(r.query_id, r.chunk_id, r.total_candidates) for r in shown.collect()} == {(1, "c_ovary", 4), (2, "c_lung", 4)}
    context = {r.query_id: r for r in L.context_texts(shown).collect()}
    assert context[1].context == "[[NG12 p.17]]\nBloating in women" and context[2].citations == ["[NG12 Section 1.1.2, p.9]"]
    requests = spark.createDataFrame([(1, "Bloating in women", None, [], None, True), (2, "x", 50, ["cough"], "LUNG", False), (3, "y", 20, [], "brain", False)],
                                     "query_id int, query string, age int, symptoms array<string>, cancer string, urgent_only boolean")
    for mode in ("pre", "post"):
        got = retrieval.retrieve_for_patients(requests, chunks, embed, k=5, threshold=-1, mode=mode)
        by = {}
        for r in got.collect():
            by.setdefault(r.query_id, set()).add(r.chunk_id)
        assert by == {1: {"c_lymphoma", "c_breast", "c_ovary"}, 2: {"c_lung"}}
    none = retrieval.without_evidence(requests, hits)
    assert [(r.query_id, r.confidence) for r in none.collect()] == [(3, 0.0)]


def test_assess_and_evaluate_plans(spark, flat):
    from evispark.operators.evaluation import default_queries
    from evispark.plans.assess import assess_patients
    from evispark.plans.evaluate import evaluate
    embed = lambda c: V.text_vector(c, 16)
    chunks = flat.withColumn("embedding", embed(F.col("text")))
    patients = spark.createDataFrame([("p1", "Bloating in women", [], 50, []), ("p2", "no match at all", ["dysphagia"], 30, [])],
                                     "patient_id string, presenting_complaint string, symptoms array<string>, age int, risk_factors array<string>")
    rows = {r.patient_id: r for r in assess_patients(patients, chunks, flat, embed, threshold=0.9).collect()}
    assert rows["p2"].risk_level == "insufficient_info" and rows["p2"].confidence == 0.0
    result = evaluate(default_queries(spark), chunks, flat, embed, threshold=-1)
    assert result.per_query.count() == 16 and one(result.gates)["num_queries"] == 16


def test_collection_writers_and_copies(spark, flat, tmp_path):
    """A stream's batch 0 leaves an append's batch 0 alone, a replay adds nothing, and the later row of a batch wins."""
    store = Collection(spark, str(tmp_path / "store"))
    named = lambda text: flat.limit(2).withColumn("text", F.lit(text))
    store.append(flat)
    store.append(named("a").union(named("b")))
    assert {r.text for r in store.read().collect()} >= {"b"} and store.read().where("text = 'a'").count() == 0
    extra = flat.limit(1).withColumns({"chunk_id": F.lit("s"), "text": F.lit("s0")})
    for _ in range(2):
        store.append(extra, batch=0, writer="stream-1")
    store.append(extra.withColumns({"chunk_id": F.lit("t"), "text": F.lit("t0")}), batch=0, writer="stream-2")
    assert store.count() == 7 and store.read().count() == 7
    store.append(extra.withColumn("text", F.lit("newest")))
    assert store.read().where("chunk_id = 's'").first().text == "newest"
    store.append(extra, batch=0, writer="stream-1")   # replayed late: it keeps its place in the order
    assert store.read().where("chunk_id = 's'").first().text == "newest"


def test_collection_conditions_reach_the_scan(spark, flat, tmp_path):
    store = Collection(spark, str(tmp_path / "store"))
    store.append(flat)
    store.append(flat.limit(1))
    plan = store.read().where("is_urgent").select("chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(is_urgent,true)" in plan
