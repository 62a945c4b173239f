from pyspark.sql import functions as F

from evispark.catalog import derived
from evispark.operators.chunking import ChunkSize
from evispark.sources.collection import Collection
from evispark.streaming import conversations as live
from evispark.streaming.ingest import ingest_stream

TURNS = "conv_id long, turn long, role string, text string, ts timestamp"


def written(spark, path, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, minute long")
    df.select("conv_id", "turn", "role", "text", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000).alias("ts")).coalesce(1).write.mode(
        "append").parquet(path)


def drained(spark, df, tmp_path, name):
    q = (df.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name))
         .option("checkpointLocation", str(tmp_path / (name + "-state"))).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


def test_sessions(spark, tmp_path):
    src = str(tmp_path / "in")
    written(spark, src, [(1, 0, "user", "a", 0), (1, 1, "assistant", "b", 10), (1, 2, "user", "c", 200), (2, 0, "user", "d", 5)])
    written(spark, src, [(9, 0, "user", "end", 100000)])
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(src)
    out = drained(spark, live.session_statistics(stream), tmp_path, "sessions")
    assert sorted((r.conv_id, r.turns, r.user_turns) for r in out.collect()) == [(1, 1, 1), (1, 2, 1), (2, 1, 1)]


def test_live_state_and_expiry(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "in")
    written(spark, src, [(1, 0, "user", "age 50 with cough", 0), (1, 1, "assistant", "how long?", 1), (2, 0, "user", "hello there", 2)])
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(src)
    df = live.live_state(stream)
    drained(spark, df, tmp_path, "live")
    written(spark, src, [(1, 2, "user", "for 3 weeks", 30), (1, 3, "user", "run assessment", 31)])
    drained(spark, df, tmp_path, "live")
    written(spark, src, [(9, 0, "user", "end", 100000)])
    drained(spark, df, tmp_path, "live")
    written(spark, src, [(9, 1, "user", "end", 100001)])
    rows = drained(spark, df, tmp_path, "live").collect()
    turns = [(r.age, r.duration, r.decision, r.state) for r in sorted(rows, key=lambda r: r.ts) if r.conv_id == 1 and not r.expired]
    assert turns == [(50, None, "ask_missing", "gathering"), (50, "3 weeks", "confirm", "clarifying"), (50, "3 weeks", "assess", "complete")]
    assert sorted(r.conv_id for r in rows if r.expired) == [1, 2]


def test_incremental_ingest(spark, tmp_path):
    docs = str(tmp_path / "docs")
    body = "\n\n".join(f"Some sentence number {i} about cough." for i in range(60))
    store = Collection(spark, str(tmp_path / "store"))
    for batch in ([(1, body), (2, body[:900])], [(3, body)]):
        spark.createDataFrame(batch, "doc_id long, text string").coalesce(1).write.mode("append").parquet(docs)
        stream = spark.readStream.schema("doc_id long, text string").parquet(docs)
        ingest_stream(stream, store, str(tmp_path / "state"), size=ChunkSize(100, 20, 20), dim=8).awaitTermination()
    rows = store.read()
    assert {r.doc for r in rows.select(F.split("chunk_id", "_")[1].alias("doc")).distinct().collect()} == {"1", "2", "3"}
    assert rows.where("embedding is null").count() == 0 and rows.count() == store.count()


def test_views_are_whole(spark):
    """Derived views keep every row of their table."""
    sf = "/root/testdata/sf0.001"
    n = derived.table(spark, sf, "documents").count()
    assert derived.notes(spark, sf).count() == n and derived.guideline(spark, sf).count() == n
