"""Streaming operators over a file source in a scratch folder."""

import tempfile

from pyspark.sql import functions as F

from bibspark.operators import store
from bibspark.streaming import streams


def test_dedupe_and_lifecycle(spark):
    base = tempfile.mkdtemp(prefix="bibspark-stream-")
    msgs = spark.createDataFrame([("DblpAuthor", "A", False), ("DblpAuthor", "A", False), ("FetchDblpData", "A", False),
                                  ("sys", "A", True), ("sys", "A", True)],
                                 "message_type STRING, expected_id STRING, system_message BOOLEAN")
    msgs.write.parquet(f"{base}/in")
    s = spark.readStream.schema(msgs.schema).parquet(f"{base}/in")
    out = streams.run_available(spark, streams.dedupe(s, ["message_type", "expected_id"], "system_message"), "t1")
    got = sorted((r["message_type"], r["expected_id"]) for r in out.collect())
    assert got == [("DblpAuthor", "A"), ("FetchDblpData", "A"), ("sys", "A"), ("sys", "A")]

    docs = spark.createDataFrame([("dblp", "x", 1010, "dblp"), ("dblp", "y", 1010, "dblp"), ("dblp", "z", None, "dblp")],
                                 "entity_db STRING, _id STRING, phase_ref INT, iface STRING")
    docs.write.parquet(f"{base}/docs")
    ds = spark.readStream.schema(docs.schema).parquet(f"{base}/docs")
    q = (ds.writeStream.option("checkpointLocation", f"{base}/ck").trigger(availableNow=True)
         .foreachBatch(streams.lifecycle_sink(f"{base}/store", f"{base}/out", "2024-01-01 00:00:00")).start())
    q.awaitTermination()
    cur = {r["_id"]: r for r in store.read_versions(spark, f"{base}/store").collect()}
    assert sorted(cur) == ["x", "y"] and all(r["sent"] and r["serialized"] for r in cur.values())
    assert cur["x"]["class_id"] == 1010 and cur["x"]["variant_id"] == 100
    lines = [r["value"] for r in spark.read.text(f"{base}/out/lines").collect()]
    assert len(lines) == 2 and all('"sent":false' in ln for ln in lines)


def test_lifecycle_sink_aggregates_a_batch_once(spark):
    """Rows of a batch are read by one aggregation, whatever is done with them."""
    base = tempfile.mkdtemp(prefix="bibspark-once-")
    rows = [("dblp", "x", 1010, "dblp", 1), ("dblp", "x", 1010, "dblp", 2), ("dblp", "y", 1010, "dblp", 1),
            ("dblp", "z", None, "dblp", 1), ("dblp", None, 1010, "dblp", 1), (None, "w", 1010, "dblp", 1)]
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kind = "entity_db STRING, _id STRING, phase_ref INT, iface STRING, seq INT"
    sink = streams.lifecycle_sink(f"{base}/store", f"{base}/out", "2024-01-01 00:00:00", order=["seq"])
    for batch, own in enumerate((rows, rows[2:3])):
        sink(spark.createDataFrame(own, kind).mapInArrow(passing, kind), batch)
    assert seen.value == len(rows) + 1
    assert {r["_id"]: r["update_count"] for r in store.read_versions(spark, f"{base}/store").collect()} == {"x": 3, "y": 3}
    assert [r["_id"] for r in spark.read.parquet(f"{base}/out/rejected").collect()] == ["z"]


def test_folders_land(spark):
    base = tempfile.mkdtemp(prefix="bibspark-land-")
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "n INT, folder INT")
    df.write.partitionBy("folder").parquet(f"{base}/all")
    for k in range(3):
        store.land(spark, f"{base}/all/folder={k}", f"{base}/in/f{k}", df.select("n").schema)
    assert [sorted(r["n"] for r in spark.read.parquet(f"{base}/in/f{k}").collect()) for k in range(3)] == [[1, 2], [3], []]


def test_page_ingest_stream(spark):
    from bibspark.operators.extract import quality
    from bibspark.sources.pages import PAGE_SCHEMA
    base = tempfile.mkdtemp(prefix="bibspark-ingest-")
    spark.createDataFrame([(1, "u1", "<p>Too Many Requests</p>"), (2, "u2", "<p>fine</p>")], PAGE_SCHEMA) \
        .write.parquet(f"{base}/pages/a")
    stream = spark.readStream.schema(PAGE_SCHEMA).parquet(f"{base}/pages/a").withColumns(
        {"iface": F.lit("dblp"), "page_kind": F.lit("search")})
    q = streams.ingest_pages(stream, lambda p: quality.classify(p, ["page_id"]),
                             streams.versioned_sink(f"{base}/out"), f"{base}/ck")
    q.awaitTermination()
    got = {r["page_id"]: r["blocked"] for r in streams.read_versioned(spark, f"{base}/out", ["page_id"]).collect()}
    assert got == {1: True, 2: False}


def test_dedupe_with_ttl(spark):
    base = tempfile.mkdtemp(prefix="bibspark-ttl-")
    msgs = spark.createDataFrame([("t", "A", False, "2024-01-01 00:00:00"), ("t", "A", False, "2024-01-01 00:10:00"),
                                  ("t", "B", False, "2024-01-01 00:20:00"), ("s", "A", True, "2024-01-01 00:30:00")],
                                 "message_type STRING, expected_id STRING, system_message BOOLEAN, ts STRING") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    msgs.write.parquet(f"{base}/in")
    s = spark.readStream.schema(msgs.schema).parquet(f"{base}/in")
    d = streams.dedupe(s, ["message_type", "expected_id"], "system_message", ts_col="ts", ttl="30 days")
    out = streams.run_available(spark, d, "t1ttl")
    assert sorted((r["message_type"], r["expected_id"]) for r in out.collect()) == [("s", "A"), ("t", "A"), ("t", "B")]
