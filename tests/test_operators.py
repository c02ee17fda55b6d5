"""Store, resolution, paging, counters and frontier semantics."""

from pyspark.sql import functions as F

from bibspark.operators import frontier, metrics, paging, resolve, store
from bibspark.plans import catalog

AS_OF = "2024-03-01 00:00:00"


def test_upsert(spark):
    old = spark.createDataFrame([("a", "r1", None), ("b", "r2", 5), ("c", "r3", None)],
                                "_id STRING, _rev STRING, update_count INT").withColumn(
        "update_date", F.lit(None).cast("timestamp"))
    new = spark.createDataFrame([("a", None, None), ("b", None, 3), ("d", None, None)],
                                "_id STRING, _rev STRING, update_count INT")
    out = {r["_id"]: r for r in store.upsert(old, new, AS_OF).collect()}
    assert (out["a"]["update_count"], out["a"]["_rev"]) == (1, "r1")
    assert (out["b"]["update_count"], out["b"]["_rev"]) == (4, "r2")
    assert out["c"]["_rev"] == "r3" and out["c"]["update_date"] is None
    assert out["d"]["update_count"] is None and out["d"]["update_date"] is not None


def test_freshness(spark):
    docs = spark.createDataFrame([
        ("nodate", None, True), ("unser", "2024-02-28 00:00:00", False), ("nullser", "2024-02-28 00:00:00", None),
        ("old", "2024-01-30 23:59:59", True), ("edge", "2024-01-31 00:00:00", True),
        ("future", "2024-04-01 00:00:01", True), ("fresh", "2024-02-20 00:00:00", True)],
        "_id STRING, update_date STRING, serialized BOOLEAN").withColumn("update_date", F.col("update_date").cast("timestamp"))
    work = spark.createDataFrame([(k,) for k in ["absent", "nodate", "unser", "nullser", "old", "edge", "future", "fresh"]],
                                 "wid STRING")
    out = {r["wid"]: r["stale"] for r in store.stale(work, docs, "wid", "_id", AS_OF).collect()}
    assert out == {"absent": True, "nodate": True, "unser": True, "nullser": True, "old": True,
                   "edge": False, "future": True, "fresh": False}


def test_resolution(spark):
    c = spark.createDataFrame([
        ("q1", 0, "x", "Univ Pisa", "a"), ("q1", 1, "y", "CNR", "b"), ("q1", 2, "z", "MIT", "c"),
        ("q2", 0, "Ada", "MIT", "a"), ("q2", 1, "ada", "MIT", "b"), ("q2", 2, "Bob", "MIT", "c"),
        ("q3", 0, "u", "MIT", "a"), ("q3", 1, "v", "ETH", "b")],
        "q STRING, pos INT, name STRING, org STRING, cand STRING").withColumn("qname", F.lit("ADA"))
    last = {r["q"]: (r["cand"], r["tier"]) for r in
            resolve.pick_candidate(c, ["q"], "pos", "org", "name", "qname", "cand", ["pisa", "cnr"], "last").collect()}
    first = {r["q"]: r["cand"] for r in
             resolve.pick_candidate(c, ["q"], "pos", "org", "name", "qname", "cand", ["pisa", "cnr"], "first").collect()}
    assert last == {"q1": ("b", 1), "q2": ("a", 2), "q3": ("b", 3)} and first["q3"] == "a"
    every = resolve.pick_candidate(c, ["q"], "pos", "org", "name", "qname", "cand", [""], "first").collect()
    assert {r["q"]: r["cand"] for r in every} == {"q1": "c", "q2": "c", "q3": "b"}


def test_take_while(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, False)],
                               "l INT, p INT, stop BOOLEAN")
    inc = sorted((r["l"], r["p"]) for r in paging.take_while(df, ["l"], "p", "stop", True).collect())
    exc = sorted((r["l"], r["p"]) for r in paging.take_while(df, ["l"], "p", "stop", False).collect())
    assert inc == [(1, 1), (1, 2), (2, 1)] and exc == [(1, 1), (2, 1)]


def test_sequence_number_and_ids(spark):
    df = spark.createDataFrame([("x", i) for i in range(50)] + [("y", i) for i in range(3)], "t STRING, o INT")
    n = metrics.sequence_number(df, ["t"], ["o"])
    got = sorted((r["t"], r["o"], r["seq"]) for r in n.collect())
    assert got == sorted([("x", i, i) for i in range(50)] + [("y", i, i) for i in range(3)])
    ids = n.select(metrics.message_ids(n, "t", []).alias("m")).collect()
    assert {"x_0", "x_49", "y_2"} <= {r["m"] for r in ids}


def test_expand_matches_recursive_sql(spark):
    edges = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (3, "d"), (4, "d"), (4, "e"),
                                   (5, "e"), (5, "f"), (6, "x")], "pub INT, author STRING")
    seeds = spark.createDataFrame([("a",)], "author STRING")
    got = {r["author"]: r["depth"] for r in frontier.expand(seeds, edges, 4).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 4}
    edges.createOrReplaceTempView("e_t")
    seeds.createOrReplaceTempView("s_t")
    sql = spark.sql("""
        WITH RECURSIVE walk(author, depth) AS (
          SELECT author, 1 FROM s_t
          UNION ALL
          SELECT DISTINCT e2.author, w.depth + 1
          FROM walk w JOIN e_t e1 ON e1.author = w.author JOIN e_t e2 ON e2.pub = e1.pub
          WHERE w.depth < 4
        )
        SELECT author, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY author""")
    assert {r["author"]: r["depth"] for r in sql.collect()} == got


def test_lifecycle_filters(spark):
    docs = spark.createDataFrame([("a", None, None), ("b", True, False), ("c", True, True), ("d", True, None)],
                                 "_id STRING, serialized BOOLEAN, sent BOOLEAN")
    assert [r["_id"] for r in store.not_serialized(docs).collect()] == ["a"]
    pkg, quarantine = store.to_package(docs)
    assert [r["_id"] for r in pkg.collect()] == ["b"]
    assert sorted(r["_id"] for r in quarantine.collect()) == ["a", "d"]
    assert [r["_id"] for r in store.unsent(docs).collect()] == ["b"]


def test_work_items(spark):
    w = spark.createDataFrame([(True, 3, 100, "2024-01-01"), (False, 1, 101, "2024-01-02"),
                               (False, 1, 101, "2024-01-03"), (False, 1, 100, "2024-01-01")],
                              "system_message BOOLEAN, depth INT, priority INT, ts STRING")
    order = [(r["system_message"], r["depth"], r["priority"], r["ts"]) for r in frontier.top(w, 3).collect()]
    assert order == [(True, 3, 100, "2024-01-01"), (False, 1, 100, "2024-01-01"), (False, 1, 101, "2024-01-03")]
    items = spark.createDataFrame([(5,), (4,)], "depth INT")
    assert [r["depth"] for r in frontier.depth_limit(items).collect()] == [4]


def test_ndjson_roundtrip_and_json_rules(spark, tmp_path):
    from bibspark.functions import text as X
    from bibspark.functions import urls as R
    from bibspark.sources import seeds
    docs = spark.createDataFrame([("a", 1, True), ("b", None, False)], "_id STRING, n INT, sent BOOLEAN")
    store.write_ndjson(docs, str(tmp_path / "out"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ['{"_id":"a","n":1,"sent":true}', '{"_id":"b","n":null,"sent":false}']
    back = store.read_ndjson(spark, str(tmp_path / "out"), "_id STRING, n INT, sent BOOLEAN")
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1, True), ("b", None, False)]
    (tmp_path / "bad").write_text('{"_id":"c"}\n\nnot json\n  {"_id":"d","n":2}  \n[1]\n')
    assert sorted(r["_id"] for r in store.read_ndjson(spark, str(tmp_path / "bad"), "_id STRING, n INT").collect()) == ["c", "d"]
    assert sorted(r["value"] for r in store.bad_lines(spark, str(tmp_path / "bad")).collect()) == ["[1]", "not json"]
    m = spark.createDataFrame([("t", "t_0", "c", "2024-01-01")], "a STRING, b STRING, c STRING, d STRING")
    j = m.select(X.message_to_json("a", "b", "c", "d").alias("j")).first()["j"]
    assert j == '{"message_type":"t","message_id":"t_0","content":"c","timestamp":"2024-01-01"}'
    back = spark.createDataFrame([(j,)], "j STRING").select(X.message_from_json("j").alias("m")).first()["m"]
    assert back["message_id"] == "t_0"
    bad = spark.createDataFrame([("{not json",)], "j STRING").select(X.parse_json_doc("j", "a INT").alias("x"))
    try:
        bad.collect()
        raise AssertionError("FAILFAST should fail")
    except AssertionError:
        raise
    except Exception:
        pass
    assert spark.range(1).select(R.core_url(F.lit(3)).alias("u")).first()["u"] == R.CORE_RANKS + "3"
    a = [r["id"] for r in seeds.shuffled(spark.range(50), 7).collect()]
    b = [r["id"] for r in seeds.shuffled(spark.range(50), 7).collect()]
    assert a == b and sorted(a) == list(range(50))


def test_pairing_counts_lists_lookup(spark):
    names = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b")], "q STRING, pos INT, name STRING")
    orgs = spark.createDataFrame([("q", 0, "x")], "q STRING, pos INT, org STRING")
    z = sorted((r["pos"], r["name"], r["org"]) for r in resolve.zip_positional(names, orgs, ["q"]).collect())
    assert z == [(0, "a", "x"), (1, "b", None)]
    pages = spark.createDataFrame([("l", 1), ("l", 1), ("l", 2), ("m", 1)], "l STRING, p INT")
    assert sorted((r["l"], r["n_items"], r["n_pages"]) for r in paging.page_counts(pages, ["l"], "p").collect()) == \
        [("l", 3, 2), ("m", 1, 1)]
    items = spark.createDataFrame([("k", i, f"v{i}") for i in range(7)] + [("j", 0, "w")], "k STRING, o INT, v STRING")
    lists = {(r["k"], r["chunk"]): [x["v"] for x in r["items"]]
             for r in paging.bounded_lists(items, ["k"], ["o"], ["v"], 3).collect()}
    assert lists == {("k", 0): ["v0", "v1", "v2"], ("k", 1): ["v3", "v4", "v5"], ("k", 2): ["v6"], ("j", 0): ["w"]}
    keys = spark.createDataFrame([("db", "a"), ("db", "zz")], "entity_db STRING, _id STRING")
    docs = spark.createDataFrame([("db", "a", "r1")], "entity_db STRING, _id STRING, _rev STRING")
    got = sorted(((r["_id"], r["_rev"]) for r in store.lookup(keys, docs).collect()), key=str)
    assert got == [("a", "r1"), ("zz", None)]


def test_names_of_parts_are_spread_before_they_are_read(spark, tmp_path):
    """One small file is one task: the costly rules come after the spread."""
    rows = [(n, "small bolt" if n % 2 else "x 1", "STEEL", n) for n in range(40)]
    spark.createDataFrame(rows, "p_partkey LONG, p_name STRING, p_type STRING, p_size INT").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = catalog.QUERIES["person_names"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and "regexp_extract_all" not in plan[plan.index("Repartition"):]
    got = sorted((r["p_partkey"], r["pos"], r["name"]) for r in out.collect())
    assert got == sorted(x for n in range(40) for x in ([(n, 0, "STEEL small"), (n, 1, "small bolt")] if n % 2 else [(n, 0, "STEEL x")]))
