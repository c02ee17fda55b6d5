"""Seeds, interface selection, next-item derivation and the registry."""

from pyspark.sql import functions as F

from bibspark import schemas as S
from bibspark.operators import frontier, metrics
from bibspark.plans import registry
from bibspark.sources import seeds


def test_seed_ranges(spark):
    assert [r["value"] for r in seeds.years(spark, 2002).collect()] == ["1999", "2000", "2001"]
    assert [r["value"] for r in seeds.pages(spark, 3).orderBy("pos").collect()] == ["3", "2", "1"]
    assert [r["value"] for r in seeds.config_list(spark, "a, b").collect()] == ["a", " b"]


def test_seed_work_and_interfaces(spark):
    authors = spark.createDataFrame([("Ada Love",)], "value STRING")
    w = seeds.seed_work(spark, "dblp,scimago,nope", authors, 2001, n_pages=2, as_of="2024-01-01 00:00:00")
    got = sorted((r["iface"], r["expected_id"], tuple(r["params"]), r["priority"], r["depth"]) for r in w.collect())
    assert got == [("dblp", "Ada Love", ("Ada Love",), 101, 1),
                   ("scimago", "1999_1", ("1999", "1"), 102, 1), ("scimago", "2000_1", ("2000", "1"), 102, 1)]
    assert sorted(r["iface"] for r in seeds.enabled_interfaces(spark, "core_edu,x").collect()) == ["core_edu"]


def test_next_items(spark):
    authors = spark.createDataFrame(
        [(2, [("T", "https://s/x?citation_for_view=U:1", "U:1")], ["Bob Low", "Cy Dee"])],
        "depth INT, publications ARRAY<STRUCT<title:STRING,url:STRING,publication_id:STRING>>, coauthors ARRAY<STRING>")
    known = spark.createDataFrame([("Cy Dee",)], "author STRING")
    items = {(r["phase_ref"], r["expected_id"]): r for r in frontier.next_items_scholar_author(authors, known).collect()}
    assert set(items) == {(S.CLASS_PUB, "U:1"), (S.CLASS_AUTHOR, "Bob Low")}
    assert items[(S.CLASS_PUB, "U:1")]["depth"] == 2 and items[(S.CLASS_PUB, "U:1")]["priority"] == 101
    assert items[(S.CLASS_AUTHOR, "Bob Low")]["depth"] == 3
    pubs = spark.createDataFrame([(2, ["A", "B"])], "depth INT, authors ARRAY<STRING>")
    assert sorted((r["expected_id"], r["depth"]) for r in frontier.next_items_scholar_pub(pubs).collect()) == \
        [("A", 3), ("B", 3)]
    docs = spark.createDataFrame([(1, [(["A", "B"],), (["B", "C"],)])], "depth INT, publications ARRAY<STRUCT<authors:ARRAY<STRING>>>")
    assert sorted(r["expected_id"] for r in frontier.next_items_dblp(docs).collect()) == ["A", "B", "C"]
    assert frontier.next_items_core(docs).count() == 0


def test_cutoff_and_new_items(spark):
    items = spark.createDataFrame([(100, "scraper"), (5000, "scraper"), (5000, "out")],
                                  "t LONG, destination_queue STRING").withColumn("ts", F.timestamp_seconds("t"))
    kept = frontier.work_time_cutoff(items, F.timestamp_seconds(F.lit(0)), 1000)
    assert sorted((r["t"], r["destination_queue"]) for r in kept.collect()) == [(100, "scraper"), (5000, "out")]
    assert frontier.work_time_cutoff(items, F.timestamp_seconds(F.lit(0)), -1).count() == 3
    cand = spark.createDataFrame([("a",), ("b",), ("b",)], "k STRING")
    reg = spark.createDataFrame([("a",)], "k STRING")
    assert sorted((r["k"], r["is_new"]) for r in metrics.new_items(cand, reg, ["k"]).collect()) == [("a", False), ("b", True)]


def test_registry(spark):
    assert set(registry.sources()) == {S.IFACE_DBLP, S.IFACE_SCHOLAR, S.IFACE_SCIMAGO, S.IFACE_CORE}
    spec = registry.SourceSpec("toy", 999, {1: lambda p: p.select((F.col("x") * 2).alias("x"))},
                               enrich=lambda r: r.withColumn("tag", F.lit("t")))
    registry.register_source(spec)
    out = registry.extract("toy", 1, spark.createDataFrame([(1,)], "x INT")).collect()
    assert out[0]["x"] == 2 and out[0]["tag"] == "t"


def test_sql_view(spark):
    row = "<tr>" + "".join(f"<td>{i}</td>" for i in range(13)) + "</tr>"
    html = ('<div class="pagination">1 - 1 of 1</div><div class="table_wrap"><table><thead><tr>'
            f'<th title="SJR 2020">x</th></tr></thead><tbody>{row}</tbody></table></div>')
    spark.createDataFrame([("r1", 1, html)], "request_id STRING, page_no INT, html STRING") \
        .createOrReplaceTempView("scimago_pages_t")
    registry.sql_view(spark, S.IFACE_SCIMAGO, S.CLASS_JOURNAL, "scimago_pages_t", "scimago_journals_t")
    r = spark.sql("SELECT request_id, year, is_end, title FROM scimago_journals_t").collect()
    assert [(x["request_id"], x["year"], x["is_end"], x["title"]) for x in r] == [("r1", 2020, True, "1")]
