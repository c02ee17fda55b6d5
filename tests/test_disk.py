"""What a query keeps and moves on its way to the result: bytes on disk."""

import os
import re
from pathlib import Path

from pyspark.sql import functions as F

from bibspark.operators import metrics
from bibspark.plans import fixtures
from bibspark.session import shared_dir, stored


def kept(spark) -> int:
    top = shared_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(p) for p in Path(top).rglob("*") if p.is_file())


def lines(spark, n):
    """Lines of few parts, with supplier names, as the fixtures number them."""
    k = F.col("id")
    return spark.range(n).select((k % 700).alias("l_partkey"), k.alias("l_orderkey"), (k % 7).alias("l_linenumber"),
                                 F.format_string("Supplier#%09d", k % 50).alias("s_name"), F.lit("N").alias("l_returnflag"))


def test_numbered_rows_are_kept_in_less_than_their_size_in_memory(spark):
    n, before = 20_000, kept(spark)
    out = metrics.sequence_number(lines(spark, n), ["l_partkey"], ["l_orderkey"])
    assert kept(spark) - before < 40 * n  # 100 bytes a row as they are in memory
    assert out.where("seq <> floor(l_orderkey / 700)").count() == 0 and out.count() == n


def test_stored_rows_and_names_come_back(spark):
    df = spark.createDataFrame([(1, None, ["a"], {"k": "v"}), (None, "x", None, None)], "a long, b string, c array<string>, d map<string,string>")
    twice = df.select("a", F.col("b").alias("a"), "c", "d", F.lit(2).alias("A"))
    back = stored(twice)
    assert back.columns == ["a", "a", "c", "d", "A"]
    assert sorted(map(str, back.collect())) == sorted(map(str, twice.collect()))
    assert stored(df.where("a > 5")).count() == 0


def moved(df) -> list[str]:
    """What the exchanges of a plan take in, by their numbers in the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)


def test_rendered_items_and_pages_do_not_move(spark):
    rows = lines(spark, 300).withColumnsRenamed({"l_linenumber": "page_no", "l_orderkey": "seq"})
    keys = ["l_partkey", "page_no"]
    pages = fixtures.pages_of(rows, keys, F.concat(F.lit("<li>"), F.col("s_name"), F.lit("</li>")), "<ul>", "</ul>")
    assert [sorted(re.findall(r"([a-z_]+)#", x)) for x in moved(pages)] == [["l_partkey", "page_no", "s_name", "seq"]]
    found = pages.where("l_partkey = 3 and page_no = 3").collect()
    assert [r["html"] for r in found] == ["<ul><li>Supplier#000000003</li></ul>"]


def test_the_last_page_alone_lacks_the_icon(spark, tmp_path):
    sizes = {1: 10, 2: 11, 3: 25, 5: 10, None: 3}
    rows = [(k, o, s, o % 3 + 1) for s, (k, n) in enumerate(sizes.items()) for o in range(n)]
    li = spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long")
    li.withColumns({"l_quantity": F.lit(5.0), "l_extendedprice": F.lit(1.0), "l_returnflag": F.lit("N")}).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 4).select(F.col("id").alias("s_suppkey"), F.lit("S").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    pages = fixtures.scholar_citation_pages(spark, str(tmp_path))
    assert all("html" not in x and "item" not in x for x in moved(pages))
    got = {(r["l_partkey"], r["page_no"]): (r["html"].count("Summary"), "gs_ico_nav_first" in r["html"]) for r in pages.collect()}
    assert got == {(1, 1): (10, False), (1, 3): (0, True), (2, 1): (10, True), (2, 2): (1, False), (2, 4): (0, True),
                   (3, 1): (10, True), (3, 2): (10, True), (3, 3): (5, False), (3, 5): (0, True),
                   (5, 1): (10, True), (5, 2): (0, True), (5, 3): (0, True), (None, 3): (0, True)}
