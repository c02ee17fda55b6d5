"""Keyed sinks of pages and names, the extended walk, the keyed shuffle."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from bibspark.operators import frontier
from bibspark.sources import seeds
from bibspark.streaming import ingest

PAGES = "entity_db STRING, _id STRING, seq INT, html STRING, payload INT, update_count INT"
AS_OF = "2024-02-15 00:00:00"


def lengths(pages):
    return pages.select("entity_db", "_id", "seq", F.lit("Page").alias("type"), F.length("html").cast("string").alias("payload"))


def current(spark, path):
    return {r["_id"]: (r["payload"], r["update_count"], r["serialized"], r["_rev"]) for r in ingest.documents(spark, path).collect()}


def test_documents_are_taken_replayed_and_kept(spark):
    path = tempfile.mkdtemp(prefix="bibspark-docs-") + "/d"
    stored = spark.createDataFrame([("x", "fresh", AS_OF, True, 3, "r1", "old"), ("x", "stale", "2001-01-01 00:00:00", True, 3, "r2", "old"), ("x", "open", AS_OF, False, None, None, "old")],
                                   "entity_db STRING, _id STRING, d STRING, serialized BOOLEAN, update_count INT, _rev STRING, payload STRING").withColumn("update_date", F.col("d").cast("timestamp")).drop("d")
    ingest.begin_documents(spark, path, stored)
    sink = ingest.documents_sink(path, lengths, AS_OF, ["seq"])
    first = spark.createDataFrame([("x", "fresh", 1, "aaaa", 0, 0), ("x", "stale", 1, "aaaaa", 0, 0), ("x", "open", 1, "a", 0, 0), ("x", "new", 1, "a", 0, 0), ("x", "twice", 2, "aaa", 0, 0),
                                   ("x", "twice", 1, "aaaaaa", 0, 0), (None, "n", 1, "a", 0, 0), ("x", None, 1, "a", 0, 0), ("x", "void", 1, None, 0, 0)], PAGES)
    sink(first, 0)
    after_first = {"fresh": ("old", 3, True, "r1"), "stale": ("5", 1, False, "r2"), "open": ("1", 1, False, None), "new": ("1", None, False, None), "twice": ("3", 1, False, None), "void": (None, None, False, None)}
    assert current(spark, path) == after_first
    sink(first, 0)
    assert current(spark, path) == after_first
    sink(spark.createDataFrame([("x", "new", 1, "aa", 0, 0)], PAGES), 1)
    sink(first, 0)  # a replay of an older batch changes nothing of later ones
    assert current(spark, path) == after_first | {"new": ("2", 1, False, None)}
    sink(spark.createDataFrame([], PAGES), 2)
    assert current(spark, path) == after_first | {"new": ("2", 1, False, None)}
    rows = spark.read.parquet(path).groupBy("batch_id").count().collect()
    assert {r["batch_id"]: r["count"] for r in rows} == {-1: 3, 0: 5, 1: 1}  # only what a batch changes is written


def test_empty_store(spark):
    path = tempfile.mkdtemp(prefix="bibspark-docs-") + "/d"
    ingest.begin_documents(spark, path)
    assert ingest.documents(spark, path).count() == 0


def author_page(entries):
    lis = "".join(f'<li class="entry article"><cite class="data tts-content"><span itemprop="author"><span itemprop="name">A</span></span> <span class="title">{t}</span> '
                  f'<a href="{u}"><span itemprop="isPartOf"><span itemprop="name">{s}</span></span></a></cite></li>' for t, s, u in entries)
    return f'<div id="publ-section"><ul>{lis}</ul></div>'


def journal_page(name):
    return f'<header id="headline"><h1>{name}, Volume 1</h1></header>'


def test_names_outlive_a_batch(spark):
    base = tempfile.mkdtemp(prefix="bibspark-names-")
    schema = "kind STRING, a STRING, url STRING, html STRING, full_name STRING, short_name STRING"
    batch = lambda entries, journals: spark.createDataFrame(
        [("author", a, None, author_page(e), "z", "z") for a, e in entries] + [("journal", None, u, journal_page(n), "z", "z") for u, n in journals], schema)
    ingest.begin_names(spark, f"{base}/n")
    sink = ingest.publications_sink(f"{base}/n", f"{base}/p", ["a"])
    sink(batch([("x", [("one", "J. A", "/a"), ("two", "J. B", "/missing")])], [("/a", "Journal of A")]), 0)
    second = batch([("y", [("three", "J. A", "/other"), ("four", "J. B", "/b"), ("five", "J. C", "/gone")])], [("/other", "Another name"), ("/b", "Journal of B")])
    sink(second, 1)
    sink(second, 1)
    sink(batch([("x", [("six", "J. B", "/b2")])], [("/b2", "Later name of B")]), 2)
    got = sorted((r["batch_id"], r["title"], r["journal_name"]) for r in spark.read.parquet(f"{base}/p").collect())
    assert got == [(0, "one", "Journal of A"), (1, "four", "Journal of B"), (1, "three", "Journal of A"), (2, "six", "Journal of B")]
    assert len(ingest.names(spark, f"{base}/n").collect()) == 2


def walk(seeds_, edges, limit):
    depth, level = {s: 1 for s in seeds_}, set(seeds_)
    for d in range(2, limit + 1):
        pubs = {p for p, a in edges if a in level}
        level = {a for p, a in edges if p in pubs} - set(depth)
        depth |= {a: d for a in level}
    return depth


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walk_after_new_publications(spark, seed):
    rng = random.Random(seed)
    edges = [(f"p{k // 2}", f"a{rng.randrange(60)}") for k in range(90)]
    batches = [edges[:30], edges[30:70], [], edges[70:] + edges[:5]]
    frame = lambda rows: spark.createDataFrame(rows, "pub STRING, author STRING")
    depths = spark.createDataFrame([("a1", 1), ("a2", 1)], "author STRING, depth INT")
    so_far = []
    for b in batches:
        before = {r["author"]: r["depth"] for r in depths.collect()}
        changed = frontier.extend_walk(depths, frame(so_far), frame(b), 5)
        depths = frontier.merge_walk(depths, changed)
        so_far += b
        want = walk(["a1", "a2"], so_far, 5)
        assert {r["author"]: r["depth"] for r in depths.collect()} == want
        assert {r["author"] for r in changed.collect()} == {a for a, d in want.items() if before.get(a) != d}  # only changed authors


def test_shuffle_places(spark):
    df = spark.createDataFrame([(k % 50, None if k % 7 == 0 else f"n{k}") for k in range(300)], "k INT, name STRING")
    one = seeds.shuffle_places(df.repartition(5), ["k", "name"], 1)
    other = seeds.shuffle_places(df.repartition(2).orderBy("name"), ["k", "name"], 1)
    rows = lambda d: sorted((r["place"], r["k"], r["name"] or "") for r in d.collect())
    assert rows(one) == rows(other) and [r[0] for r in rows(one)] == list(range(300))
    assert rows(one) != rows(seeds.shuffle_places(df, ["k", "name"], 2))
    assert seeds.shuffle_places(df.limit(0), ["k"], 1).count() == 0


def test_root_names_of_pages(spark):
    pages = spark.createDataFrame([(1, '<p>{"a":"Ada Love"} {"b":"Bob Low","c":3}</p><script>x={"n":"Cy Dee"}</script><!-- {"n":"Ada Love"} {"n":"A B C"} {n:1} -->'), (2, ""), (3, None)], "page INT, html STRING")
    got = [(r["page"], r["pos"], r["name"]) for r in seeds.root_names(pages, ["page"]).orderBy("page", "pos").collect()]
    assert got == [(1, 0, "Ada Love"), (1, 1, "Cy Dee"), (1, 2, "Bob Low"), (1, 3, "Ada Love")]
