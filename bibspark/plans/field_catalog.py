"""Registered queries that compare every field of the extractors whose first
queries compare some (X5, X12, X14), recovered lines (P4), and the registry's
surface: items of publications and of sources without any, a source that is
added and enriched, its SQL view (G2, G5, E2, E3, E5). Same roles of the driver
tables as in :mod:`bibspark.plans.catalog`; importing this module registers
them there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import store
from ..operators.extract import core, scholar, scimago
from ..session import table
from . import fixtures, registry
from .catalog import AS_OF_YEAR, register


# ----------------------------------------------------------------------- X12
@register("scimago_fields", oracle="""
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus, substr(o_orderpriority, 1, 1) AS prio, year(o_orderdate) AS y,
         row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) - 1 AS seq
  FROM orders
)
SELECT CAST(y AS INTEGER) AS year, CAST(seq // 50 + 1 AS INTEGER) AS page_no, CAST(seq % 50 AS INTEGER) AS pos, 'Journal ' || CAST(k AS VARCHAR) AS title, 'journal' AS type,
       TRY_CAST(replace(substr(CAST(c AS VARCHAR) || ',' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || CASE WHEN prio IN ('1', '2', '3', '4') THEN 'Q' || prio ELSE '' END, 1, 5), ',', '.') AS DOUBLE) AS sjr,
       CAST(c % 300 AS INTEGER) AS h_index, CAST(k % 1000 AS INTEGER) AS total_docs, CAST(k % 777 AS INTEGER) AS total_docs_3years, CAST(c % 5000 AS INTEGER) AS total_refs,
       CAST(k % 333 AS INTEGER) AS total_cites_3years, CAST(c % 91 AS INTEGER) AS citable_docs_3years,
       CAST(k % 10 + 0.25 AS DOUBLE) AS cites_per_doc_2years, CAST(c % 40 + 0.5 AS DOUBLE) AS refs_per_doc, CAST(k % 100 + 0.5 AS DOUBLE) AS female_percent
FROM o WHERE NOT (o_orderstatus = 'P' AND prio = '5')
""")
def q_scimago_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text field of the ranking rows, typed."""
    rows = scimago.typed(scimago.journals(fixtures.scimago_pages(spark, sf_dir), ["page_no"]))
    return rows.select(F.col("year").cast("int").alias("year"), F.col("page_no").cast("int").alias("page_no"), F.col("pos").cast("int").alias("pos"), "title", "type", "sjr",
                       *scimago.TEXT_FIELDS)


# ----------------------------------------------------------------------- X14
@register("core_fields", oracle="""
WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS seq FROM customer)
SELECT 'row' AS kind, CAST(seq // 50 + 1 AS INTEGER) AS page_no, c_name AS title, '' AS note, CAST(c_nationkey AS VARCHAR) AS primary_for, 'ok' AS comments,
       CAST(c_custkey % 10 AS VARCHAR) || '.' || CAST(c_nationkey AS VARCHAR) AS average_rating, NULL::VARCHAR AS next_page
FROM c WHERE NOT (c_mktsegment = 'HOUSEHOLD' AND c_custkey % 7 = 0)
UNION ALL
SELECT DISTINCT 'page', CAST(seq // 50 + 1 AS INTEGER), NULL, NULL, NULL, NULL, NULL, CAST(seq // 50 + 2 AS VARCHAR) FROM c
""")
def q_core_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that ``core_rows`` leaves out, and the page after each
    page (none for the one that shows an error)."""
    rows, info = core.conferences(fixtures.core_pages(spark, sf_dir), ["page_no"])
    page, none = F.col("page_no").cast("int").alias("page_no"), F.lit(None).cast("string")
    fields = ["title", "note", "primary_for", "comments", "average_rating"]
    own = rows.select(F.lit("row").alias("kind"), page, *fields, none.alias("next_page"))
    return own.unionByName(info.select(F.lit("page").alias("kind"), page, *[none.alias(f) for f in fields], "next_page"))


# ------------------------------------------------------------------------ X5
@register("scholar_graph", oracle="""
SELECT 'U' || CAST(o_custkey AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) AS publication_id, CAST(y AS VARCHAR) AS year, CAST(c AS INTEGER) AS citations,
       '/scholar?as_sdt=0,5&hl=it&as_ylo=' || CAST(y AS VARCHAR) || '&as_yhi=' || CAST(y AS VARCHAR) || '&cites=' || CAST(o_orderkey * 7 AS VARCHAR) AS citation_link
FROM orders JOIN (SELECT l_orderkey, year(l_shipdate) AS y, count(*) AS c FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey
""")
def q_scholar_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, count and link of every bar of the citation graph."""
    pubs = scholar.publication(fixtures.scholar_detail_pages(spark, sf_dir), ["o_orderkey"], "url", AS_OF_YEAR)
    # outer: else the graph is made again to look for empty ones
    bars = pubs.select("publication_id", F.posexplode_outer("citation_graph").alias("pos", "g")).where(F.col("pos").isNotNull())
    return bars.select("publication_id", F.col("g.year").cast("string").alias("year"), F.col("g.citations").cast("int").alias("citations"), F.col("g.citation_link").alias("citation_link"))


# -------------------------------------------------------------------- P3 P4
@register("recovered_lines", oracle="""
SELECT CASE WHEN o_orderstatus = 'P' THEN 'line' ELSE 'quarantine' END AS kind,
       to_json(struct_pack(_id := CAST(o_orderkey AS VARCHAR), type := o_orderpriority, update_count := CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 7 END,
                           sent := CASE WHEN o_orderstatus = 'P' THEN false END)) AS line
FROM orders WHERE o_orderstatus IN ('P', 'O')
""")
def q_recovered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the documents that recovery picks (``sent`` false,
    nothing else), written from their stored rows; P3: documents without the
    flag go to quarantine, sent ones nowhere."""
    o = table(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").cast("string").alias("_id"), F.col("o_orderpriority").alias("type"),
                    F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 7).cast("bigint").alias("update_count"),
                    F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False).alias("sent"))
    ready, quarantine = store.to_package(docs)
    again = store.unsent(docs).join(ready.select("_id"), "_id", "left_semi")  # recovery and packaging agree
    return again.select(F.lit("line").alias("kind"), store.ndjson(again).alias("line")).unionByName(
        quarantine.select(F.lit("quarantine").alias("kind"), store.ndjson(quarantine).alias("line")))


# ------------------------------------------------------------ G2 G5 E2 E3 E5
@register("registry_sources", oracle="""
WITH a AS (SELECT DISTINCT l_orderkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
known AS (SELECT s_name FROM supplier WHERE s_suppkey % 4 = 0),
c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS seq FROM customer)
SELECT 'publication author' AS kind, s_name AS name, CAST(102 AS INTEGER) AS priority, CAST(min(1 + l_orderkey % 3) + 1 AS INTEGER) AS depth
FROM a WHERE s_name NOT IN (SELECT s_name FROM known) GROUP BY s_name
UNION ALL
SELECT 'ranked', upper(c_name) || '/' || ['A*', 'A', 'B', 'C'][c_nationkey % 4 + 1], NULL, NULL FROM c WHERE NOT (c_mktsegment = 'HOUSEHOLD' AND c_custkey % 7 = 0)
""")
def q_registry_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One author item per author of a publication, at its least depth,
    without known authors. G5: conference rows derive nothing. E2, E3, E5: a
    source is registered with its own enrichment, and its records are read
    from SQL through a view over a pages view."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    pubs = lines.groupBy("l_orderkey").agg(F.collect_list("s_name").alias("authors")).withColumn("depth", (F.col("l_orderkey") % 3 + 1).cast("int"))  # the authors of one publication
    known = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 4 == 0).select(F.col("s_name").alias("author"))
    items = registry.next_items(S.IFACE_SCHOLAR, S.CLASS_PUB, pubs, known_authors=known)
    authors = items.select(F.lit("publication author").alias("kind"), F.col("expected_id").alias("name"), "priority", "depth")

    def enrich(rows: DataFrame) -> DataFrame:
        return rows.withColumn("name", F.concat_ws("/", F.upper("title"), "rank"))

    registry.register_source(registry.SourceSpec("core_ranked", S.VARIANT_CORE, registry.source(S.IFACE_CORE).extractors, enrich=enrich))
    fixtures.core_pages(spark, sf_dir).withColumn("request_id", F.col("page_no").cast("string")).createOrReplaceTempView("core_pages_in")
    registry.sql_view(spark, "core_ranked", S.CLASS_CONFERENCE, "core_pages_in", "core_ranked_out")
    registry.unregister_source("core_ranked")  # the view stays; the registry is the session's
    ranked = spark.sql("SELECT 'ranked' AS kind, name, CAST(NULL AS INT) AS priority, CAST(NULL AS INT) AS depth FROM core_ranked_out")
    derived = registry.next_items(S.IFACE_CORE, S.CLASS_CONFERENCE, spark.table("core_ranked_out"))
    nothing = derived.select(F.lit("derived").alias("kind"), F.col("expected_id").alias("name"), "priority", "depth")
    return authors.unionByName(ranked).unionByName(nothing)
