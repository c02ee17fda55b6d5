"""Registered queries: one Spark job per operator group of the inventory,
each over whole driver tables, with its DuckDB oracle SQL.

Stand-in roles (FIXTURES §4): supplier = author, orders = publication,
lineitem = authorship, part = venue/title text, customer = author candidate
(``c_mktsegment`` = organisation), events = messages and page fetches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frontier, metrics, paging, resolve, store
from ..operators.extract import core, dblp, quality, scholar, scimago
from . import fixtures
from ..sources.pages import read_pages, spread
from ..session import table
from ..functions import text as X
from ..functions import urls as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# Fixed query parameters (not tuned per run).
AS_OF = "2024-02-15 00:00:00"
AS_OF_YEAR = 1998
SEED_AUTHORS = "Supplier#000000000,Supplier#000000001"


# ----------------------------------------------------------------- G3 G6-G8 P5
@register("coauthor_bfs", oracle=f"""
WITH RECURSIVE seeds AS (
  SELECT s_suppkey AS author FROM supplier
  WHERE s_name IN (SELECT unnest(string_split('{SEED_AUTHORS}', ',')))
), edges AS (SELECT DISTINCT l_orderkey AS pub, l_suppkey AS author FROM lineitem),
walk(author, depth) AS (
  SELECT author, 1 FROM seeds
  UNION
  SELECT e2.author, w.depth + 1
  FROM walk w JOIN edges e1 ON e1.author = w.author JOIN edges e2 ON e2.pub = e1.pub
  WHERE w.depth < 4
)
SELECT CAST(author AS BIGINT) AS author_id, CAST(min(depth) AS INTEGER) AS depth
FROM walk GROUP BY author
""")
def coauthor_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DBLP-style walk: seed names from a config string (S8) resolved to
    author ids, then bounded BFS over (publication, author) edges."""
    seeds = (spark.createDataFrame([(SEED_AUTHORS,)], "names STRING")
             .select(F.explode(X.split_seed_list("names")).alias("s_name"))
             .join(table(spark, sf_dir, "supplier").select("s_name", "s_suppkey"), "s_name")
             .select(F.col("s_suppkey").alias("author")))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pub"),
                                                     F.col("l_suppkey").alias("author"))
    out = frontier.expand(seeds, edges, max_depth=4)
    return out.select(F.col("author").cast("bigint").alias("author_id"), "depth")


WALK_LIMITS = (2, 4)


@register("part_walk", oracle=f"""
WITH RECURSIVE edges AS (SELECT DISTINCT l_orderkey AS pub, l_partkey AS author FROM lineitem),
walk(author, depth) AS (
  SELECT p_partkey, 1 FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)
  UNION
  SELECT DISTINCT e2.author, w.depth + 1
  FROM walk w JOIN edges e1 ON e1.author = w.author JOIN edges e2 ON e2.pub = e1.pub
  WHERE w.depth < {max(WALK_LIMITS)}
), least AS (SELECT author, min(depth) AS depth FROM walk GROUP BY author)
SELECT CAST(l.n AS INTEGER) AS max_depth, CAST(depth AS INTEGER) AS depth, CAST(author AS BIGINT) AS author_id
FROM least JOIN (VALUES {", ".join(f"({n})" for n in WALK_LIMITS)}) l(n) ON depth <= l.n
""")
def part_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk with parts as authors and orders as publications, from the
    first part, with a limit that leaves reachable authors out and one that
    takes several levels more (G7, G8, P5)."""
    lines = table(spark, sf_dir, "lineitem")
    pubs = lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("authors"))  # the parts of one order
    edges = frontier.authorship_edges(pubs, "l_orderkey", "authors")
    seeds = table(spark, sf_dir, "part").agg(F.min("p_partkey").alias("author"))
    out = [frontier.expand(seeds, edges, max_depth=n).select(
        F.lit(n).cast("int").alias("max_depth"), F.col("depth").cast("int").alias("depth"), F.col("author").cast("bigint").alias("author_id"))
        for n in WALK_LIMITS]
    return out[0].unionByName(out[1])


# ------------------------------------------------------------------ F1, F2
@register("sanitize_text", oracle="""
WITH src AS (
  SELECT 'part' AS src, p_partkey AS id,
         p_name || ' (' || p_brand || ') ' || CAST(p_size AS VARCHAR) || ', ' || CAST(p_partkey AS VARCHAR) || '.' AS raw
  FROM part
  UNION ALL
  SELECT 'orders', o_orderkey,
         o_orderpriority || ' ' || o_orderstatus || '. ' || CAST(year(o_orderdate) AS VARCHAR) || ', ' || CAST(o_orderkey AS VARCHAR)
  FROM orders
)
SELECT src, CAST(id AS BIGINT) AS id,
       CASE WHEN raw IS NULL OR raw = '' THEN 'Unknown'
            ELSE trim(regexp_replace(regexp_replace(raw, '\\(.*?\\)|[.,]', '', 'g'),
                                     '\\b\\d{1,3}\\b|\\b\\d{5,}\\b', '', 'g')) END AS clean
FROM src
""")
def q_sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        F.lit("part").alias("src"), F.col("p_partkey").alias("id"),
        F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") "), F.col("p_size").cast("string"), F.lit(", "),
                 F.col("p_partkey").cast("string"), F.lit(".")).alias("raw"))
    orders = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("src"), F.col("o_orderkey").alias("id"),
        F.concat("o_orderpriority", F.lit(" "), "o_orderstatus", F.lit(". "),
                 F.year("o_orderdate").cast("string"), F.lit(", "), F.col("o_orderkey").cast("string")).alias("raw"))
    return part.unionByName(orders).select("src", F.col("id").cast("bigint").alias("id"),
                                           X.sanitize_text("raw").alias("clean"))


@register("conference_acronym", oracle="""
WITH src AS (
  SELECT 'part' AS src, p_partkey AS id, p_name AS venue FROM part
  UNION ALL
  SELECT 'orders', o_orderkey, CASE WHEN o_orderstatus = 'O' THEN '   ' ELSE o_orderpriority END FROM orders
)
SELECT src, CAST(id AS BIGINT) AS id,
       coalesce(nullif(regexp_extract(venue, '\\S+', 0), ''), 'Unknown') AS acronym
FROM src
""")
def q_conference_acronym(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.lit("part").alias("src"), F.col("p_partkey").alias("id"),
                                                 F.col("p_name").alias("venue"))
    orders = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("src"), F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", F.lit("   ")).otherwise(F.col("o_orderpriority")).alias("venue"))
    return part.unionByName(orders).select("src", F.col("id").cast("bigint").alias("id"),
                                           X.conference_acronym("venue").alias("acronym"))


# ------------------------------------------------------------ F12-F14, S11
@register("person_names", oracle="""
WITH t AS (
  SELECT p_partkey, p_name, p_type || ' ' || split_part(p_name, ' ', 1) AS maker FROM part
), found AS (
  SELECT p_partkey, p_name AS name, 0 AS obj FROM t
  WHERE p_name SIMILAR TO '[A-Za-z\\s]+' AND len(string_split(p_name, ' ')) = 2
  UNION ALL
  SELECT p_partkey, maker, 1 FROM t
  WHERE maker SIMILAR TO '[A-Za-z\\s]+' AND len(string_split(maker, ' ')) = 2
)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey,
       CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY obj DESC) - 1 AS INTEGER) AS pos,
       name
FROM found
""")
def q_person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root names (S11) from script text holding JSON-like objects: the
    objects are found (F13), parsed (F14), filtered (F12) and reversed. The
    table is small in bytes and a file is one task: rows are spread first."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type"))
    script = F.concat(F.lit('<script>var roots=[{"name":"'), F.col("p_name"), F.lit('","size":'),
                      F.col("p_size").cast("string"), F.lit('},{"maker":"'), F.col("p_type"), F.lit(" "),
                      F.split("p_name", " ").getItem(0), F.lit('"},{"nested":{"x":"Not Me"}}];</script>'))
    names = part.select("p_partkey", X.root_names(script).alias("names"))
    # outer: else the optimizer looks for empty lists with the whole expression, before the rows are spread
    return names.select(F.col("p_partkey").cast("bigint").alias("p_partkey"),
                        F.posexplode_outer("names").alias("pos", "name")).where(F.col("pos").isNotNull()).select(
        "p_partkey", F.col("pos").cast("int").alias("pos"), "name")


# -------------------------------------------------------- F5-F7, R1-R7
@register("url_ids", oracle="""
SELECT 'page' AS src, CAST(page_id AS BIGINT) AS id,
       nullif(regexp_extract(url, 'page=(\\d+)', 1), '') AS a,
       CASE WHEN contains(url, '=') THEN regexp_extract(url, '=([^=]*)$', 1) END AS b,
       NULL::VARCHAR AS c, NULL::VARCHAR AS d
FROM pages
UNION ALL
SELECT 'customer', CAST(c_custkey AS BIGINT),
       'https://scholar.google.com/scholar?hl=it&as_sdt=0%252C5&q=' || replace(c_name || ' ' || c_mktsegment, ' ', '+'),
       'https://dblp.org/search?q=' || replace(replace(replace(c_name || ' ' || lower(c_mktsegment) || '/~*', '#', '%23'), ' ', '%20'), '*', '%2A'),
       'U' || CAST(c_custkey AS VARCHAR) || '-x',
       'https://scholar.google.com/citations?hl=it&user=U' || CAST(c_custkey AS VARCHAR) || '-x&cstart=100&pagesize=100'
FROM customer
""")
def q_url_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("src"), F.col("page_id").cast("bigint").alias("id"),
        X.extract_id_from("url", "page").alias("a"), X.after_last_eq("url").alias("b"),
        F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("d"))
    cust = table(spark, sf_dir, "customer")
    user = F.concat(F.lit("U"), F.col("c_custkey").cast("string"), F.lit("-x"))
    profile = R.scholar_profile_url(user)
    built = cust.select(
        F.lit("customer").alias("src"), F.col("c_custkey").cast("bigint").alias("id"),
        R.scholar_search_url(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("a"),
        R.dblp_search_url(F.concat(F.col("c_name"), F.lit(" "), F.lower("c_mktsegment"), F.lit("/~*"))).alias("b"),
        X.user_id(R.absolute(F.concat(F.lit("/citations?user="), user, F.lit("&hl=it")))).alias("c"),
        F.get(R.paged_urls(profile, 2, "publications"), 1).alias("d"))
    return pages.unionByName(built)


# ------------------------------------------------------------------ F4, F8
@register("affiliation_split", oracle="""
WITH t AS (
  SELECT c_custkey,
         CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' @ ' || c_name
                            WHEN 1 THEN ' ' || c_mktsegment || ' , ' || c_name
                            ELSE c_mktsegment || ' ' || c_name END AS aff,
         ' <' || c_name || '>?/' || c_mktsegment || ' ' AS raw_name
  FROM customer
)
SELECT CAST(c_custkey AS BIGINT) AS c_custkey,
       CASE WHEN len(string_split(aff, '@')) = 2 THEN trim(string_split(aff, '@')[1])
            WHEN len(string_split(aff, ',')) = 2 THEN trim(string_split(aff, ',')[1])
            ELSE '?' END AS role,
       CASE WHEN len(string_split(aff, '@')) = 2 THEN trim(string_split(aff, '@')[2])
            WHEN len(string_split(aff, ',')) = 2 THEN trim(string_split(aff, ',')[2])
            ELSE aff END AS org,
       regexp_replace(trim(raw_name), '[<>:"/\\\\|?*]', '', 'g') AS clean_name
FROM t
""")
def q_affiliation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    aff = (F.when(k == 0, F.concat("c_mktsegment", F.lit(" @ "), "c_name"))
           .when(k == 1, F.concat(F.lit(" "), "c_mktsegment", F.lit(" , "), "c_name"))
           .otherwise(F.concat("c_mktsegment", F.lit(" "), "c_name")))
    raw_name = F.concat(F.lit(" <"), "c_name", F.lit(">?/"), "c_mktsegment", F.lit(" "))
    s = X.affiliation_split(aff)
    return c.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), s["role"].alias("role"),
                    s["org"].alias("org"), X.sanitize_string(raw_name).alias("clean_name"))


# ------------------------------------------------------------------ F9, F10
@register("year_rules", oracle=f"""
WITH t AS (
  SELECT o_orderkey,
         strftime(o_orderdate, '%Y/%-m/%-d') AS date_text,
         'Vol ' || CAST(o_custkey AS VARCHAR) || ' (' || CAST(year(o_orderdate) AS VARCHAR) || ')' AS header
  FROM orders
)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey,
       CAST(CASE WHEN regexp_matches(date_text, '^\\d{{4}}') AND length(date_text) < 50
                  AND CAST(substr(date_text, 1, 4) AS INTEGER) BETWEEN 1950 AND {AS_OF_YEAR}
                 THEN CAST(substr(date_text, 1, 4) AS INTEGER) ELSE 0 END AS INTEGER) AS publication_date,
       CAST(nullif(regexp_extract(header, '\\b(\\d{{4}})\\b', 1), '') AS INTEGER) AS header_year
FROM t
""")
def q_year_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    date_text = F.date_format("o_orderdate", "yyyy/M/d")
    header = F.concat(F.lit("Vol "), F.col("o_custkey").cast("string"), F.lit(" ("),
                      F.year("o_orderdate").cast("string"), F.lit(")"))
    return o.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
                    F.coalesce(X.publication_year(date_text, AS_OF_YEAR), F.lit(0)).cast("int").alias("publication_date"),
                    X.first_year_word(header).alias("header_year"))


# ---------------------------------------------------------------- P1 J5 S3
def _event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents stand-in: one per event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("_id"),
        F.when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.col("ts")).alias("update_date"),
        F.when(F.col("event_type") == "error", F.lit(False))
        .when(F.col("event_type") == "view", F.lit(None).cast("boolean"))
        .otherwise(F.lit(True)).alias("serialized"),
        F.col("event_type").alias("stored_type"))


@register("freshness_work", oracle=f"""
WITH docs AS (
  SELECT event_id AS _id,
         CASE WHEN event_type = 'signup' THEN NULL ELSE ts END AS update_date,
         CASE WHEN event_type = 'error' THEN false WHEN event_type = 'view' THEN NULL ELSE true END AS serialized,
         event_type AS stored_type
  FROM events
)
SELECT CAST(o.o_orderkey AS BIGINT) AS o_orderkey,
       (d._id IS NULL OR d.update_date IS NULL OR NOT coalesce(d.serialized, false)
        OR abs(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(d.update_date)) > CAST(2592000000000 AS BIGINT)) AS stale,
       d.stored_type AS stored_type
FROM orders o LEFT JOIN docs d ON d._id = o.o_orderkey
""")
def q_freshness_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = table(spark, sf_dir, "orders").select("o_orderkey")
    j = store.stale(work, _event_docs(spark, sf_dir), "o_orderkey", "_id", AS_OF)
    return j.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "stale", "stored_type")


@register("fetched_or_stored", oracle=f"""
WITH docs AS (
  SELECT event_id AS _id, CASE WHEN event_type = 'signup' THEN NULL ELSE ts END AS update_date,
         CASE WHEN event_type = 'error' THEN false WHEN event_type = 'view' THEN NULL ELSE true END AS serialized, event_type AS stored_type
  FROM events
), fetched AS (SELECT l_orderkey AS _id, 'fetched ' || CAST(count(*) AS VARCHAR) AS stored_type FROM lineitem GROUP BY l_orderkey),
j AS (
  SELECT o.o_orderkey, d.stored_type AS s, f.stored_type AS f,
         (d._id IS NULL OR d.update_date IS NULL OR NOT coalesce(d.serialized, false)
          OR abs(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(d.update_date)) > CAST(2592000000000 AS BIGINT)) AS stale
  FROM orders o LEFT JOIN docs d ON d._id = o.o_orderkey LEFT JOIN fetched f ON f._id = o.o_orderkey
)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN NOT stale THEN 'stored' WHEN f IS NOT NULL THEN 'fetched' ELSE 'none' END AS origin,
       CASE WHEN stale THEN f ELSE s END AS stored_type
FROM j
""")
def q_fetched_or_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are the work items, events the stored documents, line
    counts what a fetch would bring."""
    fetched = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("_id")).agg(
        F.concat(F.lit("fetched "), F.count(F.lit(1)).cast("string")).alias("stored_type"))
    work = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"))
    return store.current(work, _event_docs(spark, sf_dir), fetched, "o_orderkey", "_id", AS_OF, ["stored_type"])


# ----------------------------------------------------------------------- J1
@register("seen_antijoin", oracle="""
WITH cand AS (
  SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'dblp' ELSE 'google_scholar' END AS iface,
         CAST(l_suppkey AS VARCHAR) AS expected_id
  FROM lineitem
), seen AS (
  SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'dblp' ELSE 'google_scholar' END AS iface,
         CAST(s_suppkey * 2 AS VARCHAR) AS expected_id
  FROM supplier
)
SELECT 'interface' AS scope, c.iface, c.expected_id FROM cand c
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.iface = c.iface AND s.expected_id = c.expected_id)
UNION ALL
SELECT DISTINCT 'global', NULL, c.expected_id FROM cand c
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.expected_id = c.expected_id)
""")
def q_seen_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cand = li.select(F.when(F.col("l_linenumber") % 2 == 0, "dblp").otherwise("google_scholar").alias("iface"),
                     F.col("l_suppkey").cast("string").alias("expected_id")).distinct()
    sup = table(spark, sf_dir, "supplier")
    seen = sup.select(F.when(F.col("s_nationkey") % 2 == 0, "dblp").otherwise("google_scholar").alias("iface"),
                      (F.col("s_suppkey") * 2).cast("string").alias("expected_id"))
    per_iface = frontier.drop_seen(cand, seen, scope="interface").select(
        F.lit("interface").alias("scope"), "iface", "expected_id")
    glob = frontier.drop_seen(cand.select("expected_id").distinct(), seen, scope="global").select(
        F.lit("global").alias("scope"), F.lit(None).cast("string").alias("iface"), "expected_id")
    return per_iface.unionByName(glob)


# ------------------------------------------------------------ W1 J2 X15
RESOLUTION_MODES = [
    # mode, favoured terms, fallback
    ("scholar", "pisa,cnr", "last"),
    ("dblp", "pisa,cnr", "first"),
    ("scholar_auto", "auto", "last"),
]


def _resolution_oracle() -> str:
    parts = []
    for mode, terms, fb in RESOLUTION_MODES:
        fav = " OR ".join(f"contains(lower(c_mktsegment), '{t.lower()}')" for t in terms.split(","))
        parts.append(f"""
  SELECT '{mode}' AS mode, q, pos, c_custkey,
         CASE WHEN {fav} THEN 1 WHEN lower(c_name) = lower(qname) THEN 2 ELSE 3 END AS tier,
         '{fb}' AS fb
  FROM cands""")
    return f"""
WITH cands AS (
  SELECT c_nationkey AS q, c_custkey AS pos, c_custkey, c_name, c_mktsegment,
         'CUSTOMER#' || lpad(CAST(c_nationkey * 10 AS VARCHAR), 9, '0') AS qname
  FROM customer
), tiered AS ({' UNION ALL '.join(parts)}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY mode, q ORDER BY tier,
          CASE WHEN tier = 1 OR (tier = 3 AND fb = 'last') THEN -pos ELSE pos END) AS rn
  FROM tiered
)
SELECT mode, CAST(q AS INTEGER) AS c_nationkey, CAST(c_custkey AS BIGINT) AS c_custkey, CAST(tier AS INTEGER) AS tier
FROM ranked WHERE rn = 1
"""


@register("candidate_resolution", oracle=_resolution_oracle())
def q_candidate_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(
        "c_nationkey", F.col("c_custkey").alias("pos"), "c_custkey", "c_name", "c_mktsegment",
        F.concat(F.lit("CUSTOMER#"), F.lpad((F.col("c_nationkey") * 10).cast("string"), 9, "0")).alias("qname"))
    # one scan: the modes are copies of each candidate, told apart by the key
    modes = F.explode(F.array(*[F.lit(m) for m, _, _ in RESOLUTION_MODES])).alias("mode")
    c = c.select("*", modes)
    picked = resolve.pick_candidates(c, ["mode", "c_nationkey"], "pos", "c_mktsegment", "c_name", "qname", "c_custkey",
                                     {m: (resolve.favored_terms(t), fb) for m, t, fb in RESOLUTION_MODES}, "mode")
    return picked.select("mode", F.col("c_nationkey").cast("int").alias("c_nationkey"),
                         F.col("c_custkey").cast("bigint").alias("c_custkey"), "tier")


# ------------------------------------------------------------------ W2 A6 A7
@register("paged_takewhile", oracle="""
WITH firsts AS (
  SELECT l_orderkey, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS first_stop
  FROM lineitem GROUP BY l_orderkey
), kept AS (
  SELECT 'include' AS mode, l.l_orderkey, l.l_linenumber FROM lineitem l JOIN firsts f USING (l_orderkey)
  WHERE f.first_stop IS NULL OR l.l_linenumber <= f.first_stop
  UNION ALL
  SELECT 'exclude', l.l_orderkey, l.l_linenumber FROM lineitem l JOIN firsts f USING (l_orderkey)
  WHERE f.first_stop IS NULL OR l.l_linenumber < f.first_stop
)
SELECT mode, CAST(l_orderkey AS BIGINT) AS l_orderkey, count(*) AS n_items,
       count(DISTINCT l_linenumber) AS n_pages, CAST(max(l_linenumber) AS INTEGER) AS last_page
FROM kept GROUP BY mode, l_orderkey
""")
def q_paged_takewhile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a paged list, each line a page; a returned line (``R``)
    is the stop signal: included (citations style) or excluded."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    r = paging.read_pages(li, ["l_orderkey"], "l_linenumber", F.col("l_returnflag") == "R")
    return r.select("mode", F.col("l_orderkey").cast("bigint").alias("l_orderkey"), "n_items", "n_pages",
                    F.col("last_page").cast("int").alias("last_page"))


# ------------------------------------------------------------- W3 A1-A4
def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("message_type"), F.col("props").alias("content"),
                    F.col("ts").alias("timestamp"),
                    F.when(F.col("user_id") % 2 == 0, "send").otherwise("receive").alias("action"))


@register("message_ids", oracle="""
SELECT CAST(event_id AS BIGINT) AS event_id,
       event_type || '_' || CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS VARCHAR) AS message_id
FROM events
""")
def q_message_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir).select("event_id", "message_type", "timestamp")
    n = metrics.sequence_number(m, ["message_type"], ["timestamp", "event_id"])
    return n.select(F.col("event_id").cast("bigint").alias("event_id"),
                    metrics.message_ids(n, "message_type", []).alias("message_id"))


@register("type_counts", oracle="""
SELECT event_type AS message_type, count(*) AS n FROM events GROUP BY event_type
""")
def q_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.type_counts(_messages(spark, sf_dir))


@register("content_counts", oracle="""
SELECT props AS content, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts
FROM events GROUP BY props
""")
def q_content_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.content_counts(_messages(spark, sf_dir))
    return c.select("content", "n", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


@register("backlog", oracle="""
SELECT event_type AS message_type,
       count(*) FILTER (WHERE user_id % 2 = 0) AS sent,
       count(*) FILTER (WHERE user_id % 2 <> 0) AS received,
       CAST(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS backlog
FROM events GROUP BY event_type
""")
def q_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.backlog(_messages(spark, sf_dir))


@register("processed_total", oracle="""
SELECT count(*) FILTER (WHERE user_id % 2 <> 0) AS processed FROM events
""")
def q_processed_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.processed_total(_messages(spark, sf_dir))


# ------------------------------------------------------------- A5 G4 F18
@register("next_pages", oracle="""
WITH p AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS year_key,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS page,
         (o_orderstatus = 'F' AND o_totalprice > 490000) AS is_end
  FROM orders
), g AS (
  SELECT year_key, max(page) AS mx, max(CAST(is_end AS INTEGER)) AS ended FROM p GROUP BY year_key
)
SELECT year_key, CAST(mx + 1 AS VARCHAR) AS next_page, year_key || '_' || CAST(mx + 1 AS VARCHAR) AS next_id
FROM g WHERE ended = 0
""")
def q_next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("year_key"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("page"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 490000)).alias("is_end"))
    return paging.next_pages(o, "year_key", "page", "is_end")


# ----------------------------------------------------------------------- O1
FRONTIER_N = 50


@register("frontier_topk", oracle=f"""
SELECT CAST(event_id AS BIGINT) AS event_id, event_type = 'signup' AS system_message,
       CAST(user_id % 4 + 1 AS INTEGER) AS depth, CAST(100 + event_id % 3 AS INTEGER) AS priority
FROM events
ORDER BY system_message DESC, depth, priority, ts DESC, event_id
LIMIT {FRONTIER_N}
""")
def q_frontier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    items = e.select(F.col("event_id").cast("bigint").alias("event_id"),
                     F.lpad(F.col("event_id").cast("string"), 20, "0").alias("expected_id"),
                     (F.col("event_type") == "signup").alias("system_message"),
                     (F.col("user_id") % 4 + 1).cast("int").alias("depth"),
                     (F.lit(100) + F.col("event_id") % 3).cast("int").alias("priority"), "ts")
    return frontier.top(items, FRONTIER_N).drop("ts", "expected_id")


# ------------------------------------------------------------------ S5 W4
@register("upsert_merge", oracle=f"""
WITH old AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS _id, '1-' || CAST(o_custkey AS VARCHAR) AS _rev,
         CASE WHEN o_orderstatus = 'F' THEN 2 END AS update_count, 'orders' AS origin
  FROM orders
), writes AS (
  SELECT CAST(l_orderkey * 2 AS VARCHAR) AS _id, l_linenumber, l_shipdate,
         CASE WHEN l_returnflag = 'R' THEN l_linenumber END AS update_count,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn
  FROM lineitem
), new AS (SELECT * FROM writes WHERE rn = 1)
SELECT coalesce(n._id, o._id) AS _id,
       CASE WHEN n._id IS NOT NULL AND o._id IS NOT NULL THEN o._rev WHEN n._id IS NOT NULL THEN NULL ELSE o._rev END AS _rev,
       CAST(CASE WHEN n._id IS NOT NULL AND o._id IS NOT NULL THEN coalesce(n.update_count + 1, 1)
                 WHEN n._id IS NOT NULL THEN n.update_count ELSE o.update_count END AS INTEGER) AS update_count,
       CASE WHEN n._id IS NOT NULL THEN 'lineitem' ELSE o.origin END AS origin,
       CAST(n.l_linenumber AS INTEGER) AS last_line
FROM old o FULL OUTER JOIN new n ON o._id = n._id
""")
def q_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders are the stored snapshot; all lineitems are incoming writes,
    last write per order wins (W4). Half of the writes go to new keys."""
    o = table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").cast("string").alias("_id"),
                   F.concat(F.lit("1-"), F.col("o_custkey").cast("string")).alias("_rev"),
                   F.when(F.col("o_orderstatus") == "F", 2).cast("int").alias("update_count"),
                   F.lit("orders").alias("origin"), F.lit(None).cast("int").alias("last_line"),
                   F.lit(None).cast("timestamp").alias("update_date"))
    li = table(spark, sf_dir, "lineitem")
    writes = li.select((F.col("l_orderkey") * 2).cast("string").alias("_id"), "l_shipdate", "l_linenumber",
                       "l_partkey", "l_suppkey",
                       F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).cast("int").alias("update_count"))
    new = store.last_write(writes, ["_id"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]).select(
        "_id", "update_count", F.lit("lineitem").alias("origin"), F.col("l_linenumber").cast("int").alias("last_line"))
    snap = store.upsert(old, new, as_of=AS_OF)
    return snap.select("_id", "_rev", "update_count", "origin", "last_line")


# ------------------------------------------------------------ J3 P2-P4 S6
_LIFECYCLE_PHASE = {"1-URGENT": 1000, "2-HIGH": 1010, "3-MEDIUM": 1020, "4-NOT SPECIFIED": 1040}


def _order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    phase = F.lit(None).cast("int")
    for k, v in _LIFECYCLE_PHASE.items():
        phase = F.when(F.col("o_orderpriority") == k, F.lit(v)).otherwise(phase)
    ifaces = F.array(*[F.lit(i) for i in ("google_scholar", "dblp", "scimago", "core_edu")])
    return o.select(
        F.col("o_orderkey").cast("string").alias("_id"),
        phase.alias("phase_ref"),
        F.get(ifaces, (F.col("o_custkey") % 4).cast("int")).alias("iface"),
        (F.col("o_orderstatus") != "O").alias("serialized"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False)
        .cast("boolean").alias("sent"))


def _lifecycle_oracle_docs() -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _LIFECYCLE_PHASE.items())
    return f"""
docs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS _id,
         CASE o_orderpriority {cases} END AS phase_ref,
         ['google_scholar', 'dblp', 'scimago', 'core_edu'][o_custkey % 4 + 1] AS iface,
         o_orderstatus <> 'O' AS serialized,
         CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS sent
  FROM orders
), dims AS (
  SELECT * FROM (VALUES ('google_scholar', 50), ('dblp', 100), ('scimago', 200), ('core_edu', 150)) v(iface, variant_id)
), tagged AS (
  SELECT d._id, CAST(d.phase_ref AS INTEGER) AS class_id, CAST(v.variant_id AS INTEGER) AS variant_id,
         true AS serialized, false AS sent
  FROM docs d LEFT JOIN dims v USING (iface)
  WHERE NOT coalesce(d.serialized, false)
)"""


@register("lifecycle", oracle=f"""
WITH {_lifecycle_oracle_docs()}
SELECT _id, class_id, variant_id,
       CASE WHEN class_id IS NULL OR variant_id IS NULL THEN 'rejected' ELSE 'packaged' END AS outcome,
       CASE WHEN class_id IS NULL OR variant_id IS NULL THEN NULL
            ELSE to_json(struct_pack(_id := _id, class_id := class_id, variant_id := variant_id,
                                     serialized := serialized, sent := sent)) END AS ndjson
FROM tagged WHERE NOT (sent IS NOT DISTINCT FROM true)
""")
def q_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unserialized documents are tagged (J3), checked for a mapping (P8),
    filtered for not-yet-sent (P3) and written as NDJSON lines (S6)."""
    docs = _order_docs(spark, sf_dir)
    tagged = store.tag(store.not_serialized(docs))
    valid, rejected = store.split_valid(tagged)
    pkg, _quarantine = store.to_package(valid)
    cols = ["_id", "class_id", "variant_id", "serialized", "sent"]
    good = pkg.select("_id", "class_id", "variant_id", F.lit("packaged").alias("outcome"),
                      store.ndjson(pkg, cols).alias("ndjson"))
    bad = rejected.select("_id", "class_id", "variant_id", F.lit("rejected").alias("outcome"),
                          F.lit(None).cast("string").alias("ndjson"))
    return good.unionByName(bad)


@register("recover_unsent", oracle="""
SELECT CAST(o_orderkey AS VARCHAR) AS _id,
       to_json(struct_pack(_id := CAST(o_orderkey AS VARCHAR), type := o_orderpriority,
                           update_count := CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 7 END, sent := false)) AS ndjson,
       CASE WHEN o_orderstatus = 'P' THEN true WHEN o_orderstatus = 'F' THEN true END AS stored_sent,
       CAST(CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 7 END
                 WHEN o_custkey % 3 = 0 THEN o_custkey % 7 + 1 ELSE 1 END AS INTEGER) AS stored_count,
       o_orderstatus = 'P' AS again
FROM orders
""")
def q_recover_unsent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``sent = false`` exactly are emitted again, as they
    are stored (``sent`` still false); then their rows are stamped (S5) with
    ``sent = true``, the original ``type`` kept. All other rows stay."""
    o = table(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").cast("string").alias("_id"), F.col("o_orderpriority").alias("type"),
                    F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 7).cast("bigint").alias("update_count"),
                    F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False).alias("sent"),
                    F.lit(None).cast("timestamp").alias("update_date"))
    again = store.unsent(docs)
    after = store.upsert(docs, again.withColumn("sent", F.lit(True)).drop("update_date"), as_of=AS_OF)
    line = docs.select("_id", store.ndjson(docs.withColumn("sent", F.lit(False)), ["_id", "type", "update_count", F.lit(False).alias("sent")]).alias("ndjson"))
    return after.join(line, "_id").select("_id", "ndjson", F.col("sent").alias("stored_sent"),
                                          F.col("update_count").cast("int").alias("stored_count"),
                                          F.col("update_date").isNotNull().alias("again"))


# ------------------------------------------------------------ T3 S2 S4-S6 W4
_STREAM_FILES = ("o_orderkey % 3 <> 2", "o_orderkey % 3 <> 0", "o_orderkey % 7 = 0")


def _stream_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all orders; every fifth order is written twice."""
    o = table(spark, sf_dir, "orders")
    base = _order_docs(spark, sf_dir).select("_id", "phase_ref", "iface", F.col("serialized"))
    docs = o.select(F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("_id"), F.col("o_orderpriority").alias("type"),
                    F.explode(F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("seq"))
    j = docs.join(base, "_id")
    return j.select(F.col("iface").alias("entity_db"), "_id", "type", "phase_ref", "iface",
                    (F.col("serialized") & (F.col("o_orderkey") % 4 == 0)).alias("serialized"), "seq",
                    F.concat_ws("-", F.lit("p"), F.col("seq").cast("string")).alias("payload"), "o_orderkey")


@register("lifecycle_stream", oracle=f"""
WITH {_lifecycle_oracle_docs()},
base AS (
  SELECT d._id, d.iface, CAST(d.phase_ref AS INTEGER) AS class_id, CAST(v.variant_id AS INTEGER) AS variant_id,
         CAST(d._id AS BIGINT) AS k, o_orderpriority AS type, d.serialized AND CAST(d._id AS BIGINT) % 4 = 0 AS done
  FROM docs d JOIN dims v USING (iface) JOIN orders ON o_orderkey = CAST(d._id AS BIGINT)
), delivered AS (
  SELECT *, 0 AS batch FROM base WHERE k % 3 <> 2 UNION ALL
  SELECT *, 1 FROM base WHERE k % 3 <> 0 UNION ALL
  SELECT *, 2 FROM base WHERE k % 7 = 0
), todo AS (SELECT *, lag(batch) OVER (PARTITION BY _id ORDER BY batch) AS before FROM delivered WHERE NOT done),
steps AS (
  SELECT *, CASE WHEN before IS NOT NULL OR k % 5 = 0 THEN 1 ELSE 0 END AS fetched,
         CASE WHEN k % 5 = 0 THEN 'p-2' ELSE 'p-1' END AS payload
  FROM todo
), good AS (SELECT * FROM steps WHERE class_id IS NOT NULL)
SELECT 'store' AS part, iface AS entity_db, _id, type, class_id, variant_id, true AS serialized, true AS sent,
       CAST(fetched + 2 AS INTEGER) AS update_count, payload, 1 AS n
FROM good QUALIFY batch = max(batch) OVER (PARTITION BY _id)
UNION ALL
SELECT 'line', iface, _id, type, class_id, variant_id, true, false, CAST(fetched + 1 AS INTEGER), payload, CAST(count(*) AS INTEGER)
FROM good GROUP BY ALL
UNION ALL
SELECT 'rejected', iface, _id, type, NULL, variant_id, true, false, NULL, payload, CAST(count(*) AS INTEGER)
FROM steps WHERE class_id IS NULL GROUP BY ALL
""")
def q_lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 over three folders of order documents, one folder per micro-batch:
    two of them through one checkpoint, whose first batch is then replayed, the
    third through a second checkpoint on the same store. Keys repeat within
    and across batches; the store, the exported lines and the rejects are
    the result."""
    from ..session import scratch_path
    from ..streaming import streams
    base = scratch_path(spark, "lifecycle")
    docs = _stream_docs(spark, sf_dir)
    schema = docs.drop("o_orderkey").schema
    sinks = [streams.lifecycle_sink(f"{base}/store", f"{base}/out", AS_OF, source=f"s{k}", order=["seq"]) for k in (0, 1)]
    # all folders are written by one job; each then lands where its stream looks
    folders = F.array(*[F.when(F.expr(part), F.lit(k)) for k, part in enumerate(_STREAM_FILES)])
    docs.withColumn("folder", F.explode(F.array_compact(folders))).drop("o_orderkey").write.partitionBy("folder").parquet(f"{base}/all")
    for k in range(len(_STREAM_FILES)):
        store.land(spark, f"{base}/all/folder={k}", f"{base}/in{k // 2}/f{k % 2}", schema)
        stream = streams.read_stream(spark, f"{base}/in{k // 2}/*", schema)
        stream.writeStream.option("checkpointLocation", f"{base}/ck{k // 2}").trigger(availableNow=True) \
            .foreachBatch(sinks[k // 2]).start().awaitTermination()
    sinks[0](spark.read.parquet(f"{base}/in0/f0"), 0)  # a replay
    cols = ["entity_db", "_id", "type", "class_id", "variant_id", "serialized", "sent", "update_count", "payload"]
    kinds = ", ".join(f"{c} {store.S.DOCUMENT_SCHEMA[c].dataType.simpleString()}" for c in cols)
    kept = store.read_versions(spark, f"{base}/store").select(F.lit("store").alias("part"), *cols, F.lit(1).alias("n"))
    lines = store.read_ndjson(spark, f"{base}/out/lines", kinds)
    lines = lines.groupBy(*cols).agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit("line").alias("part"), *cols, "n")
    bad = spark.read.parquet(f"{base}/out/rejected").withColumn("update_count", F.lit(None).cast("int"))
    bad = bad.groupBy(*cols).agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit("rejected").alias("part"), *cols, "n")
    return kept.unionByName(lines).unionByName(bad)


# ----------------------------------------------------------------- U2 U3
MULTI_PAGE = 100


@register("multi_explode", oracle="""
WITH l AS (
  SELECT l_orderkey, l_partkey, l_suppkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rn
  FROM lineitem
)
SELECT CAST(o.o_orderkey AS BIGINT) AS o_orderkey,
       CAST(coalesce(l.rn // 100, 0) AS INTEGER) AS chunk,
       CAST(l.rn % 100 AS INTEGER) AS pos,
       CAST(l.l_partkey AS BIGINT) AS l_partkey, CAST(l.l_suppkey AS BIGINT) AS l_suppkey
FROM orders o LEFT JOIN l ON l.l_orderkey = o.o_orderkey
""")
def q_multi_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-result documents (one per order and page of at most 100 items)
    are built, then exploded back to one row per entity (U2). Orders with
    no items keep one row with a null position."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *fixtures.LINE_ORDER)
    lists = paging.bounded_lists(li, ["l_orderkey"], fixtures.LINE_ORDER, ["l_partkey", "l_suppkey"], MULTI_PAGE)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey"))
    docs = o.join(lists, o["o_orderkey"] == lists["l_orderkey"], "left").select(
        "o_orderkey", F.coalesce("chunk", F.lit(0)).alias("chunk"), "items")
    ex = store.explode_multi(docs, ["o_orderkey", "chunk"], "items")
    return ex.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("chunk").cast("int").alias("chunk"),
                     F.col("pos").cast("int").alias("pos"), F.col("entity.l_partkey").cast("bigint").alias("l_partkey"),
                     F.col("entity.l_suppkey").cast("bigint").alias("l_suppkey"))


@register("citation_graph", oracle="""
SELECT CAST(l_orderkey AS VARCHAR) AS publication_id, CAST(year(l_shipdate) AS INTEGER) AS year,
       CAST(count(*) AS INTEGER) AS citations
FROM lineitem GROUP BY l_orderkey, year(l_shipdate)
""")
def q_citation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication documents carry a per-year citation graph (one entry per
    year, so the list is bounded by the year range); U3 explodes it."""
    li = table(spark, sf_dir, "lineitem")
    per_year = li.groupBy("l_orderkey", F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("citations"))
    pubs = per_year.groupBy(F.col("l_orderkey").cast("string").alias("publication_id")).agg(
        F.collect_list(F.struct("year", "citations")).alias("citation_graph"))
    return store.explode_citation_graph(pubs)


# ------------------------------------------------------ X10 X11 J4 F1 F2
@register("dblp_pubs", oracle="""
WITH lines AS (
  SELECT l_orderkey, s_name,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rn
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
), auth AS (
  SELECT l_orderkey, rn // 100 AS chunk, string_agg(s_name, '|' ORDER BY rn) AS authors,
         CAST(count(*) AS INTEGER) AS n_authors
  FROM lines GROUP BY l_orderkey, rn // 100
), o AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, substr(o_orderpriority, 1, 1) AS prio,
         o_custkey % 40 AS jid,
         chr(CAST(65 + (o_custkey % 40) // 26 AS INTEGER)) || chr(CAST(65 + (o_custkey % 40) % 26 AS INTEGER)) AS letters
  FROM orders
), ent AS (
  SELECT o.*, a.authors, a.n_authors FROM o JOIN auth a ON a.l_orderkey = o.o_orderkey
  WHERE o.o_totalprice >= 50000
), resolvable AS (
  SELECT DISTINCT jid FROM ent WHERE prio IN ('1', '2') AND o_orderkey % 5 <> 0 AND jid % 2 = 0
)
SELECT CAST(o_custkey AS BIGINT) AS author_key, 'Study of order ' || CAST(o_orderkey AS VARCHAR) || '.' AS title,
       'Journal' AS type, 'Transactions on Systems ' || letters AS journal_name,
       NULL::VARCHAR AS conference_acronym, authors, n_authors
FROM ent WHERE prio IN ('1', '2') AND jid IN (SELECT jid FROM resolvable)
UNION ALL
SELECT CAST(o_custkey AS BIGINT), 'Study of order ' || CAST(o_orderkey AS VARCHAR) || '.', 'Conference', NULL,
       letters, authors, n_authors
FROM ent WHERE prio IN ('3', '4') AND o_orderstatus <> 'O'
""")
def q_dblp_pubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author pages rendered from orders (entries) and lineitem/supplier
    (authors), journal pages for the journals; extracted by X10/X11/J4."""
    pages = fixtures.dblp_author_pages(spark, sf_dir)
    jpages = fixtures.dblp_journal_pages(spark, sf_dir)
    pubs = dblp.publications(pages, ["o_custkey", "page_no"], jpages)
    return pubs.select(F.col("o_custkey").cast("bigint").alias("author_key"), "title", "type", "journal_name",
                       "conference_acronym", F.array_join("authors", "|").alias("authors"),
                       F.size("authors").cast("int").alias("n_authors"))


# ---------------------------------------------------------- X12 X13 H14
@register("scimago_rows", oracle="""
WITH o AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, substr(o_orderpriority, 1, 1) AS prio, year(o_orderdate) AS y,
         row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) - 1 AS seq
  FROM orders
), t AS (SELECT y, count(*) AS total FROM o GROUP BY y)
SELECT CAST(y AS INTEGER) AS year, CAST(seq // 50 + 1 AS INTEGER) AS page_no,
       'Journal ' || CAST(o_orderkey AS VARCHAR) AS title,
       CASE WHEN o_orderstatus <> 'O' THEN 'journalsearch.php?q=' || CAST(o_orderkey AS VARCHAR) || '&tip=sid' ELSE 'N/A' END AS link,
       substr(CAST(o_custkey AS VARCHAR) || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')
              || CASE WHEN prio IN ('1', '2', '3', '4') THEN 'Q' || prio ELSE '' END, 1, 5) AS sjr_raw,
       CASE WHEN prio IN ('1', '2', '3', '4') THEN 'Q' || prio ELSE 'N/A' END AS q_rank,
       CAST(o_custkey % 300 AS VARCHAR) AS h_index,
       least((seq // 50 + 1) * 50, total) = total AS is_end
FROM o JOIN t USING (y)
WHERE NOT (o_orderstatus = 'P' AND prio = '5')
""")
def q_scimago_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scimago.journals(fixtures.scimago_pages(spark, sf_dir), ["page_no"])
    return rows.select(F.col("year").cast("int").alias("year"), F.col("page_no").cast("int").alias("page_no"),
                       "title", "link", "sjr_raw", "q_rank", "h_index", "is_end")


# ----------------------------------------------------------------- X14
@register("core_rows", oracle="""
WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS seq FROM customer)
SELECT CAST(seq // 50 + 1 AS INTEGER) AS page_no, c_name AS title, c_mktsegment AS acronym,
       CASE WHEN c_nationkey % 3 = 0 THEN 'National' ELSE 'CORE' || CAST(c_nationkey + 1990 AS VARCHAR) END AS source,
       ['A*', 'A', 'B', 'C'][c_nationkey % 4 + 1] AS rank,
       CASE WHEN c_custkey % 4 <> 0 THEN 'https://dblp.org/db/conf/' || lower(c_mktsegment) || CAST(c_custkey AS VARCHAR)
            ELSE 'N/A' END AS dblp_link,
       CAST(CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE c_nationkey + 1990 END AS INTEGER) AS year
FROM c WHERE NOT (c_mktsegment = 'HOUSEHOLD' AND c_custkey % 7 = 0)
""")
def q_core_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _info = core.conferences(fixtures.core_pages(spark, sf_dir), ["page_no"])
    return rows.select(F.col("page_no").cast("int").alias("page_no"), "title", "acronym", "source", "rank",
                       "dblp_link", F.col("year").cast("int").alias("year"))


# ------------------------------------------------------------ X17 X18 H5
_KINDS = list(dict.fromkeys((i, k) for i, k, _ in quality.PHRASES)) + [("scimago", "ranking")]
_PHRASE_SQL = ", ".join("('{}', '{}', '{}')".format(i, k, ph.replace("'", "''")) for i, k, ph in quality.PHRASES)
_KIND_SQL = ", ".join(f"({n}, '{i}', '{k}')" for n, (i, k) in enumerate(_KINDS))


def _dealt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, iface, page_kind, html): the pages table with phrases,
    scripts and challenges put in (variants: see ``q_blocked_pages``)."""
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    kind = (F.col("page_id") % len(_KINDS)).cast("int")
    variant = F.floor(F.col("page_id") / len(_KINDS)) % 8
    texts = [[ph for i, k, ph in quality.PHRASES if (i, k) == own] for own in _KINDS]
    joined = F.array(*[F.lit(" | ".join(t)) for t in texts])
    mine = F.get(joined, kind)
    other = F.when(kind == len(_KINDS) - 1, F.lit("Too Many Requests")).otherwise(F.lit("Nothing of ours"))
    split = F.regexp_replace(mine, " ", "<i> </i><b></b>")
    script = lambda call: F.concat(F.lit(f'<script>{call}("x", {{"sitekey":"key'), F.col("page_id").cast("string"), F.lit('"})</script>'))
    extra = (F.when(variant == 1, F.concat(F.lit("<p>"), F.upper(mine), F.lit("</p>")))
             .when(variant == 2, F.concat(F.lit("<script>var m = '"), F.regexp_replace(mine, "'", ""), F.lit("';</script><!-- "), mine, F.lit(" -->")))
             .when(variant == 3, F.concat(F.lit("<p>"), split, F.lit("</p>")))
             .when(variant == 4, F.concat(script("grecaptcha.render"), F.lit('<iframe title="reCAPTCHA" src="/c"></iframe>')))
             .when(variant == 5, script("grecaptcha.render"))
             .when(variant == 6, F.concat(F.lit("<p>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</p>")))
             .when(variant == 7, F.concat(F.lit("<p>"), other, F.lit("</p>"))).otherwise(F.lit("")))
    names = lambda at: F.get(F.array(*[F.lit(k[at]) for k in _KINDS]), kind)
    return pages.select("page_id", "url", names(0).alias("iface"), names(1).alias("page_kind"),
                       F.replace(F.col("html"), F.lit("</article>"), F.concat(extra, F.lit("</article>"))).alias("html"))


@register("blocked_pages", oracle=f"""
WITH phrases AS (SELECT * FROM (VALUES {_PHRASE_SQL}) p(iface, page_kind, phrase)),
kinds AS (SELECT * FROM (VALUES {_KIND_SQL}) k(n, iface, page_kind)),
p AS (SELECT page_id, url, page_id // {len(_KINDS)} % 8 AS variant, iface, page_kind FROM pages JOIN kinds ON n = page_id % {len(_KINDS)}),
own AS (SELECT iface, page_kind, list_sort(list(phrase)) AS all_phrases FROM phrases GROUP BY ALL),
f AS (
  SELECT p.*, CASE WHEN variant IN (1, 3) THEN coalesce(all_phrases, [])
                   WHEN variant = 6 AND p.page_kind = 'search' AND p.iface = 'google_scholar' THEN [url]
                   ELSE [] END AS found
  FROM p LEFT JOIN own USING (iface, page_kind)
)
SELECT CAST(page_id AS BIGINT) AS page_id, array_to_string(found, '|') AS blocked_by, len(found) > 0 AS blocked,
       variant = 4 AS challenge, CASE WHEN variant = 4 THEN 'key' || CAST(page_id AS VARCHAR) END AS site_key
FROM f
""")
def q_blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, dealt to the sources' page kinds. Variants: untouched; all
    phrases of the kind in upper case; only in a script; split by tags; a
    challenge; a challenge script without its frame; the request URL in the
    text; the phrases of another kind."""
    own = _dealt_pages(spark, sf_dir)
    c = quality.classify(own, ["page_id"])
    return c.select(F.col("page_id").cast("bigint").alias("page_id"), F.array_join(F.array_sort("blocked_by"), "|").alias("blocked_by"),
                    "blocked", "challenge", "site_key")


# ------------------------------------------------------------------- X1
@register("scholar_profile", oracle="""
WITH c AS (
  SELECT *, CASE WHEN c_custkey % 13 = 0 THEN 'empty'
                 WHEN c_custkey % 11 = 0 OR c_custkey % 17 = 0 THEN 'null' ELSE 'ok' END AS status
  FROM customer
)
SELECT 'U' || CAST(c_custkey AS VARCHAR) AS author_id, status,
       CASE WHEN status = 'ok' THEN c_name END AS name,
       CASE WHEN status = 'ok' THEN CASE c_custkey % 3 WHEN 0 THEN 'Professor' WHEN 1 THEN 'Researcher' ELSE '?' END END AS role,
       CASE WHEN status = 'ok' THEN CASE c_custkey % 3 WHEN 2 THEN c_mktsegment || ' lab' ELSE c_mktsegment END END AS org,
       CASE WHEN status = 'ok' AND c_custkey % 3 = 0 THEN CAST(c_nationkey + 1000 AS VARCHAR) END AS org_value,
       CASE WHEN status = 'ok' THEN 'Email verificata su ' || lower(c_mktsegment) || '.edu'
                                   || CASE WHEN c_custkey % 2 = 0 THEN ' - Home page' ELSE '' END END AS verified,
       CASE WHEN status = 'ok' THEN CASE WHEN c_custkey % 7 = 0 THEN 'Image not available'
                                         ELSE 'https://img.example/' || CAST(c_custkey AS VARCHAR) || '.jpg' END END AS image_url,
       CASE WHEN status = 'ok' THEN CASE WHEN c_custkey % 2 = 0 THEN 'https://home.example/' || CAST(c_custkey AS VARCHAR)
                                         ELSE 'Homepage not available' END END AS homepage_url,
       CASE WHEN status = 'ok' AND c_custkey % 5 <> 1 THEN lower(c_mktsegment) || '|nation ' || CAST(c_nationkey AS VARCHAR) END AS interests,
       CAST(CASE WHEN status <> 'ok' THEN NULL WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey + 3 END AS INTEGER) AS h_index,
       CAST(CASE WHEN status <> 'ok' THEN NULL WHEN c_custkey % 5 = 0 THEN -1 ELSE c_custkey % 30 END AS INTEGER) AS i10_index
FROM c
""")
def q_scholar_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = scholar.profile(fixtures.scholar_profile_pages(spark, sf_dir), ["c_custkey"], "user")
    ok = F.col("status") == "ok"
    cols = ["name", "role", "org", "org_value", "verified", "image_url", "homepage_url"]
    return prof.select("author_id", "status", *[F.when(ok, F.col(c)).alias(c) for c in cols],
                       F.when(ok, F.array_join("interests", "|")).alias("interests"),
                       F.when(ok, F.col("h_index")).cast("int").alias("h_index"),
                       F.when(ok, F.col("i10_index")).cast("int").alias("i10_index"))


# ---------------------------------------------------------------- X2 W2
@register("scholar_pubs", oracle="""
WITH o AS (
  SELECT o_orderkey, o_custkey, (o_orderstatus = 'O' AND substr(o_orderpriority, 1, 1) = '5') AS bad,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq
  FROM orders
), p AS (SELECT *, seq // 100 + 1 AS page_no FROM o),
pc AS (SELECT o_custkey, page_no, count(*) AS n FROM p GROUP BY o_custkey, page_no),
st AS (SELECT o_custkey, min(CASE WHEN bad THEN seq END) AS first_bad FROM p GROUP BY o_custkey),
sp AS (SELECT o_custkey, min(CASE WHEN n <= 1 THEN page_no END) AS small FROM pc GROUP BY o_custkey)
SELECT CAST(p.o_custkey AS BIGINT) AS author_key, 'Paper ' || CAST(o_orderkey AS VARCHAR) AS title,
       'https://scholar.google.com/citations?view_op=view_citation&hl=it&user=U' || CAST(p.o_custkey AS VARCHAR)
         || '&citation_for_view=U' || CAST(p.o_custkey AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) AS url,
       'U' || CAST(p.o_custkey AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) AS publication_id
FROM p JOIN st USING (o_custkey) JOIN sp USING (o_custkey)
WHERE (first_bad IS NULL OR seq < first_bad) AND (small IS NULL OR page_no < small)
""")
def q_scholar_pubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scholar.publication_list(fixtures.scholar_list_pages(spark, sf_dir), ["o_custkey"], "page_no")
    return rows.select(F.col("o_custkey").cast("bigint").alias("author_key"), "title", "url", "publication_id")


# ------------------------------------------------------------ X3-X6 U3
@register("scholar_pub_detail", oracle=f"""
WITH lines AS (
  SELECT l_orderkey, s_name,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rn
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
), auth AS (
  SELECT l_orderkey, rn // 100 AS chunk, string_agg(s_name, '|' ORDER BY rn) AS authors, count(*) AS n
  FROM lines GROUP BY l_orderkey, rn // 100
), yc AS (
  SELECT l_orderkey, year(l_shipdate) AS y, count(*) AS c FROM lineitem GROUP BY l_orderkey, year(l_shipdate)
), g AS (SELECT l_orderkey, count(*) AS n_graph, sum(c) AS graph_citations FROM yc GROUP BY l_orderkey)
SELECT 'U' || CAST(o_custkey AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) AS publication_id,
       'Paper ' || CAST(o_orderkey AS VARCHAR) AS title,
       CASE WHEN o_orderstatus <> 'O' THEN 'https://paper.example/' || CAST(o_orderkey AS VARCHAR)
            ELSE 'Title link not available' END AS title_link,
       CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'https://pdf.example/' || CAST(o_orderkey AS VARCHAR) || '.pdf'
            ELSE 'PDF link not available' END AS pdf_link,
       a.authors AS authors,
       CAST(CASE WHEN o_orderkey % 4 = 0 AND 1990 + o_orderkey % 10 <= {AS_OF_YEAR} THEN 1990 + o_orderkey % 10
                 WHEN year(o_orderdate) BETWEEN 1950 AND {AS_OF_YEAR} THEN year(o_orderdate) ELSE 0 END AS INTEGER) AS publication_date,
       CAST(o_orderkey % 300 AS VARCHAR) || '-' || CAST(o_orderkey % 300 + 9 AS VARCHAR) AS pages,
       'Publisher ' || CAST(o_custkey % 20 AS VARCHAR) AS publisher,
       'Abstract of paper ' || CAST(o_orderkey AS VARCHAR) AS description,
       CASE WHEN a.n IS NOT NULL THEN CAST(o_orderkey * 7 AS VARCHAR) END AS cites_id,
       CAST(coalesce(a.n, 0) AS INTEGER) AS total_citations,
       CAST(coalesce(g.n_graph, 0) AS INTEGER) AS n_graph,
       CAST(coalesce(g.graph_citations, 0) AS INTEGER) AS graph_citations,
       CASE WHEN o_orderstatus IN ('F', 'P') THEN '/scholar?q=related:' || CAST(o_orderkey AS VARCHAR)
            ELSE 'No related articles link' END AS related_articles_url,
       CASE WHEN o_orderstatus = 'F' THEN '/scholar?cluster=' || CAST(o_orderkey * 11 AS VARCHAR)
            ELSE 'No all versions link' END AS all_versions_url
FROM orders LEFT JOIN auth a ON a.l_orderkey = o_orderkey LEFT JOIN g ON g.l_orderkey = o_orderkey
""")
def q_scholar_pub_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    pubs = scholar.publication(fixtures.scholar_detail_pages(spark, sf_dir), ["o_orderkey"], "url", AS_OF_YEAR)
    return pubs.select(
        "publication_id", "title", "title_link", "pdf_link", F.array_join("authors", "|").alias("authors"),
        F.col("publication_date").cast("int").alias("publication_date"), "pages", "publisher", "description",
        "cites_id", F.col("total_citations").cast("int").alias("total_citations"),
        F.size("citation_graph").cast("int").alias("n_graph"),
        F.aggregate("citation_graph", F.lit(0), lambda acc, g: acc + g["citations"]).cast("int").alias("graph_citations"),
        "related_articles_url", "all_versions_url")


# ---------------------------------------------------------------- X8 W2
@register("scholar_citations", oracle="""
SELECT CAST(l_partkey AS VARCHAR) AS cites_id,
       'Order ' || CAST(l_orderkey AS VARCHAR) || ' line ' || CAST(l_linenumber AS VARCHAR) AS title,
       'https://doc.example/' || CAST(l_orderkey AS VARCHAR) AS link,
       CASE WHEN s_suppkey % 3 <> 0 THEN 'S' || CAST(s_suppkey AS VARCHAR) ELSE '' END AS author_ids,
       CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '' END AS author_names,
       CASE WHEN s_suppkey % 3 <> 0 THEN 'https://scholar.google.com/citations?user=S' || CAST(s_suppkey AS VARCHAR) || '&hl=it'
            ELSE '' END AS profile_urls,
       'Summary ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS summary,
       CASE WHEN l_returnflag <> 'N' THEN 'https://pdf.example/' || CAST(l_orderkey AS VARCHAR) ELSE 'No Document link' END AS document_link
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
""")
def q_scholar_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scholar.citations(fixtures.scholar_citation_pages(spark, sf_dir), ["l_partkey"], "page_no", "cites_id")
    return c.select("cites_id", "title", "link", F.array_join("author_ids", "|").alias("author_ids"),
                    F.array_join("author_names", "|").alias("author_names"),
                    F.array_join("profile_urls", "|").alias("profile_urls"), "summary", "document_link")


# ---------------------------------------------------------------- X9 W2
@register("scholar_versions", oracle="""
SELECT CAST(l_orderkey AS VARCHAR) AS cluster_id,
       CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS id,
       CASE WHEN l_linestatus <> 'O' THEN 'https://v.example/' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR)
            ELSE '' END AS link,
       CASE WHEN l_returnflag <> 'N' THEN 'source ' || CAST(l_suppkey AS VARCHAR) ELSE '' END AS source,
       'Version of part ' || CAST(l_partkey AS VARCHAR) AS description
FROM lineitem WHERE l_linenumber <> 3
""")
def q_scholar_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scholar.versions(fixtures.scholar_version_pages(spark, sf_dir), ["l_orderkey"], "page_no", "url")
    return v.select("cluster_id", "id", "link", "source", "description")


# ------------------------------------------------------------------ T1 T2 T4
STREAM_FILES = 5


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in several micro-batches, each over the whole time span:
    state is carried over and pages arrive late. A micro-batch has as many
    files (and tasks) as the events table has partitions."""
    from ..session import scratch_path
    from ..streaming import streams
    folder = scratch_path(spark, "events")
    events = table(spark, sf_dir, "events")
    n = max(1, events.rdd.getNumPartitions())
    events.repartition(STREAM_FILES * n, "event_id").write.parquet(folder)
    return streams.read_stream(spark, folder, streams.EVENTS_SCHEMA, max_files_per_trigger=n)


@register("hourly_blocked", oracle="""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       bool_or(event_type = 'error') AS blocked,
       count(*) FILTER (WHERE event_type = 'error') AS n_blocked,
       count(*) AS n_pages
FROM events GROUP BY date_trunc('hour', ts)
""")
def q_hourly_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page fetches = events; a fetch is blocked when its type is ``error``.
    Streamed (availableNow) into an update-mode keyed sink."""
    from ..streaming import streams
    s = _events_stream(spark, sf_dir)
    agg = streams.hourly_blocked(s, "ts", F.col("event_type") == "error")
    agg = agg.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     "blocked", "n_blocked", "n_pages")
    return streams.run_available(spark, agg, "hourly_blocked", mode="update", key=["window_start"])


@register("stream_dedupe", oracle="""
SELECT DISTINCT event_type AS message_type, CAST(user_id AS VARCHAR) AS expected_id, false AS system_message
FROM events WHERE event_type <> 'signup'
UNION ALL
SELECT event_type, CAST(user_id AS VARCHAR), true FROM events WHERE event_type = 'signup'
""")
def q_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages = events keyed by (type, user); ``signup`` is a system
    message and is never dropped."""
    from ..streaming import streams
    s = _events_stream(spark, sf_dir).select(
        F.col("event_type").alias("message_type"), F.col("user_id").cast("string").alias("expected_id"),
        (F.col("event_type") == "signup").alias("system_message"))
    d = streams.dedupe(s, ["message_type", "expected_id"], system_col="system_message")
    return streams.run_available(spark, d, "stream_dedupe", mode="append")


@register("stream_counters", oracle="""
SELECT event_type AS message_type, count(*) AS n,
       CAST(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS backlog
FROM events GROUP BY event_type
""")
def q_stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: running A1/A2 counters in update mode."""
    from ..streaming import streams
    s = _events_stream(spark, sf_dir).select(
        F.col("event_type").alias("message_type"),
        F.when(F.col("user_id") % 2 == 0, "send").otherwise("receive").alias("action"))
    c = streams.running_counts(s, "message_type", "action").select(
        "message_type", "n", F.col("backlog").cast("bigint").alias("backlog"))
    return streams.run_available(spark, c, "stream_counters", mode="update", key=["message_type"])


# --------------------------------------------------------- S8-S14 U1 E4
SEED_INTERFACES = "dblp,google_scholar,scimago,core_edu,arxiv"
SEED_AS_OF_YEAR = 2024


@register("seed_work", oracle=f"""
SELECT 'dblp' AS iface, 'DblpAuthor' AS message_type, s_name AS expected_id, s_name AS params,
       CAST(101 AS INTEGER) AS priority, CAST(1 AS INTEGER) AS depth, false AS roll_over FROM supplier
UNION ALL
SELECT 'google_scholar', 'ScholarAuthor', s_name, s_name, CAST(102 AS INTEGER), CAST(1 AS INTEGER), false FROM supplier
UNION ALL
SELECT 'scimago', 'ScimagoJournal', CAST(range AS VARCHAR) || '_1', CAST(range AS VARCHAR) || '|1',
       CAST(102 AS INTEGER), CAST(1 AS INTEGER), true FROM range(1999, {SEED_AS_OF_YEAR})
UNION ALL
SELECT 'core_edu', 'CoreConference', CAST(range AS VARCHAR), CAST(range AS VARCHAR),
       CAST(102 AS INTEGER), CAST(1 AS INTEGER), false FROM range(1, 46)
""")
def q_seed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed work items for every enabled interface (an unknown one is
    skipped): authors are the supplier names."""
    from ..sources import seeds
    authors = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("value"))
    w = seeds.seed_work(spark, SEED_INTERFACES, authors, SEED_AS_OF_YEAR)
    return w.select("iface", "message_type", "expected_id", F.array_join("params", "|").alias("params"),
                    F.col("priority").cast("int").alias("priority"), F.col("depth").cast("int").alias("depth"), "roll_over")


# --------------------------------------------------------- X15 X16 J2 W1
SEARCH_FAVORED = "pisa,cnr"


@register("scholar_search", oracle=f"""
WITH c AS (
  SELECT c_custkey, c_name, c_nationkey, c_mktsegment,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS seq
  FROM customer
), p AS (
  SELECT *, seq // 10 + 1 AS page_no, seq % 10 AS pos FROM c WHERE NOT (c_nationkey % 7 = 3 AND c_nationkey % 5 <> 0)
), q AS (
  SELECT c_nationkey, page_no, max(CASE WHEN pos = 2 AND page_no % 2 = 0 THEN c_name END) AS qname
  FROM p GROUP BY c_nationkey, page_no
), tiered AS (
  SELECT p.*, CASE WHEN contains(lower(c_mktsegment), 'pisa') OR contains(lower(c_mktsegment), 'cnr') THEN 1
                   WHEN lower(c_name) = lower(q.qname) THEN 2 ELSE 3 END AS tier
  FROM p JOIN q USING (c_nationkey, page_no)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey, page_no ORDER BY tier,
            CASE WHEN tier = 2 THEN pos ELSE -pos END) AS rn
  FROM tiered
)
SELECT CAST(c_nationkey AS INTEGER) AS c_nationkey, CAST(page_no AS INTEGER) AS page_no,
       'U' || CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, CAST(tier AS INTEGER) AS tier
FROM ranked WHERE rn = 1
""")
def q_scholar_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages (10 candidates each) → candidates paired with their
    organisations (X15, J2), the fallback page where the main one has no
    names → profile id from the next link (X16) → Scholar resolution (W1,
    last candidate as fallback). Even pages search for their 3rd name."""
    main, fb = fixtures.scholar_search_pages(spark, sf_dir)
    keys = ["c_nationkey", "page_no"]
    cands = scholar.candidates(main, fb, keys)
    third = cands.where(F.col("pos") == 2).select(*keys, F.when(F.col("page_no") % 2 == 0, F.col("name")).alias("qname"))
    cands = cands.join(third, keys, "left")
    best = resolve.pick_candidate(cands, keys, "pos", "org", "name", "qname", ["user", "name"],
                                  resolve.favored_terms(SEARCH_FAVORED), fallback="last")
    return best.select(F.col("c_nationkey").cast("int").alias("c_nationkey"), F.col("page_no").cast("int").alias("page_no"),
                       F.col("user").alias("user_id"), "name", "tier")


# ------------------------------------------------------------------- X7
@register("scholar_coauthors", oracle="""
SELECT CAST(l_partkey AS BIGINT) AS l_partkey,
       CAST((row_number() OVER w - 1) // 20 + 1 AS INTEGER) AS page_no,
       CAST((row_number() OVER w - 1) % 20 AS INTEGER) AS pos, s_name AS name
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice)
""")
def q_scholar_coauthors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scholar.coauthors(fixtures.scholar_colleague_pages(spark, sf_dir), ["l_partkey", "page_no"])
    return c.select(F.col("l_partkey").cast("bigint").alias("l_partkey"), F.col("page_no").cast("int").alias("page_no"),
                    F.posexplode("coauthors").alias("pos", "name")).select(
        "l_partkey", "page_no", F.col("pos").cast("int").alias("pos"), "name")


# --------------------------------------------------------- G1-G6 J1 E1 E4
def _items(df: DataFrame) -> DataFrame:
    return df.select("expected_id", F.array_join("params", "|").alias("params"), F.col("priority").cast("int").alias("priority"),
                     F.col("depth").cast("int").alias("depth"), "roll_over", "message_type")


@register("next_items_dblp", oracle="""
WITH o AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, substr(o_orderpriority, 1, 1) AS prio, o_custkey % 40 AS jid FROM orders
), ent AS (
  SELECT * FROM o WHERE o_totalprice >= 50000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
), resolvable AS (
  SELECT DISTINCT jid FROM ent WHERE prio IN ('1', '2') AND o_orderkey % 5 <> 0 AND jid % 2 = 0
), kept AS (
  SELECT o_orderkey FROM ent WHERE (prio IN ('1', '2') AND jid IN (SELECT jid FROM resolvable)) OR (prio IN ('3', '4') AND o_orderstatus <> 'O')
)
SELECT DISTINCT s_name AS expected_id, s_name AS params, CAST(101 AS INTEGER) AS priority, CAST(3 AS INTEGER) AS depth,
       false AS roll_over, 'FetchDblpData' AS message_type
FROM lineitem JOIN kept ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
WHERE s_suppkey % 5 <> 0
""")
def q_next_items_dblp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author pages → publications (journals resolved) → one item per
    co-author, without the authors already asked for."""
    from . import registry
    pages = fixtures.dblp_author_pages(spark, sf_dir).withColumnRenamed("o_custkey", "request_id")
    records = registry.extract("dblp", 1010, pages, journal_pages=fixtures.dblp_journal_pages(spark, sf_dir))
    seen = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 5 == 0).select(F.col("s_name").alias("expected_id"))
    return _items(registry.next_items("dblp", 1010, records, depth=2, seen=seen))


@register("next_items_scimago", oracle="""
WITH o AS (SELECT year(o_orderdate) AS y, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) - 1 AS seq FROM orders),
t AS (SELECT y, count(*) AS total FROM o GROUP BY y),
p AS (SELECT DISTINCT y, seq // 50 + 1 AS page_no FROM o)
SELECT CAST(y AS VARCHAR) || '_' || CAST(page_no + 1 AS VARCHAR) AS expected_id,
       CAST(y AS VARCHAR) || '|' || CAST(page_no + 1 AS VARCHAR) AS params,
       CAST(102 AS INTEGER) AS priority, CAST(1 AS INTEGER) AS depth, true AS roll_over, 'FetchScimagoData' AS message_type
FROM p JOIN t USING (y) WHERE least(page_no * 50, total) <> total
""")
def q_next_items_scimago(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking pages → end flags → the page after each page that is not the
    last; paging keeps the depth."""
    from . import registry
    pages = fixtures.scimago_pages(spark, sf_dir).withColumnRenamed("year_param", "year")
    return _items(registry.next_items("scimago", 1030, scimago.page_flags(pages, ["year", "page_no"])))


@register("next_items_scholar", oracle="""
WITH who AS (SELECT c_custkey FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 17 <> 0),
o AS (
  SELECT o_orderkey, o_custkey, (o_orderstatus = 'O' AND substr(o_orderpriority, 1, 1) = '5') AS bad,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq
  FROM orders
), p AS (SELECT *, seq // 100 + 1 AS page_no FROM o),
pc AS (SELECT o_custkey, page_no, count(*) AS n FROM p GROUP BY o_custkey, page_no),
st AS (SELECT o_custkey, min(CASE WHEN bad THEN seq END) AS first_bad FROM p GROUP BY o_custkey),
sp AS (SELECT o_custkey, min(CASE WHEN n <= 1 THEN page_no END) AS small FROM pc GROUP BY o_custkey)
SELECT 'U' || CAST(p.o_custkey AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) AS expected_id,
       'https://scholar.google.com/citations?view_op=view_citation&hl=it&user=U' || CAST(p.o_custkey AS VARCHAR)
         || '&citation_for_view=U' || CAST(p.o_custkey AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) AS params,
       CAST(101 AS INTEGER) AS priority, CAST(2 AS INTEGER) AS depth, true AS roll_over, 'FetchScholarlyData' AS message_type
FROM p JOIN st USING (o_custkey) JOIN sp USING (o_custkey) JOIN who ON c_custkey = p.o_custkey
WHERE (first_bad IS NULL OR seq < first_bad) AND (small IS NULL OR page_no < small)
UNION ALL
SELECT DISTINCT s_name, s_name, CAST(102 AS INTEGER), CAST(3 AS INTEGER), false, 'FetchScholarlyData'
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN who ON c_custkey = l_partkey
WHERE s_suppkey % 4 <> 0
""")
def q_next_items_scholar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile, list and colleague pages → full author records → publication
    items (depth kept) and co-author items (one deeper), without the authors
    already known from publications."""
    from . import registry
    rid = lambda c: F.concat(F.lit("U"), F.col(c).cast("string")).alias("request_id")
    profiles = fixtures.scholar_profile_pages(spark, sf_dir).select(rid("c_custkey"), "html")
    lists = fixtures.scholar_list_pages(spark, sf_dir).select(rid("o_custkey"), "page_no", "html")
    colleagues = fixtures.scholar_colleague_pages(spark, sf_dir).select(rid("l_partkey"), "page_no", "html")
    authors = registry.extract("google_scholar", 1000, profiles, list_pages=lists, colleague_pages=colleagues).where("status = 'ok'")
    known = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 4 == 0).select(F.col("s_name").alias("author"))
    return _items(registry.next_items("google_scholar", 1000, authors, depth=2, known_authors=known))


# ------------------------------------------------------ X15 J2 F3 H9 (DBLP)
@register("dblp_search", oracle="""
WITH s AS (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS seq FROM supplier
), p AS (SELECT *, seq // 20 + 1 AS page_no, seq % 20 AS pos FROM s),
bad AS (SELECT DISTINCT s_nationkey, page_no FROM p WHERE s_suppkey % 10 = 3)
SELECT 'hit' AS kind, CAST(s_nationkey AS INTEGER) AS nation, CAST(page_no AS INTEGER) AS page_no, CAST(pos AS INTEGER) AS pos, s_name AS name,
       'https://dblp.org/pid/' || CAST(s_suppkey AS VARCHAR) AS href, 'Org ' || CAST(s_suppkey % 7 AS VARCHAR) AS org
FROM p ANTI JOIN bad USING (s_nationkey, page_no)
UNION ALL
SELECT 'year', CAST(s_nationkey AS INTEGER), CAST(page_no AS INTEGER), CAST(pos AS INTEGER),
       CASE WHEN s_nationkey % 3 = 0 THEN 'Unknown' ELSE CAST(s_nationkey + 1990 AS VARCHAR) END, NULL, NULL
FROM p
""")
def q_dblp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages → hits (a page that lacks an organisation gives none);
    publication lists → the year before each entry."""
    hits, lists = fixtures.dblp_search_pages(spark, sf_dir)
    keys = ["s_nationkey", "page_no"]
    at = [F.col("s_nationkey").cast("int").alias("nation"), F.col("page_no").cast("int").alias("page_no"), F.col("pos").cast("int").alias("pos")]
    c = dblp.candidates(hits, keys).select(F.lit("hit").alias("kind"), *at, "name", "href", "org")
    none = F.lit(None).cast("string")
    y = dblp.entry_years(lists, keys).select(F.lit("year").alias("kind"), *at, F.col("year").alias("name"), none.alias("href"), none.alias("org"))
    return c.unionByName(y)


# ------------------------------------------------------------ R1-R3 R5 R6
@register("request_urls", oracle=f"""
SELECT CAST(c_custkey AS BIGINT) AS id, '{R.SCHOLAR_AUTHOR_SEARCH}' || replace(c_name || ' ' || c_mktsegment, ' ', '+') AS author_search,
       '{R.SCHOLAR_COLLEAGUES}' || 'U' || CAST(c_custkey AS VARCHAR) AS colleagues,
       '{R.SCHOLAR_PROFILE}U' || CAST(c_custkey AS VARCHAR) || '&start=0|' || '{R.SCHOLAR_PROFILE}U' || CAST(c_custkey AS VARCHAR) || '&start=10|'
         || '{R.SCHOLAR_PROFILE}U' || CAST(c_custkey AS VARCHAR) || '&start=20' AS list_pages,
       '{R.SCIMAGO_RANK}?year=' || CAST(1999 + c_nationkey AS VARCHAR) || '&page=' || CAST(c_custkey % 9 + 1 AS VARCHAR) AS scimago,
       '{R.CORE_RANKS}' || CAST(c_custkey % 45 + 1 AS VARCHAR) AS core
FROM customer
""")
def q_request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    user = F.concat(F.lit("U"), F.col("c_custkey").cast("string"))
    return c.select(
        F.col("c_custkey").cast("bigint").alias("id"), R.scholar_author_search_url(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("author_search"),
        R.scholar_colleagues_url(user).alias("colleagues"), F.array_join(R.paged_urls(R.scholar_profile_url(user), 3, "citations"), "|").alias("list_pages"),
        R.scimago_url(F.col("c_nationkey") + 1999, F.col("c_custkey") % 9 + 1).alias("scimago"), R.core_url(F.col("c_custkey") % 45 + 1).alias("core"))


# ------------------------------------------------------------ P5 P6 A8 F15 F16
@register("work_filters", oracle="""
WITH i AS (
  SELECT event_id, CAST(user_id % 7 + 1 AS INTEGER) AS depth, CASE WHEN event_type = 'view' OR event_type = 'error' THEN 'scraper' ELSE 'out' END AS queue,
         ts, min(ts) OVER () AS started_at, CAST(user_id AS VARCHAR) AS expected_id,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type
  FROM events
)
SELECT CAST(event_id AS BIGINT) AS event_id, depth, queue, k,
       '{"message_type":"' || event_type || '","message_id":"' || expected_id || '","content":"' || queue || '","timestamp":"' || CAST(k AS VARCHAR) || '"}' AS envelope,
       NOT EXISTS (SELECT 1 FROM customer WHERE CAST(c_custkey * 2 AS VARCHAR) = expected_id) AS is_new
FROM i WHERE depth <= 4 AND NOT (queue = 'scraper' AND epoch(ts) - epoch(started_at) > 864000)
""")
def q_work_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as work items: depth limit (P5), scraper items later than ten
    days after the first event cut off (P6), new-item answers (A8), payloads
    parsed from JSON (F15) and message envelopes written and read (F16)."""
    e = table(spark, sf_dir, "events")
    start = e.agg(F.min("ts").alias("started_at"))
    items = e.crossJoin(F.broadcast(start)).select(
        "event_id", "event_type", (F.col("user_id") % 7 + 1).cast("int").alias("depth"), "ts", "started_at",
        F.when(F.col("event_type").isin("view", "error"), "scraper").otherwise("out").alias("destination_queue"),
        F.col("user_id").cast("string").alias("expected_id"), X.parse_json_doc("props", "k INT")["k"].alias("k"))
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("ts"))
    timed = items.withColumn("ts", F.timestamp_seconds(seconds))
    kept = frontier.work_time_cutoff(frontier.depth_limit(timed), F.timestamp_seconds(F.lit(0)), 864000)
    registered = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).cast("string").alias("expected_id"))
    new = metrics.new_items(items, registered, ["expected_id"])
    text = X.message_to_json("event_type", "expected_id", "destination_queue", F.col("k").cast("string"))
    back = X.message_from_json(text)
    again = X.message_to_json(back["message_type"], back["message_id"], back["content"], back["timestamp"])
    return kept.join(new, "expected_id").select(F.col("event_id").cast("bigint").alias("event_id"), "depth", F.col("destination_queue").alias("queue"),
                                               "k", again.alias("envelope"), "is_new")
