"""Render-then-extract: Spark jobs that render driver tables into
source-shaped HTML pages, so each extractor can be checked against SQL that
reads the expected values straight from the tables.

Every page holds a bounded number of rows: rows get a dense per-list
position from :func:`metrics.sequence_number` (no whole list in one task)
and are grouped ``page_size`` at a time. One publication entry lists the
lines of one order (TPC-H orders have at most seven lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, paging
from ..session import shuffle_tasks, stored, table


def esc(c: Column) -> Column:
    """HTML-escape text for element content and quoted attributes."""
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    c = F.replace(c, F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def paged(df: DataFrame, group: list[str], order: list[str], page_size: int) -> DataFrame:
    """Adds ``seq`` (dense position in the group) and ``page_no`` (1-based)."""
    n = metrics.sequence_number(df, group, order)
    return n.withColumn("page_no", (F.floor(F.col("seq") / page_size) + 1).cast("int"))


def pages_of(rows: DataFrame, keys: list[str], item_html: Column | str, head: Column | str, tail: Column | str,
             extra: list[Column] | None = None) -> DataFrame:
    """Group rows into one page per key, of the items that have a ``seq``.
    ``item_html`` is the rendered item or, better, how to render it: rows are
    dealt out as they come, so that only narrow ones move, and no page moves."""
    # pages feed a CPU-heavy parse: keep one partition per core at least
    dealt = rows.repartition(shuffle_tasks(rows.sparkSession), *keys)
    html = F.col(item_html) if isinstance(item_html, str) else item_html
    item = F.when(F.col("seq").isNotNull(), F.struct(F.col("seq"), html.alias("item")))
    agg = dealt.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__items"), *(extra or []))
    body = F.array_join(F.transform("__items", lambda x: x["item"]), "")
    h = F.lit(head) if isinstance(head, str) else head
    t = F.lit(tail) if isinstance(tail, str) else tail
    return agg.withColumn("html", F.concat(h, body, t)).drop("__items")


# ------------------------------------------------------------------ DBLP
DBLP_PAGE = 100
JOURNALS = 40


def _letters(jid: Column) -> Column:
    return F.concat(F.char(F.lit(65) + F.floor(jid / 26)), F.char(F.lit(65) + jid % 26))


AUTHORS_PER_ENTRY = 100
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def order_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order and chunk of at most 100 lines: its suppliers (authors) in
    line order. An order with more lines becomes several entries, so no
    list is unbounded."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return paging.bounded_lists(li.join(sup, "l_suppkey"), ["l_orderkey"], LINE_ORDER, ["l_suppkey", "s_name"],
                                AUTHORS_PER_ENTRY, "authors")


def dblp_author_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One DBLP author page per customer and 100 of its orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus",
                                               "o_totalprice", "o_orderdate")
    o = paged(o, ["o_custkey"], ["o_orderkey"], DBLP_PAGE)
    o = o.join(order_authors(spark, sf_dir), o["o_orderkey"] == F.col("l_orderkey"), "left")
    jid = F.col("o_custkey") % JOURNALS
    letters = _letters(jid)
    key = s("o_orderkey")
    prio = F.substring("o_orderpriority", 1, 1)
    cls = (F.when(prio.isin("1", "2"), "entry article toc").when(prio.isin("3", "4"), "entry inproceedings toc")
           .otherwise("entry informal toc"))
    author_html = F.array_join(F.transform(F.coalesce("authors", F.array()), lambda a: F.concat(
        F.lit('<span itemprop="author" itemscope><a href="https://dblp.org/pid/'), s(a["l_suppkey"]),
        F.lit('.html" itemprop="url"><span itemprop="name" title="'), esc(a["s_name"]), F.lit('">'),
        esc(a["s_name"]), F.lit("</span></a></span>"))), ", ")
    title = F.when(F.col("o_totalprice") >= 50000, F.concat(
        F.lit('<span class="title" itemprop="name">Study of order '), key, F.lit(".</span> "))).otherwise(F.lit(""))
    year = s(F.year("o_orderdate"))
    jname = F.concat(F.lit('<span itemprop="isPartOf" itemscope><span itemprop="name">Trans. Sys'), letters,
                     F.lit(" "), s(jid), F.lit('.</span></span> <span itemprop="isPartOf"><span itemprop="volumeNumber">'),
                     year, F.lit("</span></span>"))
    journal = F.when(F.col("o_orderkey") % 5 != 0, F.concat(
        F.lit('<a href="https://dblp.org/db/journals/t'), s(jid), F.lit('/">'), jname, F.lit("</a>"))).otherwise(jname)
    conf = F.when(F.col("o_orderstatus") != "O", F.concat(
        F.lit('<a href="https://dblp.org/db/conf/c'), s(jid), F.lit('/"><span itemprop="isPartOf"><span itemprop="name">'),
        letters, F.lit(" "), year, F.lit(": Proc. "), s(F.col("o_orderkey") % 9), F.lit("</span></span></a>")))
    venue = F.when(prio.isin("1", "2"), journal).when(prio.isin("3", "4"), conf).otherwise(F.lit("CoRR"))
    entry = F.concat(F.lit('<li class="'), cls, F.lit('" id="o'), key, F.lit('"><div class="nr">['), s("seq"),
                     F.lit(']</div><cite class="data tts-content" itemprop="headline">'), author_html, F.lit(": "),
                     title, F.coalesce(venue, F.lit("")), F.lit("</cite></li>"))
    head = F.concat(F.lit('<!DOCTYPE html><html><head><title>dblp: Author '), s("o_custkey"),
                    F.lit('</title></head><body><header id="headline"><h1>Author '), s("o_custkey"),
                    F.lit('</h1></header><div id="publ-section" class="section"><ul class="publ-list">'))
    pages = pages_of(o, ["o_custkey", "page_no"], entry, "", "</ul></div><footer>dblp</footer></body></html>")
    return pages.select("o_custkey", "page_no", F.concat(head, F.col("html")).alias("html"))


def dblp_journal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal pages for the even journal ids that orders point to."""
    jids = table(spark, sf_dir, "orders").select((F.col("o_custkey") % JOURNALS).alias("jid")).distinct() \
        .where(F.col("jid") % 2 == 0)
    url = F.concat(F.lit("https://dblp.org/db/journals/t"), s("jid"), F.lit("/"))
    html = F.concat(F.lit('<html><head><title>j</title></head><body><div class="nav">home</div>'
                          '<header id="headline" class="noline"><h1>Transactions on Systems '), _letters(F.col("jid")),
                    F.lit(", Volume "), s("jid"), F.lit("</h1></header><p>issues</p></body></html>"))
    return jids.select(url.alias("url"), html.alias("html"))


# ---------------------------------------------------------------- Scimago
SCIMAGO_PAGE = 50


def scimago_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking pages per order year, 50 rows a page, with pagination."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus",
                                               F.year("o_orderdate").alias("y"))
    o = paged(o, ["y"], ["o_orderkey"], SCIMAGO_PAGE)
    totals = o.groupBy("y").agg(F.count(F.lit(1)).alias("total"))
    key = s("o_orderkey")
    prio = F.substring("o_orderpriority", 1, 1)
    title = F.when(F.col("o_orderstatus") != "O", F.concat(
        F.lit('<a href="journalsearch.php?q='), key, F.lit('&amp;tip=sid">Journal '), key, F.lit("</a>"))
    ).otherwise(F.concat(F.lit("Journal "), key))
    sjr = F.concat(s("o_custkey"), F.lit(","), F.lpad(s(F.col("o_orderkey") % 1000), 3, "0"))
    q = F.when(prio.isin("1", "2", "3", "4"), F.concat(F.lit(' <span class="q'), prio, F.lit('">Q'), prio,
                                                      F.lit("</span>"))).otherwise(F.lit(""))

    def td(v):
        return F.concat(F.lit("<td>"), v, F.lit("</td>"))
    nums = [s(F.col("o_custkey") % 300), s(F.col("o_orderkey") % 1000), s(F.col("o_orderkey") % 777),
            s(F.col("o_custkey") % 5000), s(F.col("o_orderkey") % 333), s(F.col("o_custkey") % 91),
            F.concat(s(F.col("o_orderkey") % 10), F.lit(",25")), F.concat(s(F.col("o_custkey") % 40), F.lit(",5"))]
    cells = [td(s(F.col("seq") + 1)), F.concat(F.lit('<td class="tit">'), title, F.lit("</td>")), td(F.lit("journal")),
             F.concat(F.lit("<td>"), sjr, q, F.lit("</td>")), *[td(v) for v in nums]]
    short = (F.col("o_orderstatus") == "P") & (prio == "5")
    female = F.when(short, F.lit("")).otherwise(td(F.concat(s(F.col("o_orderkey") % 100), F.lit(".5"))))
    row = F.concat(F.lit("<tr>"), *cells, female, F.lit("</tr>"))
    rows = o.select("y", "page_no", "seq", row.alias("item"))
    pages = pages_of(rows, ["y", "page_no"], "item", "", "")
    pages = pages.join(totals, "y")
    start = (F.col("page_no") - 1) * SCIMAGO_PAGE + 1
    end = F.least(F.col("page_no") * SCIMAGO_PAGE, F.col("total"))
    head = F.concat(
        F.lit('<html><body><div class="pagination">'), s(start), F.lit(" - "), s(end), F.lit(" of "), s("total"),
        F.lit('</div><div class="table_wrap"><table><thead><tr><th>#</th><th title="Title">Title</th>'
              '<th title="Type">Type</th><th title="SCImago Journal Rank '), s("y"),
        F.lit('">SJR</th><th title="h index">H</th></tr></thead><tbody>'))
    return pages.select(F.col("y").alias("year_param"), "page_no",
                        F.concat(head, F.col("html"), F.lit("</tbody></table></div></body></html>")).alias("html"))


# ------------------------------------------------------------------- CORE
CORE_PAGE = 50


def core_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conference ranking pages over all customers, 50 rows a page, plus one
    ``Server Error`` page after the last."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment",
                                                 F.lit(0).alias("g"))
    c = paged(c, ["g"], ["c_custkey"], CORE_PAGE)

    def td(v):
        return F.concat(F.lit("<td>"), v, F.lit("</td>"))
    source = F.when(F.col("c_nationkey") % 3 == 0, F.lit("National")).otherwise(
        F.concat(F.lit("CORE"), s(F.col("c_nationkey") + 1990)))
    rank = F.get(F.array(*[F.lit(x) for x in ("A*", "A", "B", "C")]), (F.col("c_nationkey") % 4).cast("int"))
    link = F.when(F.col("c_custkey") % 4 != 0, F.concat(
        F.lit('<a href="https://dblp.org/db/conf/'), F.lower("c_mktsegment"), s("c_custkey"), F.lit('">DBLP</a>'))
    ).otherwise(F.lit("none"))
    short = (F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_custkey") % 7 == 0)
    cells = [td(esc(F.col("c_name"))), td(F.col("c_mktsegment")), td(source), td(rank), td(F.lit(" ")),
             td(link), td(s("c_nationkey")), td(F.lit("ok"))]
    rating = F.when(short, F.lit("")).otherwise(td(F.concat(s(F.col("c_custkey") % 10), F.lit("."), s("c_nationkey"))))
    row = F.concat(F.lit("<tr>"), *cells, rating, F.lit("</tr>"))
    rows = c.select("page_no", "seq", row.alias("item"))
    head = ('<html><body><div id="container"><table><tr><th>Title</th><th>Acronym</th><th>Source</th>'
            '<th>Rank</th><th>Note</th><th>DBLP</th><th>FoR</th><th>Comments</th><th>Rating</th></tr>')
    pages = pages_of(rows, ["page_no"], "item", head, "</table></div></body></html>")
    last = pages.agg((F.max("page_no") + 1).alias("page_no")).select(
        "page_no", F.lit("<html><body><h1>Server Error (500)</h1></body></html>").alias("html"))
    return pages.unionByName(last)


# ---------------------------------------------------------------- Scholar
SCHOLAR_LIST_PAGE = 100
CITATIONS_PAGE = 10


def scholar_profile_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile page per customer; some pages miss the section, the
    affiliation, the e-mail block, the image, interests or metric cells."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    mkt = F.col("c_mktsegment")
    aff_inner = (F.when(k % 3 == 0, F.concat(F.lit('Professor @ <a href="/citations?view_op=view_org&amp;org='),
                                            s(F.col("c_nationkey") + 1000), F.lit('">'), mkt, F.lit("</a>")))
                 .when(k % 3 == 1, F.concat(F.lit("Researcher, "), mkt))
                 .otherwise(F.concat(mkt, F.lit(" lab"))))
    aff = F.when(k % 11 != 0, F.concat(F.lit('<div class="gsc_prf_il">'), aff_inner, F.lit("</div>"))).otherwise(F.lit(""))
    home = F.when(k % 2 == 0, F.concat(F.lit(' - <a href="https://home.example/'), s(k),
                                       F.lit('" rel="nofollow">Home page</a>'))).otherwise(F.lit(""))
    email = F.when(k % 17 != 0, F.concat(F.lit('<div id="gsc_prf_ivh">Email verificata su '), F.lower(mkt),
                                         F.lit(".edu"), home, F.lit("</div>"))).otherwise(F.lit(""))
    img = F.when(k % 7 != 0, F.concat(F.lit('<img id="gsc_prf_pup-img" src="https://img.example/'), s(k),
                                      F.lit('.jpg">'))).otherwise(F.lit(""))
    interests = F.when(k % 5 != 1, F.concat(F.lit('<div id="gsc_prf_int"><a href="#">'), F.lower(mkt),
                                            F.lit('</a><a href="#">nation '), s("c_nationkey"), F.lit("</a></div>"))
                       ).otherwise(F.lit(""))
    section = F.when(k % 13 != 0, F.concat(
        F.lit('<div id="gsc_prf_w"><div id="gsc_prf_in">'), esc(F.col("c_name")), F.lit("</div>"),
        aff, email, img, interests, F.lit("</div>"))).otherwise(F.lit('<div id="gs_bdy">Profilo non trovato</div>'))

    def cell(v):
        return F.concat(F.lit('<td class="gsc_rsb_std">'), s(v), F.lit("</td>"))
    cells6 = F.concat(cell(k % 50), cell(k % 40), cell(F.col("c_nationkey") + 3), cell(F.col("c_nationkey")),
                      cell(k % 30), cell(k % 20))
    cells4 = F.concat(cell(k % 50), cell(k % 40), cell(F.col("c_nationkey") + 3), cell(F.col("c_nationkey")))
    table_html = F.concat(F.lit('<table id="gsc_rsb_st"><tr>'), F.when(k % 5 == 0, cells4).otherwise(cells6),
                          F.lit("</tr></table>"))
    html = F.concat(F.lit("<html><body>"), section, table_html, F.lit("</body></html>"))
    return c.select(k.alias("c_custkey"), F.concat(F.lit("U"), s(k)).alias("user"), html.alias("html")) \
        .repartition(spark.sparkContext.defaultParallelism, "c_custkey")


def _bad_list_row() -> Column:
    return (F.col("o_orderstatus") == "O") & (F.substring("o_orderpriority", 1, 1) == "5")


def scholar_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication list pages per customer, 100 orders a page."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    o = paged(o, ["o_custkey"], ["o_orderkey"], SCHOLAR_LIST_PAGE)
    key, cust = s("o_orderkey"), s("o_custkey")
    link = F.concat(F.lit('<a href="/citations?view_op=view_citation&amp;hl=it&amp;user=U'), cust,
                    F.lit("&amp;citation_for_view=U"), cust, F.lit(":"), key, F.lit('" class="gsc_a_at">Paper '), key,
                    F.lit("</a>"))
    cell = F.when(_bad_list_row(), F.concat(F.lit("Paper "), key)).otherwise(link)
    row = F.concat(F.lit('<tr class="gsc_a_tr"><td class="gsc_a_t">'), cell,
                   F.lit('<div class="gs_gray">Authors</div></td><td class="gsc_a_c">0</td></tr>'))
    rows = o.select("o_custkey", "page_no", "seq", row.alias("item"))
    return pages_of(rows, ["o_custkey", "page_no"], "item",
                    '<html><body><table id="gsc_a_t"><tbody id="gsc_a_b">', "</tbody></table></body></html>")


def order_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: (year, lines shipped that year), one entry per year."""
    li = table(spark, sf_dir, "lineitem")
    per = li.groupBy("l_orderkey", F.year("l_shipdate").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("y", "c"))).alias("graph"))


def scholar_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One publication detail page per order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                                               "o_orderdate").repartition(shuffle_tasks(spark), "o_orderkey")
    a = order_authors(spark, sf_dir)
    g = order_year_counts(spark, sf_dir).withColumnRenamed("l_orderkey", "g_orderkey")
    o = o.join(a, o["o_orderkey"] == a["l_orderkey"], "left").join(g, F.col("o_orderkey") == F.col("g_orderkey"), "left")
    k = F.col("o_orderkey")
    key, cust = s(k), s("o_custkey")
    url = F.concat(F.lit("https://scholar.google.com/citations?view_op=view_citation&hl=it&user=U"), cust,
                   F.lit("&citation_for_view=U"), cust, F.lit(":"), key)
    title = F.when(F.col("o_orderstatus") != "O", F.concat(
        F.lit('<div id="gsc_oci_title"><a class="gsc_oci_title_link" href="https://paper.example/'), key,
        F.lit('"> Paper '), key, F.lit(" </a></div>"))).otherwise(F.concat(
            F.lit('<div id="gsc_oci_title"> Paper '), key, F.lit(" </div>")))
    pdf = F.when(F.substring("o_orderpriority", 1, 1) == "1", F.concat(
        F.lit('<div class="gsc_oci_title_ggi"><a href="https://pdf.example/'), key,
        F.lit('.pdf"><span class="gsc_vcd_title_ggt">[PDF]</span></a></div>'))).otherwise(F.lit(""))

    def fld(name, value):
        return F.concat(F.lit('<div class="gs_scl"><div class="gsc_oci_field">' + name + '</div><div class="gsc_oci_value">'),
                        value, F.lit("</div></div>"))
    names = F.transform(F.coalesce("authors", F.array()), lambda x: x["s_name"])
    authors = F.when(F.size(names) > 0, fld("Autori", F.array_join(names, ", "))).otherwise(F.lit(""))
    date = fld("Data di pubblicazione", F.date_format("o_orderdate", "yyyy/M/d"))
    volume = F.when(k % 4 == 0, fld("Volume", s(F.lit(1990) + k % 10))).otherwise(F.lit(""))
    pages = fld("Pagine", F.concat(s(k % 300), F.lit("-"), s(k % 300 + 9)))
    publisher = fld("Editore", F.concat(F.lit("Publisher "), s(F.col("o_custkey") % 20)))
    descr = F.concat(F.lit('<div class="gs_scl"><div class="gsc_oci_field">Descrizione</div>'
                           '<div class="gsc_oci_value" id="gsc_oci_descr"><div class="gsh_small">'
                           '<svg viewBox="0 0 1 1"><path d="M0"></path><text>icon</text></svg>Abstract of <b>paper</b> '),
                     key, F.lit("</div></div></div>"))
    bars = F.array_join(F.transform(F.coalesce("graph", F.array()), lambda b: F.concat(
        F.lit('<a href="/scholar?as_sdt=0,5&amp;hl=it&amp;as_ylo='), s(b["y"]), F.lit("&amp;as_yhi="), s(b["y"]),
        F.lit("&amp;cites="), s(k * 7), F.lit('" class="gsc_oci_g_a"><span class="gsc_oci_g_al">'), s(b["c"]),
        F.lit("</span></a>"))), "")
    bad_bar = F.when(k % 3 == 0, F.lit('<a href="/scholar?x=1" class="gsc_oci_g_a"><span class="gsc_oci_g_al">9'
                                       '</span></a>')).otherwise(F.lit(""))
    cited = F.when(F.size(names) > 0, F.concat(
        F.lit('<div><a href="/scholar?oi=bibs&amp;hl=it&amp;cites='), s(k * 7), F.lit('">Citato da '),
        s(F.size(names)), F.lit("</a></div>"))).otherwise(F.lit(""))
    cit_field = F.concat(F.lit('<div class="gs_scl"><div class="gsc_oci_field">Citazioni totali</div>'
                               '<div class="gsc_oci_value">'), cited, F.lit('<div id="gsc_oci_graph_bars">'),
                         bars, bad_bar, F.lit("</div></div></div>"))
    oms1 = F.concat(F.lit('<a class="gsc_oms_link" href="/scholar?q=related:'), key, F.lit('">Articoli correlati</a>'))
    oms2 = F.concat(F.lit('<a class="gsc_oms_link" href="/scholar?cluster='), s(k * 11), F.lit('">Tutte le versioni</a>'))
    oms = F.when(F.col("o_orderstatus") == "F", F.concat(oms1, oms2)).when(F.col("o_orderstatus") == "P", oms1) \
        .otherwise(F.lit(""))
    html = F.concat(F.lit("<html><body>"), title, pdf, F.lit('<div id="gsc_oci_table">'), authors, date, volume,
                    pages, publisher, descr, cit_field, F.lit("</div>"), oms, F.lit("</body></html>"))
    return o.select(k.alias("o_orderkey"), url.alias("url"), html.alias("html"))


def _citation_item(k_col: str = "l_orderkey") -> Column:
    sup = F.col("s_suppkey")
    author = F.when(sup % 3 != 0, F.concat(F.lit('<a href="/citations?user=S'), s(sup), F.lit('&amp;hl=it">'),
                                           esc(F.col("s_name")), F.lit("</a>"))) \
        .otherwise(F.concat(F.lit('<a href="/scholar?q=s'), s(sup), F.lit('">'), esc(F.col("s_name")), F.lit("</a>")))
    doc = F.when(F.col("l_returnflag") != "N", F.concat(
        F.lit('<div class="gs_or_ggsm"><a href="https://pdf.example/'), s(k_col), F.lit('">[PDF]</a></div>'))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit('<div class="gs_r gs_or gs_scl"><div class="gs_ri"><h3 class="gs_rt"><a href="https://doc.example/'),
        s(k_col), F.lit('">Order '), s(k_col), F.lit(" line "), s("l_linenumber"), F.lit('</a></h3><div class="gs_a">'),
        author, F.lit(' - Journal</div><div class="gs_rs">Summary '), s(F.col("l_quantity").cast("int")),
        F.lit("</div></div>"), doc, F.lit("</div>"))


GHOST_CITATION = ('<div class="gs_r gs_or gs_scl"><h3 class="gs_rt"><a href="https://ghost.example/">Ghost</a></h3>'
                  '<div class="gs_rs">never kept</div></div>')


def scholar_citation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citing-work pages per part (the cited work), 10 items a page. The
    last real page lacks the next-page icon, except for parts ``% 5 == 0``
    whose last page is followed by an empty page; both kinds are followed
    by a ghost page that the paging rule must not read."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                  "l_quantity", "l_extendedprice", "l_returnflag")
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey"), "s_name")
    li = li.join(sup, li["l_suppkey"] == sup["s_suppkey"])
    li = paged(li, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], CITATIONS_PAGE)
    last = stored(li.groupBy("l_partkey").agg(F.max("page_no").alias("last_page")))  # read three times
    # a list's last page learns that it is the last from a row of its own
    marks = last.where(F.col("l_partkey").isNotNull()).select("l_partkey", F.col("last_page").alias("page_no"), F.lit(True).alias("is_last"))
    rows = li.where(F.col("l_partkey").isNotNull()).unionByName(marks, allowMissingColumns=True)
    pages = pages_of(rows, ["l_partkey", "page_no"], _citation_item(), "", "", [F.max("is_last").alias("is_last")])
    icon = '<span class="gs_ico gs_ico_nav_first"></span>'
    has_icon = F.col("is_last").isNull() | (F.col("l_partkey") % 5 == 0)
    head = '<html><body><div class="gs_r">Risultati</div><div class="gs_r">Ordina</div>'
    body = F.concat(F.lit(head), F.col("html"), F.lit('<div class="gs_r">Fine</div>'),
                    F.when(has_icon, F.lit(icon)).otherwise(F.lit("")), F.lit("</body></html>"))
    real = pages.select("l_partkey", "page_no", body.alias("html"))
    extra = last.select("l_partkey", "last_page")
    empty = extra.where(F.col("l_partkey") % 5 == 0).select(
        "l_partkey", (F.col("last_page") + 1).alias("page_no"),
        F.lit(head + '<div class="gs_r">Fine</div>' + icon + "</body></html>").alias("html"))
    ghost = extra.select("l_partkey", (F.col("last_page") + 2).alias("page_no"),
                         F.lit(head + GHOST_CITATION + '<div class="gs_r">Fine</div>' + icon + "</body></html>")
                         .alias("html"))
    out = real.unionByName(empty).unionByName(ghost)
    return out.select("l_partkey", "page_no", F.col("l_partkey").cast("string").alias("cites_id"), "html")


def scholar_version_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version pages per order (cluster): its lines, then an empty page and,
    for orders ``% 10 == 0``, a ghost page after it. Line 3 uses the classes
    in another order, so it is not a version."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                  "l_linestatus", "l_returnflag", "l_extendedprice")
    li = paged(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], CITATIONS_PAGE)
    cls = F.when(F.col("l_linenumber") == 3, F.lit("gs_r gs_scl gs_or")).otherwise(F.lit("gs_r gs_or gs_scl"))
    link = F.when(F.col("l_linestatus") != "O", F.concat(F.lit('<a href="https://v.example/'), s("l_orderkey"),
                                                         F.lit("/"), s("l_linenumber"), F.lit('">[PDF]</a>'))
                  ).otherwise(F.lit(""))
    source = F.when(F.col("l_returnflag") != "N", F.concat(F.lit('<span class="gs_ct2"> source '), s("l_suppkey"),
                                                           F.lit(" </span>"))).otherwise(F.lit(""))
    item = F.concat(F.lit('<div class="'), cls, F.lit('" data-cid="'), s("l_orderkey"), F.lit("."), s("l_linenumber"),
                    F.lit('">'), link, source, F.lit('<div class="gs_rs"> Version of part '), s("l_partkey"),
                    F.lit(" </div></div>"))
    rows = li.select("l_orderkey", "page_no", "seq", item.alias("item"))
    pages = pages_of(rows, ["l_orderkey", "page_no"], "item", "<html><body>", "</body></html>")
    last = pages.groupBy("l_orderkey").agg(F.max("page_no").alias("last_page"))
    empty = last.select("l_orderkey", (F.col("last_page") + 1).alias("page_no"),
                        F.lit("<html><body><p>Nessun risultato</p></body></html>").alias("html"))
    ghost = last.where(F.col("l_orderkey") % 10 == 0).select(
        "l_orderkey", (F.col("last_page") + 2).alias("page_no"),
        F.lit('<html><body><div class="gs_r gs_or gs_scl" data-cid="ghost">x</div></body></html>').alias("html"))
    out = pages.unionByName(empty).unionByName(ghost)
    url = F.concat(F.lit("https://scholar.google.com/scholar?cluster="), s("l_orderkey"), F.lit("&hl=it&start="),
                   s((F.col("page_no") - 1) * CITATIONS_PAGE))
    return out.select("l_orderkey", "page_no", url.alias("url"), "html")


SEARCH_PAGE = 10


def scholar_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author-search result pages: the customers of a nation, 10 per page.
    Nations ``% 5 == 0`` have no main results (the fallback page is used);
    nations ``% 7 == 3`` show names but no organisation spans at all."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    c = paged(c, ["c_nationkey"], ["c_custkey"], SEARCH_PAGE)
    nat = F.col("c_nationkey")
    href = F.concat(F.lit("/citations?user=U"), s("c_custkey"), F.lit("&amp;hl=it"))
    main_item = F.concat(F.lit('<div class="gs_r"><h4 class="gs_rt2"><a href="'), href, F.lit('">'), esc(F.col("c_name")),
                         F.lit("</a></h4>"),
                         F.when(nat % 7 != 3, F.concat(F.lit('<span class="gs_nph">'), F.col("c_mktsegment"),
                                                       F.lit("</span>"))).otherwise(F.lit("")),
                         F.lit("</div>"))
    fb_item = F.concat(F.lit('<div class="gsc_1usr"><a href="'), href, F.lit('">'), esc(F.col("c_name")),
                       F.lit('</a><div class="gs_ai_eml">'), F.col("c_mktsegment"), F.lit("</div></div>"))
    rows = c.select("c_nationkey", "page_no", "seq", F.when(nat % 5 != 0, main_item).alias("main"),
                    fb_item.alias("fb"))
    main = pages_of(rows.where(F.col("main").isNotNull()), ["c_nationkey", "page_no"], "main",
                    '<html><body><span class="gs_nph">Profili utente</span>', "</body></html>")
    empty_main = rows.where(F.col("main").isNull()).select("c_nationkey", "page_no").distinct().select(
        "c_nationkey", "page_no", F.lit('<html><body><span class="gs_nph">Profili utente</span>'
                                        '<p>Nessun risultato</p></body></html>').alias("html"))
    fallback = pages_of(rows.where(F.col("main").isNull()), ["c_nationkey", "page_no"], "fb",
                        "<html><body>", "</body></html>")
    return main.unionByName(empty_main), fallback


def scholar_colleague_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colleague pages per part: the suppliers of its lines, 20 a page."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                  "l_extendedprice")
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey"), "s_name")
    li = paged(li.join(sup, li["l_suppkey"] == sup["s_suppkey"]), ["l_partkey"],
               ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], 20)
    item = F.concat(F.lit('<div class="gsc_ucoar"><h3 class="gs_ai_name"><a href="/citations?user=S'), s("l_suppkey"),
                    F.lit('">'), esc(F.col("s_name")), F.lit('</a></h3><div class="gs_ai_aff">x</div></div>'))
    rows = li.select("l_partkey", "page_no", "seq", item.alias("item"))
    return pages_of(rows, ["l_partkey", "page_no"], "item", "<html><body>", "</body></html>")


# ------------------------------------------------------------ DBLP search
DBLP_HITS = 20


def dblp_search_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Author search pages per nation (suppliers as hits, some without an
    organisation) and publication lists with a year before their entries."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    sup = paged(sup, ["s_nationkey"], ["s_suppkey"], DBLP_HITS)
    org = F.when(F.col("s_suppkey") % 10 == 3, F.lit("")).otherwise(F.concat(F.lit("<small>Org "), s(F.col("s_suppkey") % 7), F.lit("</small>")))
    hit = F.concat(F.lit('<li><a href="https://dblp.org/pid/'), s("s_suppkey"), F.lit('"><span itemprop="name">'), esc(F.col("s_name")),
                   F.lit("</span></a> "), org, F.lit("</li>"))
    keys = ["s_nationkey", "page_no"]
    hits = pages_of(sup.select(*keys, "seq", hit.alias("item")), keys, "item",
                    '<html><body><div id="completesearch-authors"><ul class="result-list">', "</ul></div></body></html>")
    year = F.when(F.col("s_nationkey") % 3 == 0, F.lit("n/a")).otherwise(s(F.col("s_nationkey") + 1990))
    entry = F.concat(F.lit('<li class="entry article">'), s("s_suppkey"), F.lit("</li>"))
    lists = pages_of(sup.select(*keys, "seq", entry.alias("item")), keys, "item", "", "</ul></div></body></html>")
    lists = lists.withColumn("html", F.concat(F.lit('<html><body><div id="publ-section"><ul><li class="year">'), year, F.lit("</li>"), F.col("html")))
    return hits, lists
