"""Scimago journal ranking pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import html as H
from ...functions import text as X
from .common import cell_text, explode_elements, with_nodes

MIN_CELLS = 13
TEXT_FIELDS = ["h_index", "total_docs", "total_docs_3years", "total_refs", "total_cites_3years",
               "citable_docs_3years", "cites_per_doc_2years", "refs_per_doc", "female_percent"]


def end_flag(pagination_text) -> F.Column:
    """``a - b of n`` at the start; end when ``b = n``; else false."""
    pat = r"(?U)^(\d+)\s*-\s*(\d+)\s*of\s*(\d+)"
    end = F.regexp_extract(pagination_text, pat, 2)
    total = F.regexp_extract(pagination_text, pat, 3)
    ok = F.coalesce(pagination_text.rlike(pat), F.lit(False))
    return F.when(ok, end.try_cast(T.LongType()) == total.try_cast(T.LongType())).otherwise(F.lit(False))


def page_flags(pages: DataFrame, keys: list[str]) -> DataFrame:
    """X13 per page, also for pages without rows: ``keys`` and ``is_end``."""
    p = with_nodes(pages.select(*keys, "html"))
    pag = H.find(F.col("nodes"), index=F.col("nidx"), tag="div", cls="pagination")
    return p.select(*keys, F.coalesce(end_flag(H.text(F.col("nodes"), pag, strip=True)), F.lit(False)).alias("is_end"))


def journals(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ranking row with at least 13 cells.

    Page-level fields: ``is_end`` (X13) and ``year`` = first 4-digit word of
    the header titles (F9); no table, no header or no year → no rows. Per
    row: title/link from cell 1, type, SJR first 5 chars, quartile from
    ``span.q1..q4`` (first present), and the text of cells 4-12.
    """
    p = with_nodes(pages.select(*keys, "html"))
    n, ix = F.col("nodes"), F.col("nidx")
    pag = H.find(n, index=ix, tag="div", cls="pagination")
    wrap = H.find(n, index=ix, tag="div", cls="table_wrap")
    table = H.find(n, wrap, ix, tag="table")
    thead = H.find(n, table, ix, tag="thead")
    tbody = H.find(n, table, ix, tag="tbody")
    titles = F.transform(H.find_all(n, thead, ix, tag="th", attrs={"title": True}), lambda th: th["attrs"]["title"])
    year = X.first_year_word(F.array_join(titles, " "))
    pages_y = p.select(*keys, "nodes", H.text(n, pag, strip=True).alias("pagination"),
                       year.alias("year"), F.when(tbody.isNotNull(), H.find_all(n, tbody, ix, tag="tr")).alias("rows"))
    pages_y = pages_y.withColumn("is_end", end_flag(F.col("pagination")))
    ok = pages_y.where(F.col("year").isNotNull() & F.col("rows").isNotNull())
    r = explode_elements(ok, F.col("rows"), keys + ["year", "is_end"])
    en = F.col("en")
    cells = H.find_all(en, H.root(en), tag="td")
    r = r.select(*keys, "year", "is_end", "pos", "en", cells.alias("cells")).where(F.size("cells") >= MIN_CELLS)
    c = F.col("cells")
    title_cell = F.get(c, 1)
    link_el = H.find(en, title_cell, tag="a")
    sjr_cell = F.get(c, 3)
    q = F.coalesce(*[H.text(en, H.find(en, sjr_cell, tag="span", cls=f"q{i}"), strip=True) for i in (1, 2, 3, 4)],
                   F.lit("N/A"))
    out = r.select(
        *keys, "pos", "year", "is_end",
        cell_text(en, c, 1).alias("title"),
        F.coalesce(link_el["attrs"]["href"], F.lit("N/A")).alias("link"),
        cell_text(en, c, 2).alias("type"),
        F.substring(cell_text(en, c, 3), 1, 5).alias("sjr_raw"),
        q.alias("q_rank"),
        *[cell_text(en, c, 4 + i).alias(f) for i, f in enumerate(TEXT_FIELDS)])
    return out


def typed(journals_df: DataFrame) -> DataFrame:
    """Typed view: SJR and ratios as doubles (``,`` as decimal mark), counts
    as ints (``,`` and ``.`` group digits); unparseable text becomes null (raw text stays in ``*_raw``)."""
    def num(c, t):
        # ratios: a comma is the decimal mark; counts: commas and dots group digits
        text = F.regexp_replace(F.col(c), "[.,]", "") if t == T.IntegerType() else F.regexp_replace(F.col(c), ",", ".")
        return text.try_cast(t)
    ints = ["h_index", "total_docs", "total_docs_3years", "total_refs", "total_cites_3years", "citable_docs_3years"]
    dbl = ["cites_per_doc_2years", "refs_per_doc", "female_percent"]
    out = journals_df.withColumn("sjr", num("sjr_raw", T.DoubleType()))
    for c in ints:
        out = out.withColumn(c, num(c, T.IntegerType()))
    for c in dbl:
        out = out.withColumn(c, num(c, T.DoubleType()))
    return out
