"""CORE conference ranking pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import html as H
from ...functions import text as X
from .common import cell_text, explode_elements, with_nodes

MIN_CELLS = 9
FIELDS = ["title", "acronym", "source", "rank", "note", None, "primary_for", "comments", "average_rating"]
SERVER_ERROR = "Server Error"


def conferences(pages: DataFrame, keys: list[str], page_col: str = "page_no") -> tuple[DataFrame, DataFrame]:
    """X14. Returns ``(rows, page_info)``.

    ``page_info`` has one row per page with the next page number (text); a
    page showing ``Server Error`` gives no record at all (null in the
    reference). Rows: cells of every table row after the header row, rows
    with fewer than 9 cells dropped; link from the 6th cell else ``N/A``;
    year = first 4 digits of ``source`` else 0.
    """
    p = with_nodes(pages.select(*keys, "html"))
    n = F.col("nodes")
    p = p.where(~H.has_phrase(n, SERVER_ERROR))
    ix = F.col("nidx")
    container = H.find(n, index=ix, tag="div", id="container")
    table = H.find(n, container, ix, tag="table")
    rows = F.slice(H.find_all(n, table, ix, tag="tr"), 2, 1 << 30)
    info = p.select(*keys, X.next_page(F.col(page_col)).alias("next_page"))
    r = explode_elements(p.where(table.isNotNull()), rows, keys)
    en = F.col("en")
    cells = H.find_all(en, H.root(en), tag="td")
    r = r.select(*keys, "pos", "en", cells.alias("cells")).where(F.size("cells") >= MIN_CELLS)
    c = F.col("cells")
    cols = [cell_text(en, c, i).alias(f) for i, f in enumerate(FIELDS) if f]
    link = F.coalesce(H.find(en, F.get(c, 5), tag="a")["attrs"]["href"], F.lit("N/A"))
    out = r.select(*keys, "pos", *cols, link.alias("dblp_link"))
    year = F.coalesce(F.nullif(F.regexp_extract("source", r"(?U)\d{4}", 0), F.lit("")).try_cast(T.IntegerType()),
                      F.lit(0))
    return out.withColumn("year", year), info
