"""Shared steps of the record extractors (page table → record table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import html as H
from ...session import stored


def with_nodes(pages: DataFrame, html_col: str = "html", out: str = "nodes",
               pre: Column | None = None) -> DataFrame:
    """H1 once per page; the raw HTML column is dropped right after, so no
    later stage carries it. Nodes come a few pages at a time, whatever a batch
    holds. ``pre`` optionally narrows the HTML first (H13)."""
    src = pre if pre is not None else F.col(html_col)
    rest = [F.col(c) for c in dict.fromkeys(pages.columns) if c != html_col]  # a key may be named twice
    parsed = H.parse_pages(pages.select(*rest, src.alias(html_col)), html_col)
    return parsed if out == "nodes" else parsed.withColumnRenamed("nodes", out)


def explode_elements(df: DataFrame, elements: Column, keep: list[str], nodes: str = "nodes",
                     out: str = "en", pos: str = "pos") -> DataFrame:
    """One row per element, each carrying only its own node slice. (An inner
    explode would have the slices made again to look for empty lists.)"""
    n = F.col(nodes)
    return df.select(*keep, F.posexplode_outer(F.transform(elements, lambda e: H.element_nodes(n, e))).alias(pos, out)).where(F.col(pos).isNotNull())


def cell_text(en: Column, cells: Column, i: int) -> Column:
    """Stripped text of the i-th (0-based) cell."""
    return H.text(en, F.get(cells, i), strip=True)


def reuse(df: DataFrame) -> DataFrame:
    """Store extracted rows (small: the node arrays are gone) in the shared
    folder for the several branches that read them: pages are parsed once, a
    lost executor costs nothing, and no cached block stays behind."""
    return stored(df)
