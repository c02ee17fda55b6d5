"""Source registry: the user-function surface.

A source is described by a :class:`SourceSpec`: how to seed it, how to turn
its page table into records (``DataFrame -> DataFrame``, applied with
``df.transform``), an optional enrichment hook, and how records derive the
next work items. New sources are added by registering a spec, not by
subclassing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import frontier
from ..operators.extract import core, dblp, scholar, scimago

Extractor = Callable[..., DataFrame]


@dataclass(frozen=True)
class SourceSpec:
    iface: str
    variant_id: int
    extractors: dict[int, Extractor]                       # phase → page table → records
    next_items: Callable[[int, DataFrame, DataFrame | None], DataFrame] | None = None   # (phase, records, known authors) → work items
    enrich: Extractor | None = None                        # E2 hook, applied after extraction


_REGISTRY: dict[str, SourceSpec] = {}


def register_source(spec: SourceSpec) -> None:
    """Add or replace a source."""
    _REGISTRY[spec.iface] = spec


def unregister_source(iface: str) -> None:
    """Take a source out again; frames already made from it stay valid."""
    _REGISTRY.pop(iface, None)


def source(iface: str) -> SourceSpec:
    return _REGISTRY[iface]


def sources() -> dict[str, SourceSpec]:
    return dict(_REGISTRY)


def extract(iface: str, phase: int, pages: DataFrame, **options) -> DataFrame:
    """E1 + E2 + E5: run the source's extractor for a phase over a page
    table (one page → many records), then its enrichment hook. ``options``
    go to the extractor (``journal_pages`` for DBLP, ``as_of_year`` and the
    list and colleague pages for Scholar)."""
    spec = _REGISTRY[iface]
    out = spec.extractors[phase](pages, **options)
    return out.transform(spec.enrich) if spec.enrich else out


def documents(iface: str, phase: int, records: DataFrame, expected_id: Column | str, doc_type: str,
              payload: list[str] | None = None) -> DataFrame:
    """T5 step: extracted records → store documents (``entity_db``, ``_id``,
    ``type``, ``phase_ref``, ``iface``, unserialized, JSON ``payload``)."""
    eid = F.col(expected_id) if isinstance(expected_id, str) else expected_id
    cols = payload or records.columns
    return records.select(
        F.lit(iface).alias("entity_db"), eid.cast("string").alias("_id"), F.lit(doc_type).alias("type"),
        F.lit(phase).alias("phase_ref"), F.lit(iface).alias("iface"), F.lit(False).alias("serialized"),
        F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("payload"))


def next_items(iface: str, phase: int, records: DataFrame, depth: int = 1, seen: DataFrame | None = None,
               known_authors: DataFrame | None = None) -> DataFrame:
    """Typed next work items of a source's records.

    ``depth`` is the depth of the message the records came from (unless they
    carry their own), ``seen(expected_id)`` the ids already asked for (J1),
    ``known_authors(author)`` the publication-author set."""
    spec = _REGISTRY[iface]
    own = records if "depth" in records.columns else records.withColumn("depth", F.lit(depth))
    if spec.next_items is None:
        return frontier.next_items_core(own)
    items = spec.next_items(phase, own, known_authors)
    return items if seen is None else frontier.distinct_items(items, seen)


def _dblp_publications(pages: DataFrame, journal_pages: DataFrame | None = None) -> DataFrame:
    """Without journal pages no journal name can be resolved, so it is an
    error to leave them out when a page lists journal entries."""
    if journal_pages is None:
        raise ValueError("dblp publications need journal_pages (an empty table drops every journal entry)")
    return dblp.publications(pages, ["request_id", "page_no"], journal_pages)


def _scholar_author(pages: DataFrame, list_pages: DataFrame | None = None, colleague_pages: DataFrame | None = None) -> DataFrame:
    """The profile; with the author's list and colleague pages the full record."""
    who = scholar.profile(pages, ["request_id"], "request_id")
    if list_pages is None or colleague_pages is None:
        return who
    return scholar.author_record(who, scholar.publication_list(list_pages, ["request_id"], "page_no"),
                                 scholar.coauthors(colleague_pages, ["request_id", "page_no"]), "request_id")


def _scholar_next(phase: int, records: DataFrame, known: DataFrame | None) -> DataFrame:
    if phase == S.CLASS_AUTHOR:
        return frontier.next_items_scholar_author(records, known)
    return frontier.next_items_scholar_pub(records, known)


def _dblp_next(phase: int, records: DataFrame, known: DataFrame | None) -> DataFrame:
    items = frontier.next_items_dblp(records)
    return items if known is None else items.join(known.select(F.col("author").alias("expected_id")).distinct(), "expected_id", "left_anti")


register_source(SourceSpec(
    S.IFACE_DBLP, S.VARIANT_DBLP, {S.CLASS_PUB: _dblp_publications}, next_items=_dblp_next))
register_source(SourceSpec(
    S.IFACE_SCHOLAR, S.VARIANT_SCHOLAR,
    {S.CLASS_AUTHOR: _scholar_author,
     S.CLASS_PUB: lambda p, as_of_year: scholar.publication(p, ["request_id"], "url", as_of_year),
     S.CLASS_CIT: lambda p: scholar.citations(p, ["request_id"], "page_no", "request_id"),
     S.CLASS_VERSION: lambda p: scholar.versions(p, ["request_id"], "page_no", "url")},
    next_items=_scholar_next))
register_source(SourceSpec(
    S.IFACE_SCIMAGO, S.VARIANT_SCIMAGO,
    {S.CLASS_JOURNAL: lambda p: scimago.journals(p, ["request_id", "page_no"])},
    # paging goes by page flags (scimago.page_flags), which pages without rows have too
    next_items=lambda phase, r, known: frontier.next_items_scimago(r)))
register_source(SourceSpec(
    S.IFACE_CORE, S.VARIANT_CORE,
    {S.CLASS_CONFERENCE: lambda p: core.conferences(p, ["request_id", "page_no"])[0]}))


def sql_view(spark, iface: str, phase: int, pages_view: str, out_view: str) -> DataFrame:
    """E5 for SQL users: the records a source extracts from the pages in
    ``pages_view`` become the temporary view ``out_view`` (one page → many
    records), so ``SELECT ... FROM out_view`` works from SQL. Extraction
    stays a DataFrame job; no per-row Python table function is involved."""
    records = extract(iface, phase, spark.table(pages_view))
    records.createOrReplaceTempView(out_view)
    return records
