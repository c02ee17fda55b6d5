"""Work items, next-item derivation and the bounded breadth-first expansion
(G1-G8, J1, E4, P5, P6, O1).

The co-author graph is kept *bipartite* (author, publication): one level of
the walk is ``frontier -> its publications -> their authors``, two equi-joins
and two ``distinct``s. No author pairs are ever materialised, so a
publication with a huge author list (or an author with a third of all
publications) costs linear work, never a quadratic blow-up.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import cut_lineage


# ---------------------------------------------------------------- work items
def make_items(df: DataFrame, iface: str, phase_ref: int, priority: int, params: Sequence[Column],
               expected_id: Column, message_type: str, depth: Column | int = 1,
               ts: Column | None = None) -> DataFrame:
    """Typed work items; rows whose params are all null are dropped."""
    roll = S.ROLL_OVER.get((iface, phase_ref), False)
    params_arr = F.array(*[p.cast("string") for p in params])
    out = df.select(
        F.lit(iface).alias("iface"),
        F.lit(phase_ref).cast("int").alias("phase_ref"),
        expected_id.cast("string").alias("expected_id"),
        params_arr.alias("params"),
        F.lit(message_type).alias("message_type"),
        F.lit(priority).cast("int").alias("priority"),
        (depth if isinstance(depth, Column) else F.lit(depth)).cast("int").alias("depth"),
        F.lit(False).alias("system_message"),
        F.lit(roll).alias("roll_over"),
        (ts if ts is not None else F.current_timestamp()).cast("timestamp").alias("ts"),
    )
    return out.where(F.exists("params", lambda p: p.isNotNull()))


def child_depth(parent_depth: Column, roll_over: Column) -> Column:
    """Sending adds one; a roll-over item first loses one."""
    return parent_depth + F.when(roll_over, F.lit(0)).otherwise(F.lit(1))


def depth_limit(items: DataFrame, max_depth: int = S.DEPTH_MAX) -> DataFrame:
    """P5: items deeper than the limit are dropped."""
    return items.where(F.col("depth") <= max_depth)


def work_time_cutoff(items: DataFrame, started_at: Column, limit_s: int,
                     queue_col: str = "destination_queue", scraper_queue: str = "scraper") -> DataFrame:
    """Scraper-queue items created after start + limit are dropped
    (limit -1 disables the rule)."""
    if limit_s == -1:
        return items
    late = (F.col("ts").cast("double") - started_at.cast("double")) > limit_s
    return items.where(~(late & (F.col(queue_col) == scraper_queue)))


def drop_seen(candidates: DataFrame, seen: DataFrame, scope: str = "interface",
              id_col: str = "expected_id", iface_col: str = "iface") -> DataFrame:
    """Candidates whose id was already seen are dropped.

    ``scope='global'`` shares one seen set over all interfaces (the
    reference's behaviour); ``'interface'`` keeps one set per interface.
    """
    keys = [id_col] if scope == "global" else [iface_col, id_col]
    return candidates.join(seen.select(*keys).distinct(), on=keys, how="left_anti")


def distinct_items(items: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """J1 over derived items: one item per expected id, the one of least
    depth, then priority (the reference keeps whichever thread came first);
    ids in ``seen(expected_id)`` go. Items without an id are all kept."""
    rank = F.struct("depth", "priority", "phase_ref", "params")
    best = items.where(F.col("expected_id").isNotNull()).groupBy("expected_id").agg(
        F.min_by(F.struct(*[c for c in items.columns if c != "expected_id"]), rank).alias("i"))
    out = best.select("expected_id", "i.*").select(items.columns)
    if seen is not None:
        out = drop_seen(out, seen, scope="global")
    return out.unionByName(items.where(F.col("expected_id").isNull()))


def top(items: DataFrame, n: int) -> DataFrame:
    """O1: system first, then lower depth, lower priority, newer first.

    ``orderBy + limit`` plans as TakeOrderedAndProject: a per-partition
    top-n and one small merge, not a global sort."""
    return items.orderBy(F.col("system_message").desc(), F.col("depth").asc(), F.col("priority").asc(),
                         F.col("ts").desc(), *[F.col(c).asc() for c in ("message_type", "expected_id")
                                               if c in items.columns]).limit(n)


# ------------------------------------------------------ next-item derivation
def _without_known(names: DataFrame, known: DataFrame | None) -> DataFrame:
    """Names that are not in the set of known authors (``author`` column)."""
    if known is None:
        return names
    return names.join(known.select(F.col("author").alias("name")).distinct(), "name", "left_anti")


def next_items_scholar_author(authors: DataFrame, known_pub_authors: DataFrame | None = None) -> DataFrame:
    """G1: one PUB item per listed publication, one AUTHOR item per coauthor
    that is not in the publication-author set. Input columns: ``author_id,
    depth, publications ARRAY<STRUCT<title,url,publication_id>>, coauthors``."""
    pubs = authors.select("depth", F.explode("publications").alias("p"))
    pub_items = make_items(pubs, S.IFACE_SCHOLAR, S.CLASS_PUB, S.PRIO_PUB, [F.col("p.url")],
                           F.col("p.publication_id"), S.MSG_FETCH_SCHOLAR,
                           child_depth(F.col("depth"), F.lit(True)))
    co = _without_known(authors.select("depth", F.explode("coauthors").alias("name")), known_pub_authors)
    co_items = make_items(co, S.IFACE_SCHOLAR, S.CLASS_AUTHOR, S.PRIO_AUTHOR, [F.col("name")],
                          F.col("name"), S.MSG_FETCH_SCHOLAR, child_depth(F.col("depth"), F.lit(False)))
    return distinct_items(pub_items.unionByName(co_items))


def next_items_scholar_pub(pubs: DataFrame, known_pub_authors: DataFrame | None = None) -> DataFrame:
    """One AUTHOR item per author name of a publication, once per name
    (least depth), without the names already in the publication-author set."""
    a = _without_known(pubs.select("depth", F.explode("authors").alias("name")), known_pub_authors)
    return distinct_items(make_items(a, S.IFACE_SCHOLAR, S.CLASS_AUTHOR, S.PRIO_AUTHOR, [F.col("name")], F.col("name"),
                                     S.MSG_FETCH_SCHOLAR, child_depth(F.col("depth"), F.lit(False))))


def next_items_dblp(docs: DataFrame) -> DataFrame:
    """One PUB item per distinct co-author of each listed publication.
    ``docs`` holds author records (``publications`` arrays) or extracted
    publication rows (``authors``)."""
    rows = docs
    if "publications" in docs.columns:
        rows = docs.select("depth", F.explode("publications").alias("p")).select("depth", F.col("p.authors").alias("authors"))
    a = rows.select("depth", F.explode("authors").alias("name"))
    return distinct_items(make_items(a, S.IFACE_DBLP, S.CLASS_PUB, S.PRIO_PUB, [F.col("name")], F.col("name"),
                                     S.MSG_FETCH_DBLP, child_depth(F.col("depth"), F.lit(False))))


def next_items_scimago(pages: DataFrame) -> DataFrame:
    """The page after every fetched ranking page that is not the last.
    Columns ``year, page_no, is_end, depth``; a page without rows counts too."""
    nxt = pages.where(~F.coalesce(F.col("is_end"), F.lit(False))).select(
        "depth", F.col("year").cast("string").alias("year"), (F.col("page_no") + 1).cast("string").alias("page"))
    return distinct_items(make_items(nxt, S.IFACE_SCIMAGO, S.CLASS_JOURNAL, S.PRIO_JOURNAL, [F.col("year"), F.col("page")],
                                     F.concat_ws("_", "year", "page"), S.MSG_FETCH_SCIMAGO,
                                     child_depth(F.col("depth"), F.lit(True))))


def next_items_core(docs: DataFrame) -> DataFrame:
    """CORE pages derive nothing."""
    return docs.sparkSession.createDataFrame([], S.WORK_ITEM_SCHEMA)


# ------------------------------------------------------------ graph + walk
def authorship_edges(pubs: DataFrame, pub_col: str, authors_col: str) -> DataFrame:
    """Bipartite (pub, author) edges from publications' author arrays."""
    return (pubs.select(F.col(pub_col).alias("pub"), F.explode(authors_col).alias("author"))
            .distinct())


def expand(seeds: DataFrame, edges: DataFrame, max_depth: int = S.DEPTH_MAX) -> DataFrame:
    """Bounded breadth-first expansion over bipartite edges.

    ``seeds(author)`` start at depth 1; a co-author of a depth-``d`` author is
    at depth ``d+1`` (G6), kept while ``<= max_depth`` (P5). Every author is
    reported once, at its minimum depth (deterministic, unlike thread timing).

    Each level: frontier ⋈ edges on author → distinct pubs → ⋈ edges on pub
    → distinct authors → anti-join visited. AQE turns the joins with a small
    frontier into broadcast joins after measuring them at runtime, so
    nothing is broadcast on a guess. The distinct edges are stored once in the
    shared folder, and every level after that stores only its new authors, so
    no level recomputes another; the walk ends when a level finds nobody.
    """
    e = cut_lineage(edges.select("pub", "author").distinct())
    levels = [cut_lineage(seeds.select("author").distinct().withColumn("depth", F.lit(1)))]
    for d in range(1, max_depth):
        visited = reduce(DataFrame.unionByName, levels).select("author")
        pubs = levels[-1].select("author").join(e, "author").select("pub").distinct()
        reached = pubs.join(e, "pub").select("author").distinct()
        new = cut_lineage(reached.join(visited, "author", "left_anti").withColumn("depth", F.lit(d + 1)))
        if new.isEmpty():
            break
        levels.append(new)
    return reduce(DataFrame.unionByName, levels).select(F.col("author"), F.col("depth").cast("int").alias("depth"))


def extend_walk(depths: DataFrame, edges: DataFrame, new_edges: DataFrame, max_depth: int = S.DEPTH_MAX) -> DataFrame:
    """G7 when publications arrive: the authors whose minimum depth the
    ``new_edges(pub, author)`` change, with their new ``depth``.

    ``depths(author, depth)`` is the walk over ``edges`` so far, seeds
    included. Only publications of new edges, and then of authors that just
    got a smaller depth, are looked at: their least author depth plus one goes
    to all their authors, and whoever improves (or is new) is the next round's
    frontier. Depths only fall, so at most ``max_depth`` rounds are needed.
    Union with the unchanged depths (:func:`merge_walk`) equals a walk from
    scratch over all edges."""
    # repeated edges change no least depth: they are not sorted out first
    e = cut_lineage(edges.select("pub", "author").unionByName(new_edges.select("pub", "author")))
    known = cut_lineage(depths.select("author", F.col("depth").cast("int").alias("depth")))
    pubs = new_edges.select("pub").distinct()
    changed = None
    for _ in range(max_depth):
        least = pubs.join(e, "pub").join(known, "author").groupBy("pub").agg((F.min("depth") + 1).alias("reach")).where(F.col("reach") <= max_depth)
        best = e.join(least, "pub").groupBy("author").agg(F.min("reach").cast("int").alias("depth"))
        now = known.select("author", F.col("depth").alias("before"))
        better = cut_lineage(best.join(now, "author", "left").where(F.col("before").isNull() | (F.col("depth") < F.col("before"))).select("author", "depth"))
        if better.isEmpty():
            break
        changed = better if changed is None else cut_lineage(merge_walk(changed, better))
        known = cut_lineage(merge_walk(known, better))
        pubs = better.select("author").join(e, "author").select("pub").distinct()
    return changed if changed is not None else known.limit(0)


def merge_walk(depths: DataFrame, changed: DataFrame) -> DataFrame:
    """The walk with changed authors put in: the least depth of each."""
    return depths.unionByName(changed).groupBy("author").agg(F.min("depth").cast("int").alias("depth"))
