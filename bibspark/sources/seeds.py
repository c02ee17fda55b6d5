"""Seeds and interface selection.

Seed lists are small by nature (config strings, a year range, a page
range), but the author seeds may come from a table of any size, so every
builder is a DataFrame expression, never a driver-side loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import html as H
from ..functions import text as X


def config_list(spark: SparkSession, value: str, col: str = "value") -> DataFrame:
    """Config string split on ``,`` (no trim); a ``;`` fails the job."""
    return spark.createDataFrame([(value,)], "v STRING").select(F.explode(X.split_seed_list("v")).alias(col))


def years(spark: SparkSession, as_of_year: int, first: int = S.FIRST_SEED_YEAR) -> DataFrame:
    """``first .. as_of_year-1`` as text."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(as_of_year - 1))).alias("y")) \
        .select(F.col("y").cast("string").alias("value"))


def pages(spark: SparkSession, n: int = S.CORE_PAGES_NUMBER) -> DataFrame:
    """``n .. 1`` descending, as text."""
    return spark.range(1).select(F.posexplode(F.sequence(F.lit(n), F.lit(1), F.lit(-1))).alias("pos", "p")) \
        .select("pos", F.col("p").cast("string").alias("value"))


def root_names(pages_df: DataFrame, keys: Sequence[str], html_col: str = "html") -> DataFrame:
    """Names found in JSON-like objects of every string of a page
    (text, script bodies and comments), in reverse order, duplicates kept."""
    from ..operators.extract.common import with_nodes
    p = with_nodes(pages_df.select(*keys, html_col), html_col=html_col)
    strings = F.filter("nodes", lambda n: n["tag"].isin(H.TEXT, H.RAW, H.COMMENT))
    objs = F.flatten(F.transform(strings, lambda n: X.json_objects(n["text"])))
    names = F.reverse(X.names_from_json(objs))
    return p.select(*keys, F.posexplode(names).alias("pos", "name"))


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Random order with a fixed seed (reproducible)."""
    return df.orderBy(F.rand(seed))


def shuffle_places(df: DataFrame, keys: Sequence[str], seed: int, col: str = "place") -> DataFrame:
    """S12 as a keyed permutation: every row's place (0, 1, ...) in a shuffle
    that depends on the seed and the row's ``keys`` alone, not on partitions.
    Rows are dealt by ranges of a hash and numbered by
    :func:`metrics.sequence_number`; equal keys take neighbouring places."""
    from ..operators.metrics import sequence_number
    text = F.to_json(F.struct(F.lit(seed).alias("seed"), *keys), {"ignoreNullFields": "false"})
    hashed = df.withColumns({"__all": F.lit(0), "__hash": F.md5(text.cast("binary"))})
    return sequence_number(hashed, ["__all"], ["__hash", *keys], col).drop("__all", "__hash")


def enabled_interfaces(spark: SparkSession, enabled: str) -> DataFrame:
    """The enabled interfaces that exist; unknown names are skipped."""
    wanted = config_list(spark, enabled, "iface")
    return S.interfaces(spark).join(wanted, "iface", "left_semi")


def seed_work(spark: SparkSession, enabled: str, authors: DataFrame, as_of_year: int,
              n_pages: int = S.CORE_PAGES_NUMBER, as_of: str | None = None) -> DataFrame:
    """S13 + U1: seed work items of every enabled interface.

    DBLP: one PUB item per author (priority 101); Scholar: one AUTHOR item
    per author (102); Scimago: one JOURNAL item per year with params
    ``[year, '1']`` and id ``year_1`` (102); CORE: one CONFERENCE item per
    page (102). Seeds have depth 1. ``authors`` has a ``value`` column.
    """
    ts = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()

    def items(df: DataFrame, iface: str, phase: int, prio: int, msg: str, params: list[Column], eid: Column):
        roll = S.ROLL_OVER[(iface, phase)]
        return df.select(F.lit(iface).alias("iface"), F.lit(phase).alias("phase_ref"), eid.alias("expected_id"),
                         F.array(*params).alias("params"), F.lit(msg).alias("message_type"),
                         F.lit(prio).alias("priority"), F.lit(1).alias("depth"), F.lit(False).alias("system_message"),
                         F.lit(roll).alias("roll_over"), ts.alias("ts"))
    v = F.col("value")
    parts = {
        S.IFACE_DBLP: items(authors, S.IFACE_DBLP, S.CLASS_PUB, S.PRIO_PUB, S.MSG_DBLP_AUTHOR, [v], v),
        S.IFACE_SCHOLAR: items(authors, S.IFACE_SCHOLAR, S.CLASS_AUTHOR, S.PRIO_AUTHOR, S.MSG_SCHOLAR_AUTHOR, [v], v),
        S.IFACE_SCIMAGO: items(years(spark, as_of_year), S.IFACE_SCIMAGO, S.CLASS_JOURNAL, S.PRIO_JOURNAL,
                               S.MSG_SCIMAGO_JOURNAL, [v, F.lit("1")], F.concat(v, F.lit("_1"))),
        S.IFACE_CORE: items(pages(spark, n_pages), S.IFACE_CORE, S.CLASS_CONFERENCE, S.PRIO_CONFERENCE,
                            S.MSG_CORE_CONFERENCE, [v], v),
    }
    out = None
    for iface, df in parts.items():
        out = df if out is None else out.unionByName(df)
    return out.join(enabled_interfaces(spark, enabled).select("iface"), "iface", "left_semi")
