"""Counters over message tables.

All counters are plain ``groupBy`` aggregates (partial + final). Sequential
numbering within a type (W3) is computed without giving a whole type to one
task: see :func:`sequence_number`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored as kept


def type_counts(msgs: DataFrame, type_col: str = "message_type") -> DataFrame:
    """A1"""
    return msgs.groupBy(type_col).agg(F.count(F.lit(1)).alias("n"))


def backlog(msgs: DataFrame, type_col: str = "message_type", action_col: str = "action") -> DataFrame:
    """A2 + A3: +1 per send, -1 per receive; received = processed."""
    sent = F.col(action_col) == "send"
    recv = F.col(action_col) == "receive"
    return msgs.groupBy(type_col).agg(
        F.count_if(sent).alias("sent"), F.count_if(recv).alias("received"),
        F.sum(F.when(sent, 1).when(recv, -1).otherwise(0)).cast("bigint").alias("backlog"))


def processed_total(msgs: DataFrame, action_col: str = "action") -> DataFrame:
    """A3"""
    return msgs.agg(F.count_if(F.col(action_col) == "receive").alias("processed"))


def content_counts(msgs: DataFrame, content_col: str = "content", ts_col: str = "timestamp") -> DataFrame:
    """A4: ``[count, last time]`` per content."""
    return msgs.groupBy(content_col).agg(F.count(F.lit(1)).alias("n"), F.max(ts_col).alias("last_ts"))


def new_items(candidates: DataFrame, registered: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct candidates with an ``is_new`` answer against a set."""
    key = list(key)
    reg = registered.select(*key).distinct().withColumn("__seen", F.lit(True))
    return (candidates.select(*key).distinct().join(reg, key, "left")
            .select(*key, F.col("__seen").isNull().alias("is_new")))


def sequence_number(df: DataFrame, group: Sequence[str], order: Sequence[str],
                    col: str = "seq") -> DataFrame:
    """0-based position of each row inside its group, in ``order``.

    ``order`` must make rows unique inside a group. Same result as
    ``row_number() - 1`` over ``partitionBy(group).orderBy(order)``, but a
    group is never numbered by one task: rows are range-partitioned by
    (group, order) and sorted, stored once in the shared folder with their
    place in the partition, and a small (group, partition) table of counts
    moves each part of a group behind the parts before it. Storing first
    fixes the partition bounds, so every later read sees the same ones. A
    group holding a third of all rows spreads over about a third of the
    partitions; nothing is collected.
    """
    group, order = list(group), list(order)
    keys = group + order
    # partition number in the upper bits, place in the partition in the lower 33
    stored = kept(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                  .withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = stored.groupBy(*group, part.alias("__part")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (group, partition)
    offsets = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part"),
                            (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__move"))
    numbered = stored.withColumn("__p", part)
    same = [numbered["__p"] == offsets["__part"]] + [numbered[g].eqNullSafe(offsets[f"__g{i}"])
                                                     for i, g in enumerate(group)]
    return numbered.join(offsets, same).withColumn(col, F.col("__id") + F.col("__move")).select(*df.columns, col)


def message_ids(msgs: DataFrame, type_col: str, order: Sequence[str]) -> Column:
    """W3 helper: ``type_n`` text from a numbered frame's ``seq``."""
    return F.concat_ws("_", F.col(type_col), F.col("seq").cast("string"))
