"""Connected components of an edge table by alternating large and small stars.

Every round is two ``groupBy`` minima and joins; labels shrink in a
logarithmic number of rounds and nothing is gathered on the driver. Size
estimates don't outlive a step either (:func:`_stored`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Edges a task takes.
TASK_EDGES = 250_000


def _stored(df: DataFrame) -> DataFrame:
    """The stored rows as a frame without an estimate of its size. A checkpoint
    hands on its plan's estimate, and that of a join is the product of its
    sides: a number of twice the digits after every star, which the driver
    cannot hold after some twenty."""
    spark, kept = df.sparkSession, cut_lineage(df)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(kept.toJavaRDD(), kept.schema()), spark)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges are (u, v) with u > v. Large star: every larger neighbour of u is
    tied to u's smallest; small star: every smaller one, and u itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = _stored(edges.groupBy("u").agg(F.min("v").alias("m")))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of one ordered type. Returns (node, label) for every node
    with an edge; label is the smallest node of its component."""
    e = _stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    # partitions that fit the narrow rows (edges never grow in number)
    e = e.coalesce(max(1, -(-e.count() // TASK_EDGES)))
    last = None
    while True:
        e = _stored(_star(_stored(_star(e, True)), False))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
