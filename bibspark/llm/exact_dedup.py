"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after deleting white space
``[\\x20\\x09-\\x0D]``; equality is decided on SHA-256 of what remains.

1. One pass over the texts gives a narrow (doc_id, digest, length) table,
   checkpointed to the shared folder.
2. Misra-Gries summaries of every partition are added up; any digest held by
   more than ``rows / (counters + 1)`` rows is sure to be among the counters.
3. The candidates' true counts and winners come from one aggregation with
   map-side combine; at most ``counters`` rows, so broadcasting them is safe
   at any scale. Rows of these digests get their winner without a shuffle.
4. All other digests (none of them frequent) use an ordinary shuffle.

Edge cases: null text counts as empty, all blank texts are one group, ties
are broken by the smallest doc_id (nulls last) and then by row, so exactly
one row of a group stays even when whole rows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from .common import SPACE, id_text, keep_chosen, released, small, text_key, utf8

#: Misra-Gries counters; also the bound on the broadcast winners.
COUNTERS = 1024

_DIGEST_SCHEMA = "doc_id long, text_key long, digest binary, n_code long, row long"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for b in small(batches):
        digests = [hashlib.sha256(t.translate(None, SPACE)).digest() for t in utf8(b.column("text"))]
        lengths = pc.fill_null(pc.utf8_length(b.column("text")), 0).cast(pa.int64())
        rows = pa.array(range(row, row + b.num_rows), pa.int64())
        row += b.num_rows
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(digests, pa.binary()), lengths, rows], ["doc_id", "text_key", "digest", "n_code", "row"])


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, digest, n_code (code points), row (unique per row of this run)."""
    return id_text(docs, id_col, text_col).withColumn("text_key", text_key("text")).mapInArrow(released(_digest_batches), _DIGEST_SCHEMA)


def misra_gries(keys: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` rows (key, n) holding every key with more than
    rows / (counters + 1) occurrences; n never exceeds the true count."""
    kind = keys.schema[column].dataType.simpleString()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for b in batches:
            for x in pc.value_counts(b.column(0)).to_pylist():
                kept[x["values"]] = kept.get(x["values"], 0) + x["counts"]
            if len(kept) > counters:
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = {k: n - cut for k, n in kept.items() if n > cut}
        kept.pop(None, None)
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), b_type), pa.array(list(kept.values()), pa.int64())], ["key", "n"])

    b_type = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64()}[kind]
    parts = keys.select(F.col(column).alias("key")).mapInArrow(summarise, f"key {kind}, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(counters)


def _winner() -> list:
    best = F.min(F.struct((-F.col("n_code")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d")))
    return [best.alias("best"), F.count(F.lit(1)).alias("group_size")]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256,
    text_key."""
    rows = cut_lineage(digest_rows(docs, id_col, text_col))
    frequent = misra_gries(rows, "digest", counters).where("n > 1").select(F.col("key").alias("digest"))
    heavy = rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(*_winner())
    split = rows.join(F.broadcast(heavy), "digest", "left")
    rest = split.where(F.col("group_size").isNull()).select(rows.columns)
    winners = rest.groupBy("digest").agg(*_winner())
    both = split.where(F.col("group_size").isNotNull()).select(*rows.columns, "best", "group_size").unionByName(
        rest.join(winners, "digest").select(*rows.columns, "best", "group_size"))
    return both.select(
        "doc_id", F.col("best.c").alias("keep_id"), "group_size",
        (F.col("best.d") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "text_key")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay."""
    found = cut_lineage(exact_dedup(docs, id_col, text_col).where("group_size > 1").select("doc_id", "text_key", "kept"))
    return keep_chosen(docs, found, id_col, text_col)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_key")


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_code,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_code DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
