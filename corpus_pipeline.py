"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination,
tokenisation. Every stage works on all rows its predecessor kept, its result
is written as Parquet and read again as the next one's documents.

``ORACLE_SQL`` is None: no stage but exact dedup can be said in SQL. The
stages are tested against brute force instead (tests/llm).

In every stage a null text counts as the empty text, extra columns pass
whatever their names (but for the last stage's own, which it replaces), empty
tables give an empty result, and a null doc_id is an id like any other.
Further cases are said at the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bibspark.llm import bpe, decontaminate, exact_dedup, jaccard_join, toxicity
from bibspark.session import scratch_path, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more as toxic go; the machine is fitted on
    the labelled rows of these documents. Without labels of both classes none
    goes; repeated rows and empty texts are scored as any other."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest stays, of equally
    long ones that of the smallest doc_id (null last); of repeated rows one
    stays. All empty texts are one group."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similar 5-gram sets, the smallest id stays
    (a null id before all, of equal ids the smallest hash of the text). Texts without words are
    connected with nothing and stay."""
    return jaccard_join.one_per_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go. Null items are left
    out; without items none goes."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token counts and the hashes of their ids and
    of the decoded bytes; the empty text has no tokens."""
    return bpe.round_trip(docs)


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies),
          ("decontamination", drop_leaks), ("byte_bpe", tokenise)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
