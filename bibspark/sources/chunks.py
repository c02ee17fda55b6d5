"""Lines framed from received chunks.

A connection's bytes arrive in chunks (connection, seq, data) cut anywhere,
also inside a line or a character. Chunks are split where they are; only the
first and last piece of each, which may belong to a line that goes over several
chunks, are put together by (connection, line number). So a connection is never
gathered: the largest group is one line's pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage

#: Bytes that a receive asks for (fixed value).
CHUNK_BYTES = 1024


def cut(df: DataFrame, keys: Sequence[str], data: Column, size: int = CHUNK_BYTES) -> DataFrame:
    """(keys, seq, data): the bytes of every row in chunks of ``size``."""
    n = F.octet_length("__data")
    some = df.select(*keys, data.cast("binary").alias("__data")).where(n > 0)
    at = some.withColumn("seq", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))))
    return at.select(*keys, F.col("seq").cast("long").alias("seq"), F.substring("__data", F.col("seq") * size + 1, F.lit(size)).alias("data"))


def _newlines_before(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seq, line): newlines of a connection before each of its chunks.
    Sums per range partition, moved by a table of one row per (connection,
    partition): a connection with a third of all chunks is many partitions."""
    own = chunks.select(*keys, "seq", "n")
    stored = cut_lineage(own.repartitionByRange(*keys, "seq").sortWithinPartitions(*keys, "seq").withColumn("__id", F.monotonically_increasing_id()))
    stored = stored.withColumn("__part", F.shiftright("__id", 33))
    earlier = Window.partitionBy(*keys, "__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy(*keys, "__part").agg(F.sum("n").alias("t")).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__at"), F.coalesce(F.sum("t").over(parts), F.lit(0)).alias("move"))
    local = stored.withColumn("line", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    same = [local["__part"] == totals["__at"]] + [local[k].eqNullSafe(totals[f"__k{i}"]) for i, k in enumerate(keys)]
    return local.join(totals, same).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("seq").alias("__seq"), (F.col("line") + F.col("move")).alias("line"))


def frame_lines(chunks: DataFrame, keys: Sequence[str], seq: str = "seq", data: str = "data") -> DataFrame:
    """(keys, line_no from 0, line): every line of every connection, stripped
    as Python's ``str.strip`` does; what follows the last newline is a line too
    unless it has no bytes. Empty lines are kept.

    (keys, seq) is unique. Null data counts as no bytes; bytes that are not
    UTF-8 become replacement characters. Characters cut by a chunk's end come
    back whole, since pieces are joined as bytes."""
    keys = list(keys)
    latin = F.decode(F.coalesce(F.col(data), F.lit(b"")), "ISO-8859-1")  # one character a byte
    own = chunks.select(*keys, F.col(seq).cast("long").alias("seq"), F.split(latin, "\n", -1).alias("pieces")).withColumn("n", (F.size("pieces") - 1).cast("long"))
    first = _newlines_before(own, keys)
    same = [own["seq"] == first["__seq"]] + [own[k].eqNullSafe(first[f"__k{i}"]) for i, k in enumerate(keys)]
    pieces = own.join(first, same).select(*keys, "seq", "n", "line", F.posexplode("pieces").alias("pos", "piece")).withColumn("line_no", F.col("line") + F.col("pos"))
    inner = pieces.where((F.col("pos") > 0) & (F.col("pos") < F.col("n"))).select(*keys, "line_no", F.col("piece").alias("raw"))
    outer = (pieces.where((F.col("pos") == 0) | (F.col("pos") == F.col("n"))).groupBy(*keys, "line_no")
             .agg(F.sort_array(F.collect_list(F.struct("seq", "pos", "piece"))).alias("p"), F.max(F.col("pos") < F.col("n")).alias("ended"))
             .select(*keys, "line_no", F.array_join(F.col("p")["piece"], "").alias("raw"), "ended").where(F.col("ended") | (F.col("raw") != "")).drop("ended"))
    return inner.unionByName(outer).select(*keys, "line_no", _line(F.col("raw")).alias("line"))


def _line(raw: Column) -> Column:
    return X.utrim(F.make_valid_utf8(F.encode(raw, "ISO-8859-1").cast("string")))
