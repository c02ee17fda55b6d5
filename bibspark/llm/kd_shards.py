"""K-d tree sharding: recursive splits at distributed weighted medians.

Every document is a point: its metadata (source, lang, code points, bytes)
as numbers, its weight the bytes it takes. A node that still holds more than
the target bytes is cut along its widest dimension at the exact weighted
median; leaves are the shards. The law is ``bytes``: shard sizes near equal.

Scale: texts are read once into a narrow checkpointed table (ids, sizes,
coordinates). A level costs one pass for the widths and four radix passes
(16 bits of the 63-bit cut key each), all ``groupBy`` sums with map-side
combine over (node, bucket); no node is ever gathered or sorted in one task,
and the cut table has one row per node.

Equal texts share one point (coordinates of the group's smallest source and
language, ties broken by the text's digest), so a cut keeps them together
unless what lies exactly on the cut weighs more than ``slack`` of a leaf;
such a hot group is divided by a hash of its rows.

Edge cases: null text weighs 1 byte, null metadata counts as the empty
string, repeated rows are rows of their own, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, table

#: Share of a leaf that may move to one side of a cut as a whole.
SLACK = 0.005
#: Rows numbered together when slots are given out.
SLOT_BLOCK = 20_000
#: Narrow rows a task takes in the passes over the coordinates.
TASK_ROWS = 250_000
_BITS, _ROUNDS = 16, 4


def _category(c: Column) -> Column:
    """A place on a fixed line for a categorical value (32 bits)."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def points(docs: DataFrame, id_col: str, text_col: str, categories: list[str]) -> DataFrame:
    """doc_id, size, text_crc32, tie, row and one 32-bit coordinate d0, d1, ...
    per dimension (categories first, then code points and bytes)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cats = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(categories)]
    rows = cut_lineage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        F.char_length(text).cast("long").alias("n_code"), *cats, F.monotonically_increasing_id().alias("row")))
    cs = [f"c{i}" for i in range(len(categories))]
    groups = cut_lineage(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"g_{c}") for c in cs]).where("n > 1").drop("n"))
    joined = rows.join(groups, "digest", "left")
    top = F.lit((1 << 32) - 1)
    dims = [_category(F.coalesce(F.col(f"g_{c}"), F.col(c))) for c in cs]
    # lengths on a logarithmic scale: order is kept, one giant document doesn't flatten the rest
    dims += [F.least(top, (F.log2(F.col(c) + 1) * F.lit(float(1 << 26))).cast("long")) for c in ("n_code", "size")]
    return joined.select("doc_id", "size", "text_crc32", "row", F.shiftrightunsigned(F.xxhash64("digest"), 33).alias("tie"),
                         F.shiftrightunsigned(F.xxhash64("row", "doc_id"), 33).alias("chance"),
                         *[d.cast("long").alias(f"d{i}") for i, d in enumerate(dims)])


def _cuts(rows: DataFrame, n_dims: int) -> DataFrame:
    """rows: node, leaves, left, size, d*, tie. One row per node that splits:
    node, dim, cut (63-bit key), below and at (bytes under and on the cut), total."""
    spans = [F.struct((F.max(f"d{i}") - F.min(f"d{i}")).alias("width"), F.lit(-i).alias("minus")) for i in range(n_dims)]
    state = cut_lineage(rows.groupBy("node", "leaves").agg(F.sum("size").alias("total"), F.greatest(*spans).alias("best"))
                        .select("node", (-F.col("best.minus")).alias("dim"), "total",
                                (F.col("total") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("goal"),
                                F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("at")))
    for k in range(_ROUNDS):
        shift = _BITS * (_ROUNDS - 1 - k)
        found = rows.join(F.broadcast(state), "node").withColumn("key", _key(n_dims))
        if k:  # rows that share the bits found so far
            found = found.where(F.shiftright("key", shift + _BITS) == F.col("prefix"))
        sums = found.groupBy("node", F.shiftright("key", shift).alias("bucket")).agg(
            F.sum("size").alias("w"), *[F.first(c).alias(c) for c in ("dim", "total", "goal")], F.first("below").alias("base"))
        run = Window.partitionBy("node").orderBy("bucket")
        upto = sums.withColumn("upto", F.col("base") + F.sum("w").over(run))
        last = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("bucket")))
        # the first bucket that passes the goal; the last one if rounding leaves none
        passed = upto.withColumn("from_end", last).where((F.col("upto") > F.col("goal")) | (F.col("from_end") == 1))
        state = cut_lineage(passed.groupBy("node").agg(F.min_by(F.struct("dim", "total", "goal", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("w")).alias("below"), F.col("w").alias("at")), "bucket").alias("s")).select("node", "s.*"))
    return state.withColumnRenamed("prefix", "cut")


def _key(n_dims: int) -> Column:
    place = F.coalesce(*[F.when(F.col("dim") == i, F.col(f"d{i}")) for i in range(n_dims)])
    return F.shiftleft(place, 31).bitwiseOR(F.col("tie"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id",
              text_col: str = "text", categories: tuple[str, ...] = ("source", "lang"), slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 within a shard).

    Give the number of ``shards`` or the ``target_bytes`` of a leaf."""
    cats = [c for c in categories if c in docs.columns]
    n_dims = len(cats) + 2
    rows = cut_lineage(points(docs, id_col, text_col, cats))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    # partitions that fit the narrow rows, however many the texts needed
    rows = rows.coalesce(max(1, -(-count // TASK_ROWS)))
    leaves = shards if shards else max(1, -(-total // max(1, target_bytes or total or 1)))
    leaf = max(1.0, total / leaves)
    # leaves below a node are numbered from `first`
    rows = rows.withColumns({"node": F.lit(0), "first": F.lit(0), "leaves": F.lit(leaves)})
    parts = leaves
    while parts > 1:
        splits = rows.where("leaves > 1")
        cuts = _cuts(splits, n_dims).select("node", "dim", "cut", "below", "at", "goal")
        joined = rows.join(F.broadcast(cuts), "node", "left").withColumn("key", F.when(F.col("dim").isNotNull(), _key(n_dims)))
        share = (F.col("goal") - F.col("below")) / F.col("at")
        on_cut = F.when(F.col("at") > slack * leaf, F.col("chance") < share * float(1 << 31)).otherwise(share >= 0.5)
        left = F.when(F.col("key") == F.col("cut"), on_cut).otherwise(F.col("key") < F.col("cut"))
        half = F.floor(F.col("leaves") / 2).cast("int")
        done = F.col("leaves") == 1
        rows = cut_lineage(joined.select(
            *[c for c in rows.columns if c not in ("node", "first", "leaves")],
            F.when(done | left, F.col("node") * 2 + 1).otherwise(F.col("node") * 2 + 2).alias("node"),
            F.when(done | left, F.col("first")).otherwise(F.col("first") + half).alias("first"),
            F.when(done, F.lit(1)).when(left, half).otherwise(F.col("leaves") - half).alias("leaves")))
        parts = -(-parts // 2)
    return _slots(rows.withColumn("shard", F.col("first").cast("int")), count)


def _slots(rows: DataFrame, count: int) -> DataFrame:
    """Positions within a shard: blocks of a hash are numbered apart, then
    moved by the rows of the blocks before them."""
    blocks = max(1, count // SLOT_BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "row")) - 1
    return rows.withColumn("place", place).join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("start")).cast("long").alias("slot"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes."""
    out = kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
