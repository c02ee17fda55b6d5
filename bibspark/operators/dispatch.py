"""O1 with ageing: which queued item every receive takes.

Items are sent and received in one order of operations. A receive takes the
best queued item: system items first, then least depth, least priority, newest
(then first sent); on an empty queue it takes nothing. After every
``AGEING_STEP`` items taken, the priorities of all queued items fall by one, so
items that wait rise against later ones.

The sequential replay is done without putting the operations into one task:

* Ageing moves all queued items alike, so an item can carry a fixed key:
  priority plus the number of ageing steps made before it was sent. How many
  items were taken before an operation follows from running sums alone: with
  D = receives - sends so far, the receives that found nothing are the new
  maxima of D above zero.
* The best items take their receives without regard to all others. So for
  every bound on the key, the receives used by the items below it are found by
  the same running sums over just those items; comparing ``WAYS`` bounds at
  once deals items and receives to ``WAYS`` independent sets. That is repeated
  until a set has at most ``LEAF`` items, whose receives one task hands out
  with a heap.

Running sums are taken per range partition and moved by a small table of
partition totals; nothing is collected, and a set that spans many partitions
costs no more than many sets.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import cut_lineage
from .metrics import sequence_number

#: Fixed value: items taken between two ageing steps.
AGEING_STEP = 100
#: Sets that one pass deals items to, and items of a set that one task replays.
WAYS, LEAF = 16, 50_000


def _running(ops: DataFrame, group: Sequence[str], order: str, steps: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """Rows of ops with, for every step column of ``steps``, its running sum
    (name) and the largest earlier running sum of at least zero (name_top), and
    for ``sums`` the sum over earlier rows, all within the group."""
    group = list(group)
    keys = [*group, order]
    stored = cut_lineage(ops.withColumns({**{f"__{n}": c for n, c in steps.items()}, **{f"__{n}": c for n, c in sums.items()}})
                         .repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33).alias("__part")
    rows = Window.partitionBy(*group, "__part").orderBy("__id")
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    earlier = rows.rowsBetween(Window.unboundedPreceding, -1)
    local = stored.withColumn("__part", part).withColumns(
        {**{f"__d_{n}": F.sum(f"__{n}").over(upto) for n in steps}, **{f"__s_{n}": F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)) for n in sums}})
    local = local.withColumns({f"__m_{n}": F.max(f"__d_{n}").over(earlier) for n in steps})
    totals = local.groupBy(*group, "__part").agg(*[F.sum(f"__{n}").alias(f"t_{n}") for n in [*steps, *sums]], *[F.max(f"__d_{n}").alias(f"x_{n}") for n in steps])
    parts = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    totals = totals.withColumns({f"o_{n}": F.coalesce(F.sum(f"t_{n}").over(parts), F.lit(0)) for n in [*steps, *sums]})
    totals = totals.withColumns({f"p_{n}": F.max(F.col(f"x_{n}") + F.col(f"o_{n}")).over(parts) for n in steps})
    moves = totals.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__at"), *[f"o_{n}" for n in [*steps, *sums]], *[f"p_{n}" for n in steps])
    same = [local["__part"] == moves["__at"]] + [local[g].eqNullSafe(moves[f"__g{i}"]) for i, g in enumerate(group)]
    out = local.join(moves, same)
    own = {n: F.col(f"o_{n}") + F.col(f"__d_{n}") for n in steps}
    tops = {f"{n}_top": F.greatest(F.lit(0), F.col(f"p_{n}"), F.col(f"o_{n}") + F.col(f"__m_{n}")) for n in steps}
    before = {n: F.col(f"o_{n}") + F.col(f"__s_{n}") for n in sums}
    return out.select(*ops.columns, *[c.alias(n) for n, c in {**own, **tops, **before}.items()])


def taken_before(ops: DataFrame, order: str, action_col: str = "action") -> DataFrame:
    """The operations with ``finds`` (does the receive find an item?) and
    ``taken`` (items taken before the operation). Needs a dense ``order``."""
    receive = F.col(action_col) == "receive"
    step = F.when(receive, 1).otherwise(-1)
    run = _running(ops.withColumn("__all", F.lit(0)), ["__all"], order, {"d": step}, {"receives": F.when(receive, 1).otherwise(0)})
    return run.select(*ops.columns, (receive & (F.col("d") <= F.col("d_top"))).alias("finds"), (F.col("receives") - F.col("d_top")).alias("taken"))


def _replay(batches_of_set: pa.Table) -> pa.Table:
    """One set in order of operations: every receive takes the least rank queued."""
    t = batches_of_set.sort_by("seq")
    queued: list[int] = []
    slots, ranks = [], []
    for seq, rank in zip(t.column("seq").to_pylist(), t.column("rank").to_pylist()):
        if rank is not None:
            heapq.heappush(queued, rank)
        else:
            slots.append(seq)
            ranks.append(heapq.heappop(queued))
    return pa.table({"seq": pa.array(slots, pa.int64()), "rank": pa.array(ranks, pa.int64())})


def dispatched(ops: DataFrame, order: Sequence[str], item_col: str, action_col: str = "action", system_col: str = "system",
               depth_col: str = "depth", priority_col: str = "priority", ts_col: str = "ts", max_depth: int = S.DEPTH_MAX,
               leaf: int = LEAF, ways: int = WAYS) -> DataFrame:
    """One row per receive that finds an item: ``serve`` (1, 2, ...), the
    receive's ``order`` columns (``at_...``), the item, and ``priority_read``,
    its priority by then. Sends deeper than ``max_depth`` are dropped (P5).

    ``order`` is unique and says which operation comes first. Items that never
    were received have no row; a null system flag is false, a null depth or
    priority counts as 0, and of two null times the item sent first comes
    first, behind those with a time."""
    order = list(order)
    send = F.col(action_col) == "send"
    depth = F.coalesce(F.col(depth_col), F.lit(0))
    named = ops.where((F.col(action_col) == "receive") | (send & (depth <= max_depth))).select(
        *[F.col(o).alias(f"at_{o}") for o in order], F.col(action_col).alias("action"), F.col(item_col).alias("__item"),
        (~F.coalesce(F.col(system_col), F.lit(False))).alias("__late"), depth.alias("__depth"), F.coalesce(F.col(priority_col), F.lit(0)).cast("long").alias("__priority"),
        F.col(ts_col).alias("__ts"))
    ats = [f"at_{o}" for o in order]
    numbered = sequence_number(named.withColumn("__all", F.lit(0)), ["__all"], ats, "seq").drop("__all")
    timed = cut_lineage(taken_before(numbered, "seq"))

    aged = F.floor(F.col("taken") / AGEING_STEP)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(ops.schema[ts_col].dataType), F.col("__ts"))
    sends = timed.where(send).withColumns({"__key": F.col("__priority") + aged, "__aged": aged, "__newest": -micros})
    sends = sends.withColumn("__newest", F.coalesce("__newest", F.lit(2**62)))
    ranked = cut_lineage(sequence_number(sends.withColumn("__all", F.lit(0)), ["__all"], ["__late", "__depth", "__key", "__newest", "seq"], "rank")
                         .select("seq", "rank", "__item", "__priority", "__aged"))
    n = ranked.count()
    # sets: rank // width; a pass cuts every set into ``ways``
    width = leaf
    while width * ways < n:
        width *= ways
    # at first all items and receives are one set
    rows = ranked.select("seq", "rank").unionByName(timed.where("finds").select("seq", F.lit(None).cast("long").alias("rank"))).withColumn("set", F.lit(0).cast("long"))
    outer = width * ways
    while n > leaf:
        place = F.floor((F.col("rank") - F.col("set") * outer) / width)  # of an item within its set
        steps = {f"d{j}": F.when(F.col("rank").isNull(), 1).when(place <= j, -1).otherwise(0) for j in range(ways)}
        run = _running(rows, ["set"], "seq", steps, {})
        used = F.coalesce(*[F.when(F.col(f"d{j}") <= F.col(f"d{j}_top"), F.lit(j)) for j in range(ways)])  # the best set that uses the receive
        rows = cut_lineage(run.select("seq", "rank", (F.col("set") * (outer // width) + F.when(F.col("rank").isNull(), used).otherwise(place)).cast("long").alias("set")))
        if width <= leaf:
            break
        outer, width = width, width // ways
    replayed = rows.groupBy("set").applyInArrow(_replay, "seq long, rank long")
    slots = timed.where("finds").select("seq", *ats, "taken")
    out = replayed.join(slots, "seq").join(ranked.drop("seq"), "rank")
    read = F.col("__priority") - (F.floor(F.col("taken") / AGEING_STEP) - F.col("__aged"))
    return out.select((F.col("taken") + 1).alias("serve"), *ats, F.col("__item").alias(item_col), read.cast("long").alias("priority_read"))
