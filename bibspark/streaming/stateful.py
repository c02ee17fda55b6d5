"""Streams whose answers need keyed state of their own.

State lives in Spark's state store, one small row a key (T2) or a bucket of
keys (A8, T1), and goes with the checkpoint: a restarted query goes on where it
stopped. Rows are thinned out batch-wise before they are grouped, so that a key
with a third of all rows sends few of them to its task (A8, T2); where every row
of a key counts in order (T1) a task holds one bucket's rows of one micro-batch.

A stream is fed part by part with :func:`run_parts`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path
from . import streams

HOUR_MS = 3_600_000
#: Groups that the repeats of a key within an Arrow batch are dealt to.
LANES = 64
#: Groups that keys are dealt to by their hash: fixed, as state is found by them.
SEEN_BUCKETS, TTL_BUCKETS = 1 << 11, 1 << 10


def run_parts(spark: SparkSession, parts: Sequence[DataFrame], name: str, build: Callable[[DataFrame], DataFrame],
              mode: str = "append", key: Sequence[str] | None = None) -> DataFrame:
    """Run ``build(stream)`` over parts that land one after the other: every
    part (as many files as it has partitions) is one data micro-batch, and
    between two of them the query is stopped and started again from its
    checkpoint. Returns the result as a batch frame."""
    base = scratch_path(spark, name)
    folder, schema = f"{base}/in", parts[0].schema
    out = None
    for k, part in enumerate(parts):
        part.write.parquet(f"{folder}/part-{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        out = streams.run_available(spark, build(stream), name, mode, key, base)
    return out


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


# ------------------------------------------------------------------------ A8
def _long_as_text(df: DataFrame, names: Sequence[str], rest: Sequence[str] = ()) -> DataFrame:
    """Whole numbers as text: pandas turns those of columns with nulls into floats."""
    return df.select(*[F.col(n).cast("string").alias(n) if isinstance(df.schema[n].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) else F.col(n) for n in names], *rest)


def _key_text(keys: Sequence[str]) -> Column:
    """The key columns as one text, different for different keys."""
    at = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return F.to_json(F.struct(*keys), {"timestampFormat": f"{at}XXX", "timestampNTZFormat": at})


def _bucket(keys: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _lanes(order: Sequence[str]):
    """Leaves, in every Arrow batch, the first arrival of a key in its bucket
    and deals its other arrivals, which cannot be the first, to groups
    -1..-LANES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            by_order = pc.sort_indices(t, sort_keys=[(o, "ascending") for o in order]).to_numpy()
            codes = pc.dictionary_encode(b.column("__key")).indices.to_numpy(zero_copy_only=False)
            group = (-1 - np.arange(b.num_rows) % LANES).astype(np.int32)
            first = by_order[np.unique(codes[by_order], return_index=True)[1]]
            group[first] = b.column("__bucket").to_numpy(zero_copy_only=False)[first]
            yield b.set_column(b.schema.get_field_index("__bucket"), "__bucket", pa.array(group))

    return run


def new_item_answers(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For every arrival (keys and order columns), was its key new?

    The first arrival of a key ever answers ``true``, every later one
    ``false``; within a micro-batch the least ``order`` comes first (it has no
    nulls and is unique). A null key is a key. Only the first arrival of each
    Arrow batch asks the state; repeats are answered in other groups.
    State: every key ever seen, in SEEN_BUCKETS sets by the keys' hash, so that
    a micro-batch calls Python once a set and not once a key."""
    keys, order = list(keys), list(order)
    fields = [*_fields(stream, keys), *_fields(stream, order)]
    marked = stream.select(*keys, *order, _key_text(keys).alias("__key"), _bucket(keys, SEEN_BUCKETS).alias("__bucket"))
    own = _long_as_text(marked, keys, [*order, "__key", "__bucket"])
    out = T.StructType([*_fields(own, keys), *_fields(own, order), T.StructField("is_new", T.BooleanType())])
    laned = own.mapInArrow(_lanes(order), own.schema)

    def answer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            for f in frames:
                yield f[keys + order].assign(is_new=False)
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, ignore_index=True)
        seen = state.get[0] if state.exists else []
        is_new = ~(rows["__key"].duplicated() | rows["__key"].isin(set(seen)))
        if is_new.any():
            state.update((list(seen) + rows["__key"][is_new].tolist(),))
        yield rows[keys + order].assign(is_new=is_new)

    got = laned.groupBy("__bucket").applyInPandasWithState(answer, out, "seen array<string>", "append", GroupStateTimeout.NoTimeout)
    return got.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields], "is_new")


# ------------------------------------------------------------------------ T1
def dedupe_ttl(stream: DataFrame, keys: Sequence[str], ts_col: str, order: Sequence[str], ttl: str, delay: str = "0 seconds",
               system_col: str | None = None) -> DataFrame:
    """T1 with bounded state: a message is dropped if its key was let through
    within ``ttl`` before it; later ones are let through again.

    Decided in order of (ts, order) within a micro-batch. A key's state (time
    of its last message let through) goes when the watermark, ``delay`` behind
    the newest message, passes that time plus ``ttl``: the state holds the keys
    of one ``ttl`` + ``delay`` of messages, however long the stream runs. Keys
    are dealt to TTL_BUCKETS by their hash and those of a bucket are decided
    together, so that a micro-batch calls Python once a bucket.
    Messages behind the watermark are dropped. System messages pass. Messages
    without a time are dropped."""
    keys, order = list(keys), list(order)
    names, fields = stream.columns, stream.schema.fields
    ntz = isinstance(stream.schema[ts_col].dataType, T.TimestampNTZType)
    if ntz:
        stream = stream.withColumn(ts_col, streams.ntz_as_utc(F.col(ts_col)))
    span = int(pd.Timedelta(ttl) / pd.Timedelta(microseconds=1))
    system = F.coalesce(F.col(system_col), F.lit(False)) if system_col else F.lit(False)
    normal = _long_as_text(stream.where(~system & F.col(ts_col).isNotNull()), names)
    schema = normal.schema
    numeric = {f.name for f in fields if f.dataType != schema[f.name].dataType and f.name != ts_col}
    normal = normal.withColumns({"__us": F.unix_micros(ts_col), "__key": _key_text(keys), "__bucket": _bucket(keys, TTL_BUCKETS)}).withWatermark(ts_col, delay)

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = dict(zip(*state.get)) if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True)
            codes, found = pd.factorize(rows["__key"])
            rank = [codes, rows["__us"], *[pd.to_numeric(rows[o]) if o in numeric else rows[o] for o in order]]
            by_key = np.lexsort(rank[::-1])
            codes, at = codes[by_key], rows["__us"].to_numpy(np.int64)[by_key]
            times = np.unique(at)
            width = len(times) + 1
            place = codes * width + np.searchsorted(times, at)

            def after(of: np.ndarray, last: np.ndarray) -> np.ndarray:
                """The first message of each key that its last one lets through."""
                return np.searchsorted(place, of * width + np.searchsorted(times, last + span, "right") - 1, "right")
            of = np.arange(len(found))
            stop = np.searchsorted(codes, of, "right")
            at_first = np.searchsorted(codes, of)
            known = np.array([held.get(k) is not None for k in found], bool)
            before = np.array([held.get(k, 0) for k in found], np.int64)
            i = np.where(known, after(of, before), at_first)
            kept = []
            while (live := i < stop[of]).any():
                of, i = of[live], i[live]
                kept.append(i)
                before[of] = at[i]
                i = after(of, at[i])
            held.update(zip(found.tolist(), before.tolist()))
        held = {k: last for k, last in held.items() if (last + span) // 1000 + 1 > mark}
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp((min(held.values()) + span) // 1000 + 1)
        elif state.exists:
            state.remove()
        if not state.hasTimedOut and kept:
            yield rows.iloc[by_key[np.concatenate(kept)]][names]

    out = normal.groupBy("__bucket").applyInPandasWithState(
        keep, T.StructType([schema[n] for n in names]), "keys array<string>, last array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    back = lambda df: df.select(*[(streams.utc_as_ntz(F.col(f.name)) if ntz and f.name == ts_col else F.col(f.name).cast(f.dataType)).alias(f.name) for f in fields])
    out = back(out)
    return out if system_col is None else out.unionByName(back(stream.where(system)))


# ------------------------------------------------------------------------ T2
def _hourly_sums(keys: Sequence[str], period_ms: int):
    """In every Arrow batch: the pages of a key and period in one row, and a
    tick with the newest time, which alone moves the watermark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ms = b.column("__ms").to_numpy()
            t = pa.table({**{k: b.column(k) for k in keys}, "due": (ms // period_ms + 1) * period_ms, "blocked": pc.cast(b.column("__blocked"), pa.int64())})
            g = t.group_by([*keys, "due"], use_threads=False).aggregate([("blocked", "sum"), ([], "count_all")])
            n = g.num_rows
            data = [g.column(k).combine_chunks() for k in keys]
            nulls = [pa.nulls(1, b.column(k).type) for k in keys]
            names = [*keys, "due", "n_blocked", "n_pages", "tick", "clock"]
            yield pa.RecordBatch.from_arrays([*data, g.column("due").combine_chunks(), g.column("blocked_sum").combine_chunks(), g.column("count_all").combine_chunks(), pa.array([False] * n), pa.nulls(n, pa.timestamp("us", "UTC"))], names)
            yield pa.RecordBatch.from_arrays([*nulls, *(pa.array([0], pa.int64()) for _ in range(3)), pa.array([True]), pa.array([int(ms.max()) * 1000], pa.timestamp("us", "UTC"))], names)

    return run


def read_and_clear(stream: DataFrame, ts_col: str, blocked: Column, keys: Sequence[str] = (), period_ms: int = HOUR_MS,
                   delay: str = "0 seconds") -> DataFrame:
    """Every period a monitor reads a flag that blocked pages raise, and
    clears it. One row per key and reading: ``check`` (end of the period),
    ``was_blocked`` (the answer read), ``flag_after`` (false: cleared),
    ``reverse`` (nothing was raised: the reference relaxes its waits),
    ``n_blocked``, ``n_pages`` and ``n_late`` of the pages that it answers for.

    A reading is due when the watermark, ``delay`` behind the newest page of
    all keys, passes its time. A page counts for the end of its own period; one
    that comes after that reading raises the flag again, for the next reading
    to come (the watermark drops no page). A key is read from its first page
    on, also in periods without pages, by a timer in its state. Readings that
    are not due yet wait in the state (one entry a period). Pages without a
    time are left out; a null answer of ``blocked`` is no block."""
    keys = list(keys)
    own = stream.select(*keys, F.unix_millis(streams.ntz_as_utc(F.col(ts_col)) if isinstance(stream.schema[ts_col].dataType, T.TimestampNTZType) else F.col(ts_col)).alias("__ms"),
                        F.coalesce(blocked, F.lit(False)).alias("__blocked")).where(F.col("__ms").isNotNull())
    sums = T.StructType([*_fields(stream, keys), *[T.StructField(n, T.LongType()) for n in ("due", "n_blocked", "n_pages")],
                         T.StructField("tick", T.BooleanType()), T.StructField("clock", T.TimestampType())])
    ticking = own.mapInArrow(_hourly_sums(keys, period_ms), sums).withWatermark("clock", delay)
    names = [f"k{j}" for j in range(len(keys))]
    answer = T.StructType([*[T.StructField(n, stream.schema[k].dataType) for n, k in zip(names, keys)], *[T.StructField(n, T.LongType()) for n in ("check_ms", "n_blocked", "n_pages", "n_late")]])

    def read(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[-1]:  # ticks
            return
        now = max(0, state.getCurrentWatermarkMs())
        due_next, waiting = None, {}
        if state.exists:
            due_next, due, n_blocked, n_pages, n_late = state.get
            waiting = {d: [b, p, late] for d, b, p, late in zip(due, n_blocked, n_pages, n_late)}
        done = []
        while due_next is not None and due_next < now:
            done.append((*key[:-1], due_next, *waiting.pop(due_next, (0, 0, 0))))
            due_next += period_ms
        if not state.hasTimedOut:
            to_come = -(-now // period_ms) * period_ms  # the first reading that is not done
            for f in frames:
                for due, b, p in zip(f["due"].tolist(), f["n_blocked"].tolist(), f["n_pages"].tolist()):
                    at = max(due, to_come)
                    mine = waiting.setdefault(at, [0, 0, 0])
                    mine[0], mine[1], mine[2] = mine[0] + b, mine[1] + p, mine[2] + (p if due < at else 0)
            if due_next is None:
                due_next = min(waiting)
        entries = sorted(waiting.items())
        state.update((due_next, [d for d, _ in entries], *([e[j] for _, e in entries] for j in range(3))))
        state.setTimeoutTimestamp(max(due_next, now + 1))
        if done:
            yield pd.DataFrame(done, columns=answer.names)

    got = ticking.groupBy(*keys, "tick").applyInPandasWithState(
        read, answer, "due_next long, due array<long>, n_blocked array<long>, n_pages array<long>, n_late array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return got.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], streams.utc_as_ntz(F.timestamp_millis("check_ms")).alias("check"),
                      (F.col("n_blocked") > 0).alias("was_blocked"), F.lit(False).alias("flag_after"), (F.col("n_blocked") == 0).alias("reverse"),
                      "n_blocked", "n_pages", "n_late")


# ------------------------------------------------------------- A1 A4 T4
COUNTERS = "content STRING, n BIGINT, last_ts TIMESTAMP_NTZ"


def resumed_counts(stream: DataFrame, content_col: str, ts_col: str, saved_folder: str | None = None) -> DataFrame:
    """A1/A4 as counters that outlive a run: ``[n, last time]`` per content.

    The counters that an earlier run saved (:func:`save_counts`) come in as
    rows of the stream, weighted by their count: the checkpoint remembers that
    they were read, so a restarted query doesn't add them again."""
    one = stream.select(F.col(content_col).cast("string").alias("content"), F.lit(1).cast("long").alias("n"), F.col(ts_col).cast("timestamp_ntz").alias("last_ts"))
    if saved_folder is not None:
        one = one.unionByName(stream.sparkSession.readStream.schema(COUNTERS).parquet(saved_folder))
    return one.groupBy("content").agg(F.sum("n").alias("n"), F.max("last_ts").alias("last_ts"))


def save_counts(counts: DataFrame, folder: str) -> None:
    """The counters at the end of a run, for the next one to start from."""
    counts.select("content", "n", "last_ts").write.parquet(folder)
