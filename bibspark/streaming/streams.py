"""Structured Streaming jobs.

Every stream checkpoints under the shared folder named by
``spark.checkpoint.dir`` (see :mod:`bibspark.session`), so a restarted query
resumes where it stopped. A micro-batch that is replayed after a failure
overwrites what it wrote (keyed sinks) or finds its commit (document store).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators import store
from ..session import cut_lineage, scratch_path

EVENTS_SCHEMA = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
                 "value DOUBLE, props STRING")


def read_stream(spark: SparkSession, folder: str, schema: str, name_glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream source: parquet files landing in ``folder`` (optionally
    only those whose name matches ``name_glob``)."""
    r = spark.readStream.schema(schema)
    if name_glob:
        r = r.option("pathGlobFilter", name_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


# ----------------------------------------------------------------------- T1
def dedupe(stream: DataFrame, keys: Sequence[str], system_col: str | None = None,
           ts_col: str | None = None, ttl: str | None = None) -> DataFrame:
    """Drop messages whose key was seen before; system messages exempt.

    Without ``ttl`` the seen-key state is unbounded (the reference keeps its
    set for the life of the process). With ``ttl`` (e.g. ``"30 days"``, the
    freshness span) keys are forgotten after the watermark passes them."""
    keys = list(keys)
    if ttl is not None and isinstance(stream.schema[ts_col].dataType, T.TimestampNTZType):
        stream = stream.withColumn(ts_col, ntz_as_utc(F.col(ts_col)))
    normal = stream if system_col is None else stream.where(~F.coalesce(F.col(system_col), F.lit(False)))
    if ttl is not None:
        deduped = normal.withWatermark(ts_col, ttl).dropDuplicatesWithinWatermark(keys)
    else:
        deduped = normal.dropDuplicates(keys)
    if system_col is None:
        return deduped
    return deduped.unionByName(stream.where(F.coalesce(F.col(system_col), F.lit(False))))


# ----------------------------------------------------------------------- T2
def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def ntz_as_utc(c: Column) -> Column:
    """A ``TIMESTAMP_NTZ`` wall time read as UTC, as an instant: independent
    of the session time zone (watermarks need ``TIMESTAMP``)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch_ntz(), c))


def utc_as_ntz(c: Column) -> Column:
    """Inverse of :func:`ntz_as_utc`."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), _epoch_ntz())


def hourly_blocked(stream: DataFrame, ts_col: str, blocked: Column, delay: str | None = None) -> DataFrame:
    """Per UTC hour, was any fetched page blocked (and how many).
    No page is too late (state: one row per hour) unless a ``delay`` is
    given, after which hours are closed and later pages are dropped.
    ``window_start`` is the hour as ``TIMESTAMP_NTZ`` when the event time is
    one (no session-zone shift either way)."""
    ntz = isinstance(stream.schema[ts_col].dataType, T.TimestampNTZType)
    if ntz:
        stream = stream.withColumn(ts_col, ntz_as_utc(F.col(ts_col)))
    if delay is not None:
        stream = stream.withWatermark(ts_col, delay)
    agg = (stream.groupBy(F.window(ts_col, "1 hour").alias("w"))
           .agg(F.bool_or(blocked).alias("blocked"), F.count_if(blocked).alias("n_blocked"),
                F.count(F.lit(1)).alias("n_pages")))
    start = utc_as_ntz(F.col("w.start")) if ntz else F.col("w.start")
    return agg.select(start.alias("window_start"), "blocked", "n_blocked", "n_pages")


# ----------------------------------------------------------------------- T4
def running_counts(stream: DataFrame, key: str, action_col: str | None = None) -> DataFrame:
    """T4: running per-type counters (A1, and A2 when an action column
    says send/receive)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if action_col:
        aggs += [F.sum(F.when(F.col(action_col) == "send", 1).when(F.col(action_col) == "receive", -1)
                       .otherwise(0)).alias("backlog")]
    return stream.groupBy(key).agg(*aggs)


# ------------------------------------------------------------ keyed sinks
def versioned_sink(path: str, keep_cols: Sequence[str] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for update-mode aggregates: each micro-batch is
    written under ``batch_id=<id>`` (overwritten if the batch is replayed);
    readers take the newest version per key (:func:`read_versioned`)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch if keep_cols is None else batch.select(*keep_cols)
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def read_versioned(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """Latest row per key over all written micro-batches."""
    df = spark.read.parquet(path)
    return store.last_write(df, key, ["batch_id"]).drop("batch_id")


def run_available(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append",
                  key: Sequence[str] | None = None, base: str | None = None) -> DataFrame:
    """Run a stream over everything available now, then stop, and return its
    result as a batch DataFrame (append: parquet sink; update: keyed
    versioned sink). Checkpoint and output live in the shared folder, below
    ``base`` if the stream goes on from an earlier run."""
    base = base or scratch_path(spark, name)
    out, ckpt = f"{base}/out", f"{base}/checkpoint"
    w = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out).start()
    else:
        q = w.outputMode("update").foreachBatch(versioned_sink(out)).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    return read_versioned(spark, out, key or [])


# ----------------------------------------------------------------------- T3
def lifecycle_sink(store_path: str, export_path: str, as_of: str, source: str = "stream",
                   order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """T3 as a foreachBatch sink over a versioned store (see
    :func:`store.read_versions`).

    Each micro-batch: documents already serialized pass by (P2); of several
    writes of a key the last by ``order`` wins (W4); the rest is tagged (J3),
    documents without a mapping go to ``{export}/rejected`` (P8), documents
    without a ``sent`` flag to ``{export}/quarantine`` (P3). The others are
    upserted into the newest snapshot of their stores (S5) as fetched, stamped
    again when serialized, exported as NDJSON (S6, so lines carry
    ``sent=false``), and stamped again as sent. All touched stores change in
    one commit. ``source`` names the stream (one per checkpoint): a replayed
    batch finds its own commit and changes nothing; exports and rejects are
    overwritten under the batch's name.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if store.committed(spark, store_path, source, batch_id):
            return
        key = ["entity_db", "_id"]
        name = f"{source}-{batch_id}"
        todo = store.not_serialized(batch if "serialized" in batch.columns else batch.withColumn("serialized", F.lit(False)))
        # the batch is aggregated once; all that follows reads its result
        last = store.last_write(todo, key, list(order), again="__again").where(F.col("entity_db").isNotNull() & F.col("_id").isNotNull())
        docs = cut_lineage(store.tag(last))
        valid, rejected = store.split_valid(docs)
        ready, quarantine = store.to_package(valid)
        cols = [c.name for c in S.DOCUMENT_SCHEMA]
        typed = ready.select(*[F.col(c) if c in ready.columns else F.lit(None).cast(S.DOCUMENT_SCHEMA[c].dataType).alias(c)
                               for c in cols], "__again")
        dbs = [r[0] for r in typed.select("entity_db").distinct().collect()]  # a handful of stores
        old = store.read_versions(spark, store_path, dbs)
        snap = cut_lineage(store.upsert(old, typed, as_of=as_of, key=key, again="__again", written="__new"))
        new = F.col("__new")
        serialized = F.when(new, store.restamped(F.col("update_count"))).otherwise(F.col("update_count"))
        packed = snap.withColumn("update_count", serialized)
        store.write_ndjson(packed.where(new).select(*cols), f"{export_path}/lines/batch={name}")
        for kind, rows in (("rejected", rejected), ("quarantine", quarantine)):
            rows.drop("__again").write.mode("overwrite").parquet(f"{export_path}/{kind}/batch={name}")
        sent = packed.withColumns({"sent": F.when(new, F.lit(True)).otherwise(F.col("sent")),
                                   "update_count": F.when(new, store.restamped(F.col("update_count"))).otherwise(F.col("update_count"))})
        store.write_commit(sent.select(*cols), store_path, source, batch_id)
    return run


# ----------------------------------------------------------------------- T5
def ingest_pages(pages_stream: DataFrame, extractor: Callable[[DataFrame], DataFrame],
                 sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """T5: new pages → extractor → keyed sink, one micro-batch at a time."""
    w = pages_stream.writeStream.option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.foreachBatch(lambda df, i: sink(extractor(df), i)).start()
