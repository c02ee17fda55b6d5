"""Document store jobs: keyed lookup, freshness, upsert, lifecycle flags,
tagging, multi-result explode and the NDJSON sink (S3-S6, W4, P1-P4, P8,
J3, J5, U2, U3).

The store is Parquet, one folder per ``entity_db``. Plain Parquet has no
MERGE, so an upsert computes the new snapshot of the touched stores with one
full outer join and writes it as a new version folder (stage); readers take
the newest complete version of each store (swap).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S


def _ts(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def lookup(keys: DataFrame, docs: DataFrame, on: Sequence[str] = ("entity_db", "_id")) -> DataFrame:
    """S3: batched get-by-key; absent keys keep null document columns."""
    return keys.join(docs, list(on), "left")


def is_stale(update_date: Column, serialized: Column, present: Column, as_of: str,
             ttl_s: int = S.MIN_SECONDS_BETWEEN_UPDATES, ts_type: str = "timestamp") -> Column:
    """P1 predicate: missing, no date, not serialized, or older (or newer)
    than ``ttl_s`` seconds relative to ``as_of``. The age is measured in the
    column's own type (``timestamp_ntz`` involves no time zone at all)."""
    age_us = F.abs(F.timestamp_diff("MICROSECOND", update_date, F.lit(as_of).cast(ts_type)))
    return (~present) | update_date.isNull() | ~F.coalesce(serialized, F.lit(False)) | (age_us > F.lit(ttl_s * 1_000_000))


def stale(work: DataFrame, docs: DataFrame, work_key: str, doc_key: str, as_of: str,
          ttl_s: int = S.MIN_SECONDS_BETWEEN_UPDATES) -> DataFrame:
    """P1 + J5: work items joined to their stored document (left join), with
    a ``stale`` flag. Fresh items reuse the stored document downstream."""
    d = docs.withColumn("__present", F.lit(True))
    j = work.join(d, work[work_key] == d[doc_key], "left")
    ts_type = "timestamp_ntz" if isinstance(docs.schema["update_date"].dataType, T.TimestampNTZType) else "timestamp"
    flag = is_stale(F.col("update_date"), F.col("serialized"), F.coalesce(F.col("__present"), F.lit(False)),
                    as_of, ttl_s, ts_type)
    return j.withColumn("stale", flag).drop("__present")


def current(work: DataFrame, docs: DataFrame, fetched: DataFrame, work_key: str, doc_key: str, as_of: str,
            cols: Sequence[str], ttl_s: int = S.MIN_SECONDS_BETWEEN_UPDATES) -> DataFrame:
    """J5 in full: a work item whose stored document is fresh goes on with
    the stored columns, any other with the fetched ones (null when nothing
    was fetched). ``origin`` says which."""
    j = stale(work, docs, work_key, doc_key, as_of, ttl_s)
    f = fetched.select(F.col(doc_key).alias("__fk"), *[F.col(c).alias(f"__f_{c}") for c in cols], F.lit(True).alias("__fetched"))
    j = j.join(f, j[work_key] == f["__fk"], "left")
    origin = F.when(~F.col("stale"), "stored").when(F.col("__fetched"), "fetched").otherwise("none")
    return j.select(*work.columns, origin.alias("origin"),
                    *[F.when(F.col("stale"), F.col(f"__f_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def last_write(batch: DataFrame, key: Sequence[str], order: Sequence[str], again: str | None = None) -> DataFrame:
    """One row per key, the one with the greatest ``order`` tuple. The
    flag column ``again`` (if named) says that the key was written repeatedly.

    A ``max(struct(order..., row))`` aggregate: partial aggregation on the map
    side keeps one row per key per task, so a key with a third of all rows
    never reaches one task whole (a window would sort it there)."""
    payload = [c for c in batch.columns if c not in key]
    best = F.max(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)],
                          *[F.col(c) for c in payload])).alias("__best")
    flags = [] if again is None else [(F.count(F.lit(1)) > 1).alias(again)]
    return batch.groupBy(*key).agg(best, *flags).select(*key, *[F.col(f"__best.{c}").alias(c) for c in payload], *([again] if again else []))


def restamped(count: Column) -> Column:
    """S5's counter for a document that exists: one more, or 1."""
    return F.coalesce(count + 1, F.lit(1))


def upsert(old: DataFrame, new: DataFrame, as_of: str, doc_type: Column | str | None = None,
           key: Sequence[str] = ("_id",), count_mode: str = "incoming", again: str | None = None, written: str | None = None) -> DataFrame:
    """Keyed upsert; returns the full new snapshot.

    Incoming documents are stamped (``type``, ``update_date = as_of``) and
    replace the stored ones whole: columns only they have stay, columns they
    lack become null. When the key exists (or the flag column ``again`` holds:
    the batch wrote it before), ``update_count`` becomes incoming count + 1 (or 1 when the
    incoming document has none) and ``_rev`` is taken from the stored one; a
    brand-new key keeps its incoming count. ``count_mode='stored'`` counts
    from the stored document instead. Keys only in ``old`` pass unchanged; the
    flag column ``written`` (if named) tells them from the others.
    """
    key = list(key)
    flag = F.lit(False) if again is None else F.col(again)
    new = new.select(*[c for c in new.columns if c != again], flag.alias("__again"))
    kinds = {f.name: f.dataType for f in [*new.schema, *old.schema]}
    cols = [*[c for c in old.columns if c not in key], *[c for c in new.columns if c not in [*key, "__again"] and c not in old.columns]]
    o = old.select(*key, *[F.col(c).alias(f"o__{c}") for c in cols if c in old.columns], F.lit(True).alias("o__present"))
    n = new.select(*key, *[F.col(c).alias(f"n__{c}") for c in new.columns if c not in [*key, "__again"]],
                   F.lit(True).alias("n__present"), F.col("__again").alias("n__again"))
    j = o.join(n, key, "full_outer")
    has_new = F.coalesce(F.col("n__present"), F.lit(False))
    known = F.coalesce(F.col("o__present"), F.lit(False)) | F.coalesce(F.col("n__again"), F.lit(False))
    of = lambda side, c: F.col(f"{side}__{c}") if f"{side}__{c}" in j.columns else F.lit(None)
    out = []
    for c in cols:
        if c == "update_count":
            v = F.when(known, restamped(of("n" if count_mode == "incoming" else "o", c))).otherwise(of("n", c))
        elif c == "_rev":
            v = F.when(F.col("o__present"), of("o", c)).otherwise(of("n", c))
        elif c == "update_date":
            v = F.lit(as_of).cast("timestamp")
        elif c == "type" and doc_type is not None:
            v = F.lit(doc_type) if isinstance(doc_type, str) else doc_type
        else:
            v = of("n", c)
        out.append(F.when(has_new, v).otherwise(of("o", c)).cast(kinds[c]).alias(c))
    return j.select(*key, *out, *([has_new.alias(written)] if written else []))


def tag(docs: DataFrame, phase_col: str = "phase_ref", iface_col: str = "iface") -> DataFrame:
    """Phase → ``class_id``, interface → ``variant_id``; marks the
    document serialized and not yet sent. Both dimensions have a fixed
    handful of rows, so broadcasting them is safe at any scale."""
    spark = docs.sparkSession
    ph = F.broadcast(S.phases(spark).select(F.col("phase_ref").alias("__ph"), F.col("phase_ref").alias("__class")))
    vi = F.broadcast(S.interfaces(spark).select(F.col("iface").alias("__if"), F.col("variant_id").alias("__var")))
    out = (docs.join(ph, docs[phase_col] == ph["__ph"], "left")
           .join(vi, F.col(iface_col) == vi["__if"], "left"))
    return (out.withColumn("class_id", F.col("__class").cast("int"))
            .withColumn("variant_id", F.col("__var").cast("int"))
            .withColumn("serialized", F.lit(True)).withColumn("sent", F.lit(False))
            .drop("__ph", "__class", "__if", "__var"))


def split_valid(docs: DataFrame, required: Sequence[str] = ("class_id", "variant_id")) -> tuple[DataFrame, DataFrame]:
    """Rows missing a mapping go to a ``rejected`` frame."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return docs.where(ok), docs.where(~ok)


def not_serialized(docs: DataFrame) -> DataFrame:
    """P2"""
    return docs.where(~F.coalesce(F.col("serialized"), F.lit(False)))


def to_package(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Skip documents already sent; a missing ``sent`` flag is an error
    in the reference, here it goes to a quarantine frame."""
    return docs.where(F.col("sent") == F.lit(False)), docs.where(F.col("sent").isNull())


def unsent(docs: DataFrame) -> DataFrame:
    """Recovery picks ``sent = false`` exactly (null excluded)."""
    return docs.where(F.col("sent") == F.lit(False))


def ndjson(docs: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """One JSON document per row; nulls are written as ``null``."""
    return F.to_json(F.struct(*(cols or docs.columns)), {"ignoreNullFields": "false"})


def write_ndjson(docs: DataFrame, path: str, compression: str | None = None) -> None:
    """S6 sink: newline-delimited JSON text files."""
    w = docs.select(ndjson(docs).alias("value")).write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    w.text(path)


def parsed_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Every non-empty stripped line with its parsed ``doc`` (null when
    the line is not a JSON object)."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where(F.col("value") != "")
    return lines.select("value", F.when(F.try_parse_json("value").isNotNull() & F.col("value").startswith("{"),
                                        F.from_json("value", schema)).alias("doc"))


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Newline-framed source; malformed lines are left to :func:`bad_lines`."""
    return parsed_lines(spark, path, schema).where(F.col("doc").isNotNull()).select("doc.*")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """The raw lines that are not JSON objects."""
    return parsed_lines(spark, path, "x STRING").where(F.col("doc").isNull()).select("value")


def explode_multi(docs: DataFrame, parent_key: Sequence[str], list_col: str) -> DataFrame:
    """One row per entity of a multi-result list; a document whose list
    is empty or null keeps one row with null position."""
    return docs.select(*parent_key, F.posexplode_outer(list_col).alias("pos", "entity"))


def explode_citation_graph(pubs: DataFrame, id_col: str = "publication_id",
                           graph_col: str = "citation_graph") -> DataFrame:
    """(publication_id, year, citations) rows from the nested graph."""
    g = pubs.select(F.col(id_col).alias("publication_id"), F.explode(graph_col).alias("g"))
    return g.select("publication_id", F.col("g.year").cast("int").alias("year"),
                    F.col("g.citations").cast("int").alias("citations"))


# ------------------------------------------------------- versioned store
# One folder per commit: {store}/v=<n>-<source>-<batch>/entity_db=<db>/...
# A commit holds the whole new snapshot of every store it touches and becomes
# visible, all stores at once, with its _SUCCESS marker. Numbers come from the
# folder itself, so any number of streams and checkpoints can follow each
# other; source and batch tell a replayed micro-batch.
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def land(spark: SparkSession, folder: str, target: str, schema: T.StructType) -> None:
    """A written Parquet folder becomes ``target``, one without rows when nothing was written."""
    fs, source = _fs(spark, folder)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not fs.exists(source):
        S.empty(spark, schema).write.parquet(target)
        return
    fs.mkdirs(to.getParent())
    if not fs.rename(source, to):
        raise OSError(f"cannot move {folder} to {target}")


def commits(spark: SparkSession, store_path: str) -> list[tuple[int, str, str]]:
    """(number, "<source>-<batch>", folder) of the complete commits, in order.
    Only a missing store path means "none"."""
    fs, root = _fs(spark, store_path)
    if not fs.exists(root):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(path(st.getPath(), "_SUCCESS")):
            number, _, tag = name[2:].partition("-")
            out.append((int(number), tag, f"{store_path}/{name}"))
    return sorted(out)


def read_versions(spark: SparkSession, store_path: str, dbs: Sequence[str] | None = None,
                  schema: T.StructType = S.DOCUMENT_SCHEMA) -> DataFrame:
    """The current documents (newest commit of every store), optionally only
    some stores; empty and typed when nothing was written yet (S2, S4)."""
    fs, _ = _fs(spark, store_path)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    newest: dict[str, str] = {}
    for _, _, folder in commits(spark, store_path):
        for st in fs.listStatus(path(folder)):
            name = st.getPath().getName()
            if name.startswith("entity_db="):
                newest[name] = f"{folder}/{name}"
    paths = [(n.partition("=")[2], p) for n, p in newest.items() if dbs is None or n.partition("=")[2] in dbs]
    body = T.StructType([f for f in schema if f.name != "entity_db"])
    out = S.empty(spark, schema)
    for db, p in paths:  # a handful of stores
        out = out.unionByName(spark.read.schema(body).parquet(p).withColumn("entity_db", F.lit(db)))
    return out.select(*[c.name for c in schema])


def write_commit(docs: DataFrame, store_path: str, source: str, batch_id: int) -> str:
    """Write the snapshot of all touched stores as the next commit."""
    done = commits(docs.sparkSession, store_path)
    folder = f"{store_path}/v={(done[-1][0] if done else 0) + 1:08d}-{source}-{batch_id}"
    docs.write.mode("overwrite").partitionBy("entity_db").parquet(folder)
    return folder


def committed(spark: SparkSession, store_path: str, source: str, batch_id: int) -> bool:
    return any(tag == f"{source}-{batch_id}" for _, tag, _ in commits(spark, store_path))
