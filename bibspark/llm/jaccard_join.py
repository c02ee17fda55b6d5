"""N-gram Jaccard join by multiple-global-order filtering.

Documents are sets of distinct word 5-grams (A-Z lower-cased); two link when
100 * intersection >= 75 * union. The result is exact.

1. One pass gives (doc_id, set id, set size); documents with equal sets are
   one class from here on.
2. A set needs ceil(0.75 n) of its shingles in common with a partner, so at
   least as many of its shingles must occur in other sets at all (in every
   order that puts unique shingles first, its prefix must reach a shared
   one). Shingles are packed into blobs per block of documents and hash
   bucket, buckets answer with the number of shared shingles per document,
   and only sets that reach the bound go on.
3. The sets left are ranked under three global orders of shingles (by
   frequency, by frequency class and one hash, by another class and hash).
   A pair must share a prefix shingle under each of them. The stars of the
   first order's prefixes give candidate groups; no link leaves its group.
4. Groups are dealt out in blocks of about ``BLOCK`` sets and ``BLOCK_SHINGLES``
   shingles at most, every two blocks of a group (and each with itself) meet in one task. There the prefix
   filters of all orders are intersected first, and the pairs that pass are
   verified by counting common shingles. A task returns one star per
   component and link counts per set, never the pairs.

No cap on partners or candidates; a group of any size is split evenly.

Edge cases: null or blank texts have no shingles and link with nothing; with
fewer than five words the whole sequence is the one shingle; repeated rows
and copies are one class (linked with each other when not blank).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from .common import SPACE, id_text, keep_chosen, release, released, small, text_key, utf8
from .components import components

#: Words of a shingle; links need PART/100 of the union.
WORDS, PART = 5, 75
#: Bytes of text hashed at once.
HASH_BYTES = 1 << 20
#: Bytes of text per block of step 2, shingles per bucket, sets and shingles per block of step 4.
BLOCK_BYTES, BUCKET_SHINGLES, BLOCK, BLOCK_SHINGLES = 2 << 20, 2_000_000, 512, 300_000
#: Bits of the broadcast filter that spares sets without partners the way (false positives do no harm).
FILTER_BITS = 1 << 24

_BLANK = np.zeros(256, bool)
_BLANK[list(SPACE)] = True
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_STEP = 0xE7037ED1A0B428DB  # odd: has an inverse modulo 2^64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.append(np.uint64(1), np.cumprod(np.full(n, s, np.uint64))) for s in (_STEP, pow(_STEP, -1, 1 << 64)))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    out: list[np.ndarray] = []
    a = 0
    while a < len(texts):
        z, size = a, 0
        while z < len(texts) and size < HASH_BYTES:
            size += len(texts[z]) + 1
            z += 1
        out += _sets(texts[a:z])
        a = z
    return out


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    n = len(raw)
    there = ~_BLANK[raw]
    edge = np.diff(there.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(max(2 * HASH_BYTES, n))  # kept for all but giant texts
    total = np.append(np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n]))
    word = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD[4])
    parts = [_mix(word + _ODD[j]) * _ODD[j] for j in range(WORDS)]
    m = len(word) - WORDS + 1
    shingle = sum((parts[j][j:j + m] for j in range(1, WORDS)), parts[0][:m].copy()) if m > 0 else word[:0]
    shingle = _mix(shingle)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, ends)
    out, first = [], 0
    for last in upto.tolist():
        k = last - first
        if k >= WORDS:
            out.append(np.unique(shingle[first:last - WORDS + 1]))
        elif k:  # the whole sequence
            out.append(_mix(sum((parts[j][first + j:first + j + 1] for j in range(k)), np.array([k], np.uint64) * _ODD[4])))
        else:
            out.append(word[:0])
        first = last
    return out


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)) - (1 << 63)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        sets = shingle_sets(utf8(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "text_key", "id", "n"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Blocks of (set id, shingles), each set once per task."""
    seen: set[int] = set()
    block, size = [], 0
    for b in small(batches):
        texts = utf8(b.column("text"))
        for k, s in enumerate(shingle_sets(texts)):
            i = set_id(s)
            if len(s) and i not in seen:
                seen.add(i)
                block.append((i, s))
                size += len(texts[k])
            if size >= BLOCK_BYTES:
                yield block
                block, size = [], 0
    if block:
        yield block


def _bucket_rows(buckets: int):
    """Text batches -> (bucket, block, packed): a block's shingles that fall
    into the bucket, four bytes each, behind the sets that have some and their
    number (a false meeting only lets a set pass this step). Bucket -1 carries
    the block's set ids and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for sets in _distinct(batches):
            sizes = np.array([len(s) for _, s in sets], np.int64)
            every = np.concatenate([s for _, s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            bucket = ((every >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            low = every[order].astype(np.uint32)
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(-1, np.array([i for i, _ in sets], np.int64).tobytes() + sizes.tobytes())]
            for k in range(buckets):
                a, z = int(cuts[k]), int(cuts[k + 1])
                if z > a:
                    present, per = np.unique(owner[order[a:z]], return_counts=True)
                    rows.append((k, np.concatenate([[len(present)], present, per, low[a:z]]).astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()),
                                              pa.array([len(sets)] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "block", "sets", "packed"])
            block += 1

    return run


def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All packed rows of a bucket (sorted by bucket) -> per block, the sets
    with shingles that occur in more than one set, and how many."""

    def answer(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        whole = [np.frombuffer(p, np.uint32) for *_, p in rows]
        present, per, codes = ([w[1 + k * int(w[0]):(1 + (k + 1) * int(w[0])) if k < 2 else None] for w in whole] for k in range(3))
        every = np.concatenate(codes)
        order = np.argsort(every)
        ranked = every[order]
        same = ranked[1:] == ranked[:-1]
        shared = np.zeros(len(every), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        out, at = [], 0
        for c, own, p in zip(codes, present, per):
            hits = np.bincount(np.repeat(np.arange(len(own)), p)[shared[at:at + len(c)]], minlength=len(own)).astype(np.uint32)
            out.append(np.concatenate([own[hits > 0], hits[hits > 0]]).tobytes())
            at += len(c)
        return pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
                                           pa.array([r[1] for r in rows], pa.int32()), pa.array(out, pa.binary())], ["bucket", "block", "sets", "packed"])

    held: list[tuple[int, int, bytes]] = []
    current = None
    for b in batches:
        for bucket, block, m, packed in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "sets", "packed"))):
            if bucket != current and held:
                yield answer(held)
                held = []
            current = bucket
            held.append((block, m, packed))
    if held:
        yield answer(held)


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header and answers of every block (sorted by block) -> set ids that
    have enough shared shingles."""

    def pick(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        m = rows[0][1]
        head = next(p for k, _, p in rows if k < 0)
        ids, n = np.frombuffer(head[:8 * m], np.int64), np.frombuffer(head[8 * m:], np.int64)
        shared = np.zeros(m, np.int64)
        for own in (np.frombuffer(p, np.uint32).reshape(2, -1) for k, _, p in rows if k >= 0):
            shared[own[0]] += own[1]
        return pa.RecordBatch.from_arrays([pa.array(ids[shared >= -(-PART * n // 100)], pa.int64())], ["id"])

    held: list[tuple[int, int, bytes]] = []
    current = None
    for b in batches:
        for bucket, block, m, packed in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "sets", "packed"))):
            if block != current and held:
                yield pick(held)
                held = []
            current = block
            held.append((bucket, m, packed))
    if held:
        yield pick(held)


def id_filter(ids: DataFrame) -> np.ndarray:
    """Packed bitmap over set ids (FILTER_BITS bits, whatever the input)."""
    bits = ids.select((F.pmod("id", F.lit(FILTER_BITS)) + 1).alias("bit"))  # bitmaps count from 1
    maps = bits.groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps.collect():
        own = np.frombuffer(bytes(r["map"]), np.uint8)
        out[(r["at"] - 1) * len(own):r["at"] * len(own)] = own
    return out


def _set_rows(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(wanted.value, bitorder="little")
        for sets in _distinct(batches):
            own = [(i, s) for i, s in sets if bitmap[i % FILTER_BITS]]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([len(s) for _, s in own], pa.int64()), pa.array([s.tobytes() for _, s in own], pa.binary())], ["id", "n", "shingles"])

    return run


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, s in zip(b.column("id").to_pylist(), b.column("shingles").to_pylist()):
            own = np.frombuffer(s, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i), pa.int64()), pa.array(own, pa.int64())], ["id", "token"])


def order_keys(token: np.ndarray, df: np.ndarray) -> list[np.ndarray]:
    """Places in the global orders to sort by: shingles by frequency; by
    frequency class and a hash; by a coarser class and another hash."""
    t = token.view(np.uint64)
    wide = lambda c, h: (c.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    return [wide(np.minimum(df, 0xFFFF), _mix(t ^ _ODD[0])), wide(np.log2(df).astype(np.int64) * 2, _mix(t ^ _ODD[1])), wide(np.log2(df).astype(np.int64) // 2, _mix(t ^ _ODD[2]))]


def prefix_length(n: int) -> int:
    """Of any two linked sets, the first n - ceil(0.75 n) + 1 shingles share one."""
    return n - -(-PART * n // 100) + 1


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, shared: list of df and token) -> the prefixes under every order,
    without the unique shingles they begin with; sets below the bound go."""
    for b in small(batches):
        ids, ns, prefixes = [], [], ([], [], [])
        for i, n, shared in zip(*(b.column(c).to_pylist() for c in ("id", "n", "shared"))):
            k = prefix_length(n) - (n - len(shared))
            if k <= 0:
                continue
            token = np.array([s["token"] for s in shared], np.int64)
            df = np.array([s["df"] for s in shared], np.int64)
            ids.append(i)
            ns.append(n)
            for out, key in zip(prefixes, order_keys(token, df)):
                out.append(token[np.argsort(key, kind="stable")[:k]].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *[pa.array(p, pa.list_(pa.int64())) for p in prefixes]], ["id", "n", "p0", "p1", "p2"])


def _lists(prefixes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Inverted lists: owners sorted by token, list starts, and every set's tokens as numbers."""
    sizes = [len(p) for p in prefixes]
    every = np.concatenate(prefixes)
    _, number = np.unique(every, return_inverse=True)
    owners = np.repeat(np.arange(len(prefixes)), sizes)[np.argsort(number, kind="stable")]
    starts = np.append(0, np.cumsum(np.bincount(number)))
    return owners, starts, np.split(number, np.cumsum(sizes)[:-1])


def link(sets: list[np.ndarray], prefixes: list[list[np.ndarray]], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, linked j > i) among the given sets with i in one block and j in the
    other (left, right: masks): prefix filters of all orders intersected, then
    common shingles counted."""
    n = np.array([len(s) for s in sets])
    filters = [_lists(p) for p in prefixes]
    owners, starts, numbers = _lists(sets)
    m = len(sets)
    for i in range(m):
        fits = np.zeros(m, bool)
        fits[i + 1:] = (right[i + 1:] if left[i] else False) | (left[i + 1:] if right[i] else False)
        fits &= (100 * n >= PART * n[i]) & (100 * n[i] >= PART * n)
        for own, begin, number in filters:
            if not fits.any():
                break
            seen = np.zeros(m, bool)
            for t in number[i].tolist():
                seen[own[begin[t]:begin[t + 1]]] = True
            fits &= seen
        if not fits.any():
            continue
        common = np.zeros(m, np.int64)
        for t in numbers[i].tolist():
            common[owners[starts[t]:starts[t + 1]]] += 1
        got = np.flatnonzero(fits & (100 * common >= PART * (n + n[i] - common)))
        if len(got):
            yield i, got


def _group_links(group: pa.Table) -> pa.Table:
    """Two blocks of a candidate group -> (id, root) stars and link counts."""
    a, b = group.column("first")[0].as_py(), group.column("second")[0].as_py()
    order = np.argsort(group.column("id").to_numpy())
    group = group.take(pa.array(order))
    ids, weight, block = (group.column(c).to_numpy() for c in ("id", "copies", "block"))
    sets = [np.frombuffer(s, np.int64) for s in group.column("shingles").to_pylist()]
    prefixes = [[np.array(p, np.int64) for p in group.column(c).to_pylist()] for c in ("p0", "p1", "p2")]
    left, right = block == a, block == b
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = np.zeros(len(ids), np.int64)
    for i, js in link(sets, prefixes, left, right):
        links[i] += weight[js].sum()
        links[js] += weight[i]
        for j in js.tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    hit = np.flatnonzero(links)
    if sum(map(len, sets)) >= BLOCK_SHINGLES:
        release()
    return pa.table({"id": pa.array(ids[hit], pa.int64()), "root": pa.array([int(ids[root(k)]) for k in hit.tolist()], pa.int64()), "links": pa.array(links[hit], pa.int64())})


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links),
    n_links (documents linked with this one, copies included) and text_key
    per row."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    members = cut_lineage(rows.withColumn("text_key", text_key("text")).mapInArrow(released(_ids), "doc_id long, text_key long, id long, n long"))
    shingles = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    copies = cut_lineage(members.where("n > 0").groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")))
    buckets = max(1, -(-shingles // BUCKET_SHINGLES))
    schema = "bucket int, block long, sets int, packed binary"
    texts = rows.select("text")
    packed = texts.mapInArrow(released(_bucket_rows(buckets)), schema)
    dealt = packed.repartition(F.when(F.col("bucket") < 0, F.col("block")).otherwise(F.col("bucket")), F.col("bucket") < 0).sortWithinPartitions("bucket", "block")
    counts = dealt.mapInArrow(released(_pass_headers), schema)
    reaching = counts.repartition("block").sortWithinPartitions("block").mapInArrow(released(_reaching), "id long").distinct()
    wanted = spark.sparkContext.broadcast(id_filter(reaching))
    sets = cut_lineage(texts.mapInArrow(released(_set_rows(wanted)), "id long, n long, shingles binary").groupBy("id").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")))
    tokens = sets.select("id", "shingles").mapInArrow(released(_token_rows), "id long, token long")
    often = cut_lineage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = tokens.join(often, "token").groupBy("id").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    prefixes = cut_lineage(shared.join(sets.select("id", "n"), "id").select("id", "n", "shared").mapInArrow(
        released(_prefix_rows), "id long, n long, p0 array<long>, p1 array<long>, p2 array<long>"))
    # candidate groups: the stars of the first order's prefixes
    first = prefixes.select("id", F.explode("p0").alias("token"))
    centre = cut_lineage(first.groupBy("token").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    edges = first.join(centre, "token").where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    groups = cut_lineage(components(edges))
    weights = groups.join(prefixes.select(F.col("id").alias("node"), "n"), "node").groupBy("label")
    sizes = cut_lineage(weights.agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    placed = groups.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block i meets every block: pairs (i, j) and (j, i) with i <= j
    met = placed.select(F.col("node").alias("id"), "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("id", "label", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    full = sets.select("id", "shingles").join(prefixes.drop("n"), "id").join(copies.select("id", "copies"), "id")
    tasks = met.join(full, "id").groupBy("label", "first", "second")
    stars = cut_lineage(tasks.applyInArrow(_group_links, "id long, root long, links long"))
    labels = components(stars.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = stars.groupBy("id").agg(F.sum("links").alias("links"))
    classes = copies.join(labels.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left").withColumn("label", F.coalesce("label", "id"))
    classes = cut_lineage(classes)
    least = cut_lineage(classes.groupBy("label").agg(F.min("least").alias("component_id")))
    named = cut_lineage(classes.join(least, "label").select("id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    blank = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "text_key")
    return members.where("n > 0").join(named, "id").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", "text_key").unionByName(blank)


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one document of each group: the one
    of the smallest doc_id stays; documents without shingles all stay."""
    found = jaccard_join(docs, id_col, text_col)
    linked = cut_lineage(found.where("n_links > 0"))
    best = linked.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
    decided = linked.join(best, "component_id").select("doc_id", "text_key", (F.struct("doc_id", "text_key") == F.col("best")).alias("kept"))
    return keep_chosen(docs, decided, id_col, text_col)


def _pass_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers of blocks pass; buckets are answered."""

    def rest() -> Iterator[pa.RecordBatch]:
        for b in batches:
            head = b.filter(pc.less(b.column("bucket"), 0))
            if head.num_rows:
                heads.append(head)
            body = b.filter(pc.greater_equal(b.column("bucket"), 0))
            if body.num_rows:
                yield body

    heads: list[pa.RecordBatch] = []
    for answer in _shared_counts(rest()):
        yield from heads
        heads.clear()
        yield answer
    yield from heads


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("text_key")
