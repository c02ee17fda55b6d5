"""Ranked lexical search over bit-sliced Bloom signatures.

``index`` writes, in one pass over the documents, blocks of up to 1,024
documents of a similar number of terms. A document's signature is a Bloom
filter of its terms, of a width that fits their number, and of (term, level)
keys for every level of occurrences that the term reaches; a block stores the
signatures turned round, one bitmap over its documents for each bit position (a
*slice*). The same pass adds up exactly how many documents hold each term that
the items may ask for.

``search`` ANDs the slices of a term's keys into bitmaps of documents that may
hold it that often. They overestimate, never underestimate: so the weighted sum
of the largest contributions they allow is an upper bound of a document's score.
For every item

1. the documents of the 80 highest bounds are scored exactly, from their whole
   texts; the tenth best of these scores is a floor of the result;
2. every document whose bound reaches the floor is scored exactly. All others
   are provably not among the best. Of documents of one text, all but the ten
   smallest ids are provably out as well (they score alike).

Terms are the maximal runs of ASCII letters and digits and of all characters
beyond ASCII; A-Z are lower-cased. Scores are whole numbers (64 bit).

At scale: a document's text is read three times (index, floor, result) and
moves only for exact scoring; blocks are about a sixth of the text. Items pass
as stated query sets in blocks of bounded size; every task keeps at most 80
rows an item for the floor. Candidates are broadcast to the scan of the texts
while they are few (``BROADCAST_PAIRS``); beyond that both sides are shuffled.

Edge cases: null or empty text and items without terms have no rows in the
result. Repeated documents and items are rows of their own; ids that are null
sort last. Very long texts get a wide signature in a block of eight documents.
An empty table of documents or items gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path, table
from .common import id_text, text_key, utf8

#: Constants of the score.
SATURATION, LENGTH_SHARE, SCALE = 8, 75, 1_000_000_000
BEST = 10
#: Documents of the highest bounds that are scored for an item's floor, for each
#: one asked for: rare terms raise some bounds by false positives.
PROBED = 8
#: Occurrences from which a term has another key; the last level is open.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, 4096, 16384, 65536, 1 << 20], np.int64)
#: Bits of a signature for each key at least, probes of a key.
BITS_PER_KEY, PROBES = 10, 3
#: Documents in a block at most, and bits of a block unless eight documents need more.
ROWS, BLOCK_BITS = 1024, 1 << 23
#: Bits of the map of terms that items may ask for (others only cost work).
ASKED_BITS = 1 << 24
#: Counted terms that a task holds before it passes them on.
COUNTED = 200_000
#: Terms of a block of items (one item at least), items of a block, and terms
#: times documents that are summed up at once.
BLOCK_TERMS, BLOCK_ITEMS, AT_ONCE = 200_000, 1024, 1 << 22
#: Pairs of item and document up to which candidates are broadcast.
BROADCAST_PAIRS = 200_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text given as UTF-8."""
    return raw.translate(_FOLD).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _probes(hashes: np.ndarray, level: np.ndarray | int, width: int) -> np.ndarray:
    """Bit positions (keys x PROBES) of (term, level) keys."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(width - 1)).astype(np.int64)


class _Block:
    """Signatures of documents of one width, filled document by document."""

    def __init__(self, width: int):
        self.width = width
        self.room = min(ROWS, max(8, BLOCK_BITS // width))
        self.slices = np.zeros((width, self.room // 8), np.uint8)
        self.rows: list[tuple] = []

    def add(self, row: tuple, positions: np.ndarray) -> bool:
        k = len(self.rows)
        self.slices[positions, k >> 3] |= np.uint8(1 << (k & 7))
        self.rows.append(row)
        return len(self.rows) == self.room

    def batch(self) -> pa.RecordBatch:
        ids, keys, digests, sizes = zip(*self.rows)
        used = np.ascontiguousarray(self.slices[:, :-(-len(ids) // 8)])
        lists = [pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(keys)], pa.list_(pa.int64())), pa.array([list(sizes)], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([self.width], pa.int64()), lists[0], lists[1], pa.array([b"".join(digests)], pa.binary()), lists[2], pa.array([used.tobytes()], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.int64())], _INDEX_NAMES)


_INDEX = "width long, ids array<long>, text_keys array<long>, digests binary, sizes array<long>, slices binary, term binary, df long"
_INDEX_NAMES = [c.split(" ")[0] for c in _INDEX.split(", ")]


def _counts(df: Counter) -> pa.RecordBatch:
    none = [pa.nulls(len(df), t) for t in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.binary())]
    return pa.RecordBatch.from_arrays([*none, pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], _INDEX_NAMES)


def index(docs: DataFrame, path: str, asked: Broadcast | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the signatures of every document with a term, and the number of
    documents of each term (``asked``: only of terms in this map)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if asked is None else asked.value
        open_blocks: dict[int, _Block] = {}
        df: Counter = Counter()
        for b in batches:
            for doc_id, key, raw in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), utf8(b.column("text"))):
                words = terms(raw)
                if not words:
                    continue
                count = Counter(words)
                own = list(count)
                hashes = _hashes(own)
                if wanted is None:
                    df.update(own)
                else:
                    at = hashes & np.uint64(ASKED_BITS - 1)
                    hit = (wanted[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                    df.update([own[k] for k in np.flatnonzero(hit)])
                reached = np.searchsorted(LEVELS, np.fromiter(count.values(), np.int64, len(own)), side="right")
                first = np.repeat(np.cumsum(reached) - reached, reached)
                level = np.arange(len(first)) - first
                width = 64
                while width < BITS_PER_KEY * len(level):
                    width *= 2
                if width not in open_blocks:
                    open_blocks[width] = _Block(width)
                full = open_blocks[width].add((doc_id, key, hashlib.blake2b(raw, digest_size=16).digest(), len(words)), _probes(np.repeat(hashes, reached), level, width).ravel())
                if full:
                    yield open_blocks.pop(width).batch()
                if len(df) >= COUNTED:
                    yield _counts(df)
                    df = Counter()
        for block in open_blocks.values():
            yield block.batch()
        if df:
            yield _counts(df)

    id_text(docs, id_col, text_col).withColumn("text_key", text_key()).mapInArrow(run, _INDEX).write.parquet(path)


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number for every row), item_id, term, times, bit (its place in
    the map of asked terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, item_id, raw in zip(b.column("item").to_pylist(), b.column("item_id").to_pylist(), utf8(b.column("text"))):
                count = Counter(terms(raw))
                own, n = list(count), len(count)
                if n:
                    bits = (_hashes(own) & np.uint64(ASKED_BITS - 1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array([item_id] * n, pa.int64()), pa.array(own, pa.binary()), pa.array(list(count.values()), pa.int64()), pa.array(bits)], ["item", "item_id", "term", "times", "bit"])

    own = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return cut_lineage(own.withColumn("item", F.monotonically_increasing_id()).mapInArrow(run, "item long, item_id long, term binary, times long, bit long"))


def _asked(item_terms: DataFrame) -> np.ndarray:
    """Packed map of the terms that items hold (ASKED_BITS bits, whatever the input)."""
    bits = item_terms.select((F.col("bit") + 1).alias("bit"))  # bitmaps count from 1
    maps = bits.groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    out = np.zeros(ASKED_BITS // 8, np.uint8)
    for r in maps.collect():
        part = np.frombuffer(bytes(r["map"]), np.uint8)
        out[(r["at"] - 1) * len(part):r["at"] * len(part)] = part
    return out


class _Query:
    """A block of items: their numbers and, by item, terms with weights."""

    def __init__(self, rows: list, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.items = np.array(sorted({r["item"] for r in rows}), np.int64)
        place = {k: j for j, k in enumerate(self.items.tolist())}
        self.item = np.array([place[r["item"]] for r in rows], np.int64)  # rows come by item
        self.words, self.term = [], []
        seen: dict[bytes, int] = {}
        for r in rows:
            word = bytes(r["term"])
            if word not in seen:
                seen[word] = len(self.words)
                self.words.append(word)
            self.term.append(seen[word])
        self.term = np.array(self.term, np.int64)
        self.weight = np.array([r["times"] * r["weight"] for r in rows], np.int64)
        self.hashes = _hashes(self.words)
        self.floors = np.ones(len(self.items), np.int64)

    def damping(self, sizes: np.ndarray) -> np.ndarray:
        """m of documents of so many terms."""
        return 100 - LENGTH_SHARE + LENGTH_SHARE * sizes * self.n_docs // self.n_terms

    def bounds(self, width: int, sizes: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """Upper bounds of scores (items x documents of a block)."""
        n = len(sizes)
        slices = slices.reshape(width, -1)
        m = self.damping(sizes)
        # largest contribution at k levels reached: below the next level, and never above the document's terms
        most = np.minimum(np.append(LEVELS[1:] - 1, 1 << 62)[:, None], sizes[None, :])
        largest = np.concatenate([np.zeros((1, n), np.int64), SCALE * most // (1000 * most + SATURATION * m)])
        out = np.zeros((len(self.items), n), np.int64)
        step = max(1, AT_ONCE // n)
        for a in range(0, len(self.term), step):
            used, back = np.unique(self.term[a:a + step], return_inverse=True)
            level = np.zeros((len(used), n), np.int8)
            alive = np.arange(len(used))
            held = np.full((len(used), slices.shape[1]), 255, np.uint8)
            for k in range(len(LEVELS)):
                at = _probes(self.hashes[used[alive]], k, width)
                held = held & np.bitwise_and.reduce(slices[at], axis=1)
                some = held.any(axis=1)
                alive, held = alive[some], held[some]
                if not len(alive):
                    break
                level[alive] += np.unpackbits(held, axis=1, count=n, bitorder="little").view(np.int8)
            each = np.take_along_axis(largest, level.astype(np.int64), axis=0)
            part = each[back] * self.weight[a:a + step, None]
            items, starts = np.unique(self.item[a:a + step], return_index=True)
            out[items] += np.add.reduceat(part, starts, axis=0)
        return out


def _copies_out(ids: list, digests: np.ndarray) -> np.ndarray:
    """Which rows of a block can be among the best: of one text the BEST smallest ids."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    seen: Counter = Counter()
    stay = np.ones(len(ids), bool)
    for k in order:
        d = digests[k].tobytes()
        stay[k] = seen[d] < BEST
        seen[d] += 1
    return stay


def _candidates(blocks: DataFrame, query: Broadcast, best: int | None) -> DataFrame:
    """item, doc_id, text_key, digest, bound: of every item the ``best``
    highest bounds of each task, or (None) all that reach the item's floor."""
    names = ["item", "doc_id", "text_key", "digest", "bound"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Query = query.value
        top: list[list[tuple]] = [[] for _ in own.items]
        least = own.floors.copy()
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in ("ids", "text_keys", "sizes", "width", "digests", "slices")}
                ids, keys, sizes = row["ids"].as_py(), row["text_keys"].as_py(), np.array(row["sizes"].as_py(), np.int64)
                digests = np.frombuffer(row["digests"].as_py(), np.uint8).reshape(-1, 16)
                bounds = own.bounds(row["width"].as_py(), sizes, np.frombuffer(row["slices"].as_py(), np.uint8))
                bounds[:, ~_copies_out(ids, digests)] = 0
                if best is None:
                    item, doc = np.nonzero(bounds >= own.floors[:, None])
                    if len(item):
                        doc_list = doc.tolist()
                        yield pa.RecordBatch.from_arrays([pa.array(own.items[item]), pa.array([ids[k] for k in doc_list], pa.int64()), pa.array([keys[k] for k in doc_list], pa.int64()), pa.array([digests[k].tobytes() for k in doc_list], pa.binary()), pa.array(bounds[item, doc])], names)
                    continue
                for j in np.flatnonzero((bounds >= least[:, None]).any(axis=1)).tolist():
                    mine = bounds[j]
                    picked = np.argpartition(-mine, best - 1)[:best] if len(mine) > best else np.arange(len(mine))
                    top[j] += [(int(mine[k]), ids[k], keys[k], digests[k].tobytes()) for k in picked.tolist() if mine[k] >= least[j]]
                    if len(top[j]) >= best:
                        top[j] = sorted(top[j], key=lambda t: -t[0])[:best]
                        least[j] = max(least[j], top[j][-1][0])
        if best is not None:
            for j, found in enumerate(top):
                if found:
                    bound, ids, keys, digests = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([int(own.items[j])] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(bound, pa.int64())], names)

    schema = "item long, doc_id long, text_key long, digest binary, bound long"
    return blocks.select("ids", "text_keys", "sizes", "width", "digests", "slices").mapInArrow(run, schema)


def _rescore(docs: DataFrame, pairs: DataFrame, query: Broadcast) -> DataFrame:
    """item, doc_id, score: exact scores of the pairs (item, doc_id, text_key),
    from the documents' whole texts."""
    few = pairs.count() <= BROADCAST_PAIRS
    by_doc = pairs.groupBy(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key")).agg(F.collect_set("item").alias("items"))  # a block's items at most
    side = F.broadcast(by_doc) if few else by_doc
    hits = docs.join(side, docs["doc_id"].eqNullSafe(side["c_id"]) & docs["text_key"].eqNullSafe(side["c_key"])).select("doc_id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Query = query.value
        place = {k: j for j, k in enumerate(own.items.tolist())}
        starts = np.searchsorted(own.item, np.arange(len(own.items) + 1)).tolist()
        for b in batches:
            out = []
            for doc_id, raw, items in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), b.column("items").to_pylist()):
                words = terms(raw)
                count = Counter(words)
                m = 100 - LENGTH_SHARE + LENGTH_SHARE * len(words) * own.n_docs // own.n_terms
                for item in items:
                    a, z = starts[place[item]], starts[place[item] + 1]
                    score = 0
                    for t, w in zip(own.term[a:z].tolist(), own.weight[a:z].tolist()):
                        if tf := count.get(own.words[t]):
                            score += w * (SCALE * tf // (1000 * tf + SATURATION * m))
                    out.append((item, doc_id, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["item", "doc_id", "score"])

    return hits.mapInArrow(run, "item long, doc_id long, score long")


def _item_blocks(weighted: DataFrame) -> Iterator[list]:
    """The items' terms by item, in blocks of bounded size (whole items)."""
    block: list = []
    mine: list = []
    items = 0

    def own(rows):
        last = None
        for r in rows:
            if r["item"] != last and last is not None:
                yield False
            last = r["item"]
            yield r

    for r in own(weighted.orderBy("item", "term").toLocalIterator()):
        if r is not False:
            mine.append(r)
            continue
        if block and (len(block) + len(mine) > BLOCK_TERMS or items == BLOCK_ITEMS):
            yield block
            block, items = [], 0
        block, mine, items = block + mine, [], items + 1
    if block and (len(block) + len(mine) > BLOCK_TERMS or items == BLOCK_ITEMS):
        yield block
        block = []
    if block or mine:
        yield block + mine


_RESULT = "item_id long, rank int, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every item."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    asked_terms = _item_terms(items, item_id_col, item_text_col)
    asked = sc.broadcast(_asked(asked_terms))
    path = scratch_path(spark, "signatures")
    index(docs, path, asked, id_col, text_col)
    stored = spark.read.schema(_INDEX).parquet(path)
    blocks = stored.where(F.col("width").isNotNull())
    sums = blocks.agg(F.sum(F.size("sizes")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    n_docs, n_terms = sums["n"] or 0, sums["l"] or 0
    if not n_docs:
        return spark.createDataFrame([], _RESULT)
    df = stored.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = cut_lineage(asked_terms.join(df, "term").withColumn("weight", weight).where("weight > 0"))
    numbers = asked_terms.select("item", "item_id").distinct()
    own = id_text(docs, id_col, text_col).withColumn("text_key", text_key())
    found = []
    for rows in _item_blocks(weighted):
        query = _Query(rows, n_docs, n_terms)
        first = sc.broadcast(query)
        by_bound = Window.partitionBy("item").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_last())
        probe = cut_lineage(_candidates(blocks, first, PROBED * best).withColumn("k", F.row_number().over(by_bound)).where(F.col("k") <= PROBED * best))
        by_score = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        floors = (_rescore(own, probe, first).withColumn("k", F.row_number().over(by_score))
                  .where((F.col("k") == best) & (F.col("score") > 0)).select("item", "score").collect())  # a row an item of the block
        place = {k: j for j, k in enumerate(query.items.tolist())}
        for r in floors:
            query.floors[place[r["item"]]] = r["score"]
        second = sc.broadcast(query)
        by_text = Window.partitionBy("item", "digest").orderBy(F.col("doc_id").asc_nulls_last())
        pairs = cut_lineage(_candidates(blocks, second, None).withColumn("k", F.row_number().over(by_text)).where(F.col("k") <= best).select("item", "doc_id", "text_key"))
        scored = _rescore(own, pairs, second).where("score > 0").withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= best)
        found.append(cut_lineage(scored.join(numbers, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")))
        first.unpersist()
        second.unpersist()
    asked.unpersist()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _RESULT)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM
        (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
m AS (SELECT rid, doc_id, 100 - 75 + (75 * len(ts) * n_docs) // n_terms AS m FROM d, s WHERE len(ts) > 0),
scored AS (SELECT item_id, rid, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY item_id, rid, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10"""
