"""Packing documents into sequences of a fixed capacity (harmonic packing).

A document is its token ids and one end id. Whole sequences are cut off its
front; what is left over goes into *reciprocal-capacity classes*: class k
takes pieces of more than capacity/(k+1) and at most capacity/k ids, and each
of its sequences (bins) holds exactly k pieces, whatever their lengths, so a
bin is filled without looking at any other class or worker.

Plain harmonic packing leaves about a sixth of each bin empty, because a
length lies anywhere in its class. As documents may be cut, a piece may also
be cut off at exactly ``capacity // k``; ``recipe`` chooses, for every length
left over, between placing it whole and cutting it again, counting the room it
leaves empty and ``cut_cost`` ids for every cut (0: powers of two only and no
padding; infinite: plain harmonic packing; 8: about 0.1 % of padding and two
or three pieces a document).

Three steps, of which only the first sees texts:

1. every task encodes its documents and fills bins by itself. Bins that are
   full are final; fewer than k pieces of each class are left (with their ids),
   at most ~100 capacities of ids a task, however many documents it had;
2. what tasks left is numbered within its class (``sequence_number``: no class
   goes to one task) and dealt k by k;
3. fewer than k pieces of each class are left of the whole table, so at most
   10,000 pieces and ~100 capacities of ids, whatever the input: they are laid
   end to end and cut at the capacity; the last part is cut at powers of two,
   which need no padding.

Edge cases: null text is the empty text, a document of the end id alone;
special-token strings are ordinary text; very long texts are encoded in parts
(at places where the pattern never matches across) and cut as any other;
repeated rows are documents of their own; a null doc_id stays null; an empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.metrics import sequence_number
from ..session import cut_lineage, table
from .common import id_text, resident, strings, text_key

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 1
CUT_COST = 8.0
#: Chunks in each of the two remembered generations of a Python worker, the
#: longest chunk remembered, and how many chunks are taken from a text at once.
CACHE_CHUNKS = 300_000
CACHE_LENGTH = 64
CHUNKS_AT_ONCE = 200_000
#: Characters of texts encoded together.
GROUP_CHARS = 4_000_000

#: Unicode white space, as the pattern's \s has it; letters of Latin alphabets; ASCII punctuation.
_WS = "\t-\r \x85\xa0  -     　"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
_PUNCT = r"!-/:-@\[-`{-~"
#: Cuts a text only between two matches of the tokenizer's pattern: before
#: white space and between a Latin letter and ASCII punctuation.
_CHUNK = re.compile(rf" ?[{_LETTERS}]+(?=[{_PUNCT}{_WS}]|\Z)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Text to ids as little-endian 32-bit bytes, one per worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: ids of chunks used lately, and of those of the turn before
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        coded = self.tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        raw = np.array(coded.ids, "<u4").tobytes()
        ends = (np.bincount(np.array(coded.word_ids, np.int64), minlength=len(chunks)).cumsum() * 4).tolist()
        return {c: raw[a:b] for c, a, b in zip(chunks, [0, *ends], ends)}

    def _code(self, cut: list[list[str]]) -> list[bytes]:
        known = self.young
        missing = set().union(*cut).difference(known)
        known.update((c, self.old[c]) for c in missing.intersection(self.old))
        missing.difference_update(known)
        known.update(self._learn(list(missing)) if missing else {})
        coded = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        for c in missing:
            if len(c) > CACHE_LENGTH:
                del known[c]
        if len(known) > CACHE_CHUNKS:
            self.old, self.young = known, {}
        return coded

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of every whole text; long texts by groups of chunks."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for t in texts:
            if len(t) > GROUP_CHARS:
                out += self._code([_CHUNK.findall(g) for g in group])
                found = (m.group() for m in _CHUNK.finditer(t))
                parts = bytearray()
                while some := list(islice(found, CHUNKS_AT_ONCE)):
                    parts += self._code([some])[0]
                out.append(bytes(parts))
                group, size = [], 0
                continue
            group.append(t)
            size += len(t)
            if size >= GROUP_CHARS:
                out += self._code([_CHUNK.findall(g) for g in group])
                group, size = [], 0
        return out + (self._code([_CHUNK.findall(g) for g in group]) if group else [])


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return resident(("encoder", path), lambda: Encoder(path))


@lru_cache(maxsize=4)
def recipe(capacity: int, cut_cost: float) -> tuple[int, ...]:
    """For every length below the capacity, the length of the piece taken off
    it first: the length itself (placed whole in its class) or a reciprocal
    ``capacity // k``. Least room left empty plus cut_cost for each cut."""
    sizes = sorted({capacity // k for k in range(1, capacity + 1)})
    room = lambda n: capacity / (capacity // n) - n  # noqa: E731  empty room of a piece's share of its bin
    cost, first = [0.0] * capacity, [0] * capacity
    for n in range(1, capacity):
        cost[n], first[n] = min([(room(n), n), *((room(s) + cut_cost + cost[n - s], s) for s in sizes if s < n)], key=lambda x: (x[0], -x[1]))
    return tuple(first)


def pieces_of(n: int, capacity: int, first: tuple[int, ...]) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        out.append(first[n])
        n -= first[n]
    return out


_PLACED = "doc_id long, text_key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LOCAL = _PLACED + ", kind int, at long, ids binary"
#: Bits of a sequence id below the number of the task (step 1) or class (steps 2 and 3).
_LOW = 40


def _fill(path: str, capacity: int, end_id: int, cut_cost: float):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = encoder(path), recipe(capacity, cut_cost)
        task = TaskContext.get().partitionId() << _LOW
        bins, place = 0, 0
        waiting: dict[int, list[tuple]] = {}
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("kind", pa.int32()), ("at", pa.int64()), ("ids", pa.binary())])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            texts, keys, names = strings(b.column("text")), b.column("text_key").to_pylist(), b.column("doc_id").to_pylist()
            a = 0
            while a < len(texts):
                z, size = a, 0
                while z < len(texts) and size < GROUP_CHARS:
                    size += len(texts[z])
                    z += 1
                out: list[tuple] = []
                for name, key, raw in zip(names[a:z], keys[a:z], own(texts[a:z])):
                    raw += end
                    n, start = len(raw) // 4, 0
                    for length in pieces_of(n, capacity, first):
                        ids = raw[4 * start:4 * (start + length)]
                        k = capacity // length
                        mine = waiting.setdefault(k, [])
                        mine.append((name, key, start, length, zlib.crc32(ids), n, ids))
                        start += length
                        if len(mine) == k:
                            offset = 0
                            for p in mine:
                                out.append((*p[:6], task | bins, offset, k, None, None))
                                offset += p[3]
                            bins += 1
                            waiting[k] = []
                if out:
                    yield batch(out)
                a = z
        left = []
        for k, mine in waiting.items():
            for p in mine:
                left.append((*p[:6], None, None, k, task | place, p[6]))
                place += 1
        if left:
            yield batch(left)

    return run


def _lay(capacity: int, number: int):
    """Step 3: the rows, in order of ``at``, end to end."""
    fields = ["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        total = sum(r["length"] for r in rows)
        # where sequences end: at every capacity, then at powers of two
        ends = list(range(capacity, total + 1, capacity))
        rest, at = total % capacity, total - total % capacity
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                at += 1 << bit
                ends.append(at)
        out, place, k, begun = [], 0, 0, 0
        for r in rows:
            taken = 0
            while taken < r["length"]:
                n = min(r["length"] - taken, ends[k] - place)
                ids = r["ids"][4 * taken:4 * (taken + n)]
                out.append((r["doc_id"], r["text_key"], r["start"] + taken, n, zlib.crc32(ids), r["doc_tokens"], number | k, place - begun))
                taken, place = taken + n, place + n
                if place == ends[k]:
                    begun, k = place, k + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], fields)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
         cut_cost: float = CUT_COST, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, text_key (xxhash64 of the text, tells rows of
    one doc_id apart), start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Sequence ids are unique, not dense."""
    source = id_text(docs, id_col, text_col).withColumn("text_key", text_key())
    local = cut_lineage(source.mapInArrow(_fill(path or vocabulary_path(), capacity, end_id, cut_cost), _LOCAL))
    done = local.where(F.col("sequence_id").isNotNull())

    numbered = sequence_number(local.where(F.col("sequence_id").isNull()), ["kind"], ["at"])
    full = numbered.groupBy("kind").agg((F.floor(F.count(F.lit(1)) / F.col("kind")) * F.col("kind")).alias("full"))  # a row per class
    again = cut_lineage(numbered.join(full, "kind"))
    group = F.floor(F.col("seq") / F.col("kind"))
    before = Window.partitionBy("kind", "group").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # k rows at most
    # class numbers go above those of tasks
    number = F.shiftleft(F.col("kind").cast("long") + F.lit(1 << 21), _LOW)
    dealt = (again.where(F.col("seq") < F.col("full")).drop("ids").withColumn("group", group)
             .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
             .withColumn("sequence_id", number.bitwiseOR(F.col("group"))))

    names = [c.split(" ")[0] for c in _PLACED.split(", ")]
    tail = again.where(F.col("seq") >= F.col("full")).select("doc_id", "text_key", "start", "length", "doc_tokens", "ids", "kind", "seq")
    laid = tail.repartition(1).sortWithinPartitions(F.col("kind"), F.col("seq")).mapInArrow(_lay(capacity, (1 << 21) << _LOW), _PLACED)
    return done.select(names).unionByName(dealt.select(names)).unionByName(laid)


def sequences(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
              path: str | None = None) -> DataFrame:
    """The training rows: sequence_id, ids (array of int, unpadded), from the
    documents and where ``pack`` put their pieces. Texts are encoded again, so
    that packing never stores ids; a sequence groups at most its capacity."""
    path = path or vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array([x + end for x in own(strings(part.column("text")))], pa.binary())], ["d_id", "d_key", "raw"])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array([np.frombuffer(b"".join(p["ids"] for p in x), "<u4").astype(np.int32) for x in b.column("pieces").to_pylist()], pa.list_(pa.int32()))], ["sequence_id", "ids"])

    coded = id_text(docs, id_col, text_col).withColumn("text_key", text_key()).dropDuplicates(["doc_id", "text_key"]).mapInArrow(run, "d_id long, d_key long, raw binary")
    same = packed["doc_id"].eqNullSafe(coded["d_id"]) & packed["text_key"].eqNullSafe(coded["d_key"])
    ids = F.expr("substring(raw, cast(4 * start + 1 as int), cast(4 * length as int))")
    pieces = packed.join(coded, same).select("sequence_id", F.struct(F.col("offset"), ids.alias("ids")).alias("p"))
    return pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("pieces")).mapInArrow(numbers, "sequence_id long, ids array<int>")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("text_key")
