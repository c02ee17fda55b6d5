"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised (A-Z lower-cased, runs of other ASCII characters than
letters and digits to one space). A region within ``e`` edits of an item of
``m`` bytes shares at least ``m - q + 1 - q * e`` of its q-grams, all of them
on diagonals that lie at most ``e`` apart. So shared q-grams are counted per
diagonal cell of ``e + 1`` diagonals, every two neighbouring cells form one
of the overlapping bands, and bands below the bound are dropped. What is left
is verified by banded alignment (edit distance of the whole item against any
stretch of the region, cells off the band never computed).

The benchmark is the stated query set: it is read in blocks of at most
``BLOCK_BYTES`` and every block is broadcast to one Arrow pass over all whole
documents; documents are never shuffled.

Edge cases: null texts count as empty; items of fewer than ``Q`` normalised
bytes have no q-gram and match nothing; the edit budget of short items is cut
down to what keeps the bound at one q-gram or more; repeated rows and items
are matched each on its own; very long texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import id_text, released, small, utf8

#: q-gram length (bytes) and edits allowed per byte of an item.
Q, EDIT_RATE = 8, 0.1
#: Benchmark text broadcast at once, document text processed at once.
BLOCK_BYTES, GROUP_BYTES = 8 << 20, 2 << 20
_SLOT_BITS = 21
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(1, 128) if not chr(c).isalnum()]] = 32


def normalise(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(normalised bytes, place of each in raw). Byte 0 stays as it is."""
    plain = _PLAIN[np.frombuffer(raw.lower(), np.uint8)]
    blank = plain == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    return plain[at], at


def grams(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number each."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), "<u8", buffer=np.ascontiguousarray(text).tobytes(), strides=(1,)).copy()


def budget(m: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed for an item of m bytes."""
    return max(0, min(int(rate * m), (m - Q) // Q))


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, cap: int) -> tuple[int, int] | None:
    """(edits, end) of the best alignment of the whole item with a stretch of
    the text, on the diagonals low..high (text place minus item place); None
    above cap edits."""
    width = high - low + 1
    big = cap + 1 + len(item)
    steps = np.arange(width)
    places = low + steps  # text places before row 0
    row = np.where((places >= 0) & (places <= len(text)), 0, big).astype(np.int32)
    padded = np.zeros(width + len(item) + 1, np.uint8)
    a, b = max(0, low), min(len(text), low + len(padded))
    padded[a - low:b - low] = text[a:b]
    inside = np.zeros(len(padded) + 1, bool)
    inside[a - low:b - low + 1] = True
    for i in range(len(item)):
        # cell k of row i+1 is text place low + i + 1 + k
        new = row + (padded[i:i + width] != item[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[~inside[i + 1:i + 1 + width]] = big
        new = np.minimum.accumulate(new - steps) + steps
        row = new
        if row.min() > cap:
            return None
    k = int(row.argmin())
    return (int(row[k]), low + len(item) + k) if row[k] <= cap else None


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, cap: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the item in the text near the diagonals low..high."""
    low, high = low - cap, high + cap
    a, b = max(0, low), min(len(text), high + len(item) + 1)
    exact = text[a:b].tobytes().find(item.tobytes())
    if exact >= 0:
        return 0, a + exact, a + exact + len(item)
    found = banded_distance(item, text, low, high, cap)
    if found is None:
        return None
    edits, end = found
    start = banded_distance(item[::-1], text[:end][::-1], -cap, cap, cap)
    return edits, end - start[1], end


class Index:
    """q-grams of a block of items, and the matches of texts against them."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = EDIT_RATE):
        self.ids = [i for i, _ in items]
        self.texts = [normalise(t.strip(b"\x00"))[0] for _, t in items]
        self.texts = [np.frombuffer(t.tobytes().strip(b" "), np.uint8) for t in self.texts]
        self.edits = np.array([budget(len(t), rate) for t in self.texts], np.int64)
        self.need = np.array([len(t) - Q + 1 - Q * e for t, e in zip(self.texts, self.edits.tolist())], np.int64)
        every = [grams(t) for t in self.texts]
        codes = np.concatenate([*every, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(every)), [len(g) for g in every])
        place = np.concatenate([*[np.arange(len(g)) for g in every], np.zeros(0, np.int64)])
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.first = np.append(first, len(codes))
        self.owner, self.place = owner[order], place[order]
        self.slots = np.zeros(1 << _SLOT_BITS, bool)
        self.slots[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * _MULTIPLY) >> np.uint64(64 - _SLOT_BITS)

    def regions(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of the bands that meet
        the bound; touching bands of one item are one region."""
        codes = grams(text)
        if not len(self.codes) or not len(codes):
            return []
        at = np.flatnonzero(self.slots[self._slot(codes)])
        where = np.searchsorted(self.codes, codes[at])
        where[where == len(self.codes)] = 0
        same = self.codes[where] == codes[at]
        at, where = at[same], where[same]
        counts = self.first[where + 1] - self.first[where]
        total = int(counts.sum())
        if not total:
            return []
        entry = np.repeat(self.first[where] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(total)
        item = self.owner[entry]
        diagonal = np.repeat(at, counts) - self.place[entry]
        cell = (diagonal + (1 << 20)) // (self.edits[item] + 1)
        key, n = np.unique(item * (np.int64(1) << 40) + cell, return_counts=True)
        item, cell = key >> 40, key & ((np.int64(1) << 40) - 1)
        next_too = np.append((np.diff(key) == 1), False)
        band = n + np.where(next_too, np.append(n[1:], 0), 0)
        before_too = np.append(False, next_too[:-1])
        good = band >= self.need[item]
        # a cell alone can be the upper half of a band with an empty lower cell: covered by its own band
        out: list[tuple[int, int, int]] = []
        for k in np.flatnonzero(good).tolist():
            w = int(self.edits[item[k]]) + 1
            low = (int(cell[k])) * w - (1 << 20)
            high = low + 2 * w - 1
            if before_too[k] and out and out[-1][0] == int(item[k]) and out[-1][2] >= low - 1:
                out[-1] = (out[-1][0], out[-1][1], high)
            else:
                out.append((int(item[k]), low, high))
        return out

    def matches(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) in a normalised text."""
        out = []
        for item, low, high in self.regions(text):
            found = align(self.texts[item], text, low, high, int(self.edits[item]))
            if found is not None and (item, *found) not in out[-2:]:
                out.append((item, *found))
        return out


def _batch_matches(own: Index, raw: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, first byte, end byte) of a batch's matches."""
    texts = [t.replace(b"\x00", b" ") for t in raw]
    a = 0
    while a < len(texts):
        z, size = a, 0
        while z < len(texts) and size < GROUP_BYTES:
            size += len(texts[z])
            z += 1
        ends = np.cumsum([len(t) + 1 for t in texts[a:z]])
        joined, at = normalise(b"\x00".join([*texts[a:z], b""]))
        for item, edits, start, end in own.matches(joined):
            first, last = int(at[start]), int(at[end - 1]) + 1
            k = int(np.searchsorted(ends, first, side="right"))
            base = int(ends[k]) - len(texts[a + k]) - 1
            yield a + k, item, edits, first - base, min(last - base, len(texts[a + k]))
        a = z


def _matches(docs: DataFrame, items: list[tuple[int, bytes]], rate: float) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(Index(items, rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        chars = lambda x: len(x.decode("utf-8", "replace"))
        for b in small(batches):
            ids, texts = b.column("doc_id").to_pylist(), utf8(b.column("text"))
            rows = []
            for k, item, edits, first, end in _batch_matches(own, texts):
                head = chars(texts[k][:first])
                rows.append((ids[k], own.ids[item], head, head + chars(texts[k][first:end]), edits, len(own.texts[item])))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start", "end", "edits", "item_bytes"])

    return docs.mapInArrow(released(run), "doc_id long, item_id long, start long, end long, edits long, item_bytes long")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """The query set in blocks of about BLOCK_BYTES."""
    items = id_text(benchmark, item_col, text_col).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    for k in range(blocks):
        yield [(r.doc_id, r.text.encode()) for r in items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == k).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, start, end (code points of the text), edits,
    item_bytes: every region of a document within the edit budget of an item."""
    rows = id_text(docs, id_col, text_col)
    return reduce(DataFrame.unionByName, [_matches(rows, block, rate) for block in _blocks(benchmark, item_col, text_col)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs without a match, all columns."""
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, "text"):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, rate))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in small(batches):
                leaking = {m[0] for m in _batch_matches(index.value, utf8(b.column(at)))}
                yield b.filter(pa.array([k not in leaking for k in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(released(run), docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of the benchmark in documents; clean documents have no row."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
