"""Repeated-substring removal by maximal repeats of an enhanced suffix array.

Every byte covered by a ``LENGTH``-byte string that starts anywhere else too
(same document included) is removed, judged on the input texts.

Distribution. Each window of ``LENGTH`` bytes is owned by its smallest
``GRAM``-byte gram (by a hash; leftmost on ties), its *anchor*. Equal windows
have equal anchors at equal places, so they can be found per anchor content.
The windows that share one anchor occurrence form a *stretch* of text.

1. One pass gives a narrow row per stretch: hashes of its anchor's gram and
   of the whole stretch. A ``groupBy`` with map-side combine keeps the grams
   that occur again, and tells whether all their stretches are equal (then
   they are covered whole, no text has to move).
2. Only the other, *mixed* stretches are fetched, one copy of each distinct
   stretch, dealt by gram, and each task builds an enhanced suffix array
   (suffixes, common-prefix lengths) over its stretches. A stack scan visits
   its common-prefix intervals; an interval whose occurrences have different
   left neighbours is a maximal repeat, reported with all its occurrences.
3. Grams with more than ``HOT`` distinct stretches (a passage in very many
   contexts) would not fit one task: their stretches are cut in two and dealt
   again by longer keys, the windows that reach far to the left of the gram by
   the gram with the bytes left of it, the others by the gram with the bytes
   right of it. Equal windows stay together. Keys that are still hot are halved
   again, at most eight times (then a key is the window itself); every group
   goes through step 2's suffix array.

Nothing is capped: a copied passage of any number of documents is found in
every one of them. Documents are shuffled once (the exchange is reused).

Edge cases: null or short texts have no windows (nothing removed, hash of the
whole text); repeated rows count as copies of each other; very long texts are
cut into overlapping pieces, which moves no window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from .common import id_text, released, small, utf8

#: Bytes of a repeated string, bytes of the grams that own windows.
LENGTH, GRAM = 200, 64
#: Distinct stretches of one gram up to which a task takes them together.
HOT = 2_000
#: Bytes handled together in a task: texts, and stretches in a suffix array.
PIECE, CHUNK = 4 << 20, 2 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                               0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _words(buffer: bytes) -> np.ndarray:
    """The eight bytes from every place on."""
    return np.ndarray((max(0, len(buffer) - 7),), "<u8", buffer=buffer, strides=(1,))


def stretches(texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(text, first start, number of starts, anchor) of every stretch; places
    count from the text's first byte."""
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            piece = t[at:at + PIECE + LENGTH - 1]
            if len(piece) >= LENGTH:
                group.append((k, at, piece))
                size += len(piece)
            if size >= PIECE:
                yield from _stretches(group)
                group, size = [], 0
    if group:
        yield from _stretches(group)


def _stretches(group: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
    buffer = b"".join(p for _, _, p in group)
    words = _words(buffer)
    n = len(buffer) - GRAM + 1
    code = words[:n] * _ODD[0]
    for j in range(1, GRAM // 8):
        code += words[8 * j:8 * j + n] * _ODD[j]
    code ^= code >> np.uint64(29)
    code *= _ODD[3]
    # 40 bits of hash above 24 bits of place: the smallest is the leftmost of the smallest
    least = (code & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    span, width = LENGTH - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    sizes = np.array([len(p) for _, _, p in group])
    begin = np.cumsum(sizes) - sizes
    starts = np.concatenate([np.arange(b, b + s - LENGTH + 1) for b, s in zip(begin.tolist(), sizes.tolist())])
    own = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(own) != 0) | (np.diff(starts) != 1)
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(starts)))
    first = starts[heads]
    which = np.searchsorted(begin, first, side="right") - 1
    for g, s, c, a in zip(which.tolist(), first.tolist(), count.tolist(), own[heads].tolist()):
        k, at, _ = group[g]
        yield k, s - int(begin[g]) + at, c, a - int(begin[g]) + at


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        texts, ids, keys = utf8(b.column("text")), b.column("doc_id").to_pylist(), b.column("text_key").to_pylist()
        rows = []
        digest = xxhash.xxh3_64_intdigest
        for k, s, c, a in stretches(texts):
            t = texts[k]
            rows.append((ids[k], keys[k], s, c, _signed(digest(t[a:a + GRAM])), _signed(digest(t[s:s + c + LENGTH - 1]))))
            if len(rows) >= 100_000:
                yield _stretch_batch(rows)
                rows = []
        yield _stretch_batch(rows)


def _stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "text_key", "start", "starts", "gram", "whole"])


class SuffixArray:
    """Enhanced suffix array over the suffixes that start at the first
    ``counts[i]`` bytes of ``texts[i]``; texts end with a byte beyond all."""

    def __init__(self, texts: list[bytes], counts: list[int]):
        pad = b"\xff" * 8
        self.buffer = b"".join(t + pad for t in texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes + 8) - (sizes + 8)
        n = len(self.buffer)
        end = np.repeat((begin + sizes).astype(np.int32), sizes + 8)
        first = np.repeat(begin, counts)
        within = np.arange(len(first)) - np.repeat(np.cumsum(counts) - np.array(counts, np.int64), counts)
        place = first + within
        self.owner = np.repeat(np.arange(len(texts)), counts)
        # ranks of the 8, 16, ... bytes from every place on
        words = np.append(_words(self.buffer), np.full(7, ~np.uint64(0)))
        _, rank = np.unique(words.byteswap(), return_inverse=True)
        levels = [rank.astype(np.int64)]
        width = 8
        everywhere = np.arange(n)
        longest = int(sizes.max())
        while width < longest:
            levels.append(np.unique(levels[-1] * (n + 2) + self._at(levels[-1], everywhere, width, end), return_inverse=True)[1])
            width *= 2
        order = np.argsort(levels[-1][place], kind="stable")
        self.place, self.owner, self.within = place[order], self.owner[order], within[order]
        a, b = self.place[:-1], self.place[1:]
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            w = 8 << k
            same = self._at(levels[k], a + common, 0, end) == self._at(levels[k], b + common, 0, end)
            common += np.where(same & (a + common < end[a]) & (b + common < end[b]), w, 0)
        raw = np.frombuffer(self.buffer, np.uint8)
        going = np.ones(len(a), bool)
        for _ in range(7):
            x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
            going &= raw[x] == raw[y]
            common += going
        #: common[i]: of the suffixes i and i+1
        self.common = np.minimum(common, np.minimum(end[a] - a, end[b] - b))
        #: the byte before a suffix; a value of its own where the text begins
        self.left = np.where(self.within > 0, raw[np.maximum(self.place - 1, 0)].astype(np.int64), -1 - np.arange(len(order)))

    @staticmethod
    def _at(rank: np.ndarray, place: np.ndarray, step: int, end: np.ndarray) -> np.ndarray:
        """Rank at place + step; beyond the end of place's text one rank above all."""
        at = np.minimum(place + step, len(rank) - 1)
        stop = end[np.minimum(place, len(end) - 1)]
        return np.where(place + step >= stop, len(rank) + 1, rank[at])

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of the common-prefix intervals of at least
        ``least`` bytes whose suffixes differ in the byte before them."""
        n = len(self.place)
        if n < 2:
            return
        # runs of suffixes that share `least` bytes; those of one left neighbour hold no maximal repeat
        cut = np.flatnonzero(self.common < least) + 1
        heads, tails = np.append(0, cut), np.append(cut, n)
        changes = np.append(0, np.cumsum(self.left[1:] != self.left[:-1]))
        runs = np.flatnonzero((tails - heads > 1) & (changes[tails - 1] != changes[heads]))
        common, change = self.common, changes
        for a, z in zip(heads[runs].tolist(), tails[runs].tolist()):
            stack: list[tuple[int, int]] = []  # (length, first)
            lengths = [*common[a:z - 1].tolist(), 0]
            for i, length in enumerate(lengths):
                first = a + i
                while stack and stack[-1][0] > length:
                    own, first = stack.pop()
                    last = a + i
                    if change[last] != change[first]:
                        yield own, first, last
                if length and (not stack or stack[-1][0] < length):
                    stack.append((length, first))

    def covered(self, least: int) -> np.ndarray:
        """Bytes from every suffix on that lie in a maximal repeat starting there."""
        out = np.zeros(len(self.place), np.int64)
        for length, first, last in self.maximal_repeats(least):
            np.maximum(out[first:last + 1], length, out=out[first:last + 1])
        return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_SPANS_SQL = "array<struct<a: int, b: int>>"


def _repeat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct stretches, sorted by gram -> their covered spans."""
    held: list[tuple] = []
    size = 0

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        array = SuffixArray([r[2] for r in rows], [r[3] for r in rows])
        length = array.covered(LENGTH)
        found: list[list[tuple[int, int]]] = [[] for _ in rows]
        hit = np.flatnonzero(length)
        for k, s, n in zip(array.owner[hit].tolist(), array.within[hit].tolist(), length[hit].tolist()):
            found[k].append((s, s + n))
        spans = [[(0, len(r[2]))] if r[4] > 1 else merge(f) for r, f in zip(rows, found)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], _SPANS)], ["gram", "whole", "spans"])

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("gram", "whole", "text", "starts", "n"))):
            if size >= CHUNK and row[0] != held[-1][0]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[2])
    if held:
        yield solve(held)


def _solved(stretches_of_grams: DataFrame) -> DataFrame:
    """(gram, whole, text, starts, n) -> gram, whole, spans. Dealt by a hash of
    the gram: after a join on the gram itself Spark would leave the exchange out
    and, once the join is a broadcast, read the pieces where they lie."""
    dealt = stretches_of_grams.select("gram", "whole", "text", "starts", "n").repartition(F.xxhash64("gram")).sortWithinPartitions("gram")
    return dealt.mapInArrow(released(_repeat_rows), f"gram long, whole long, spans {_SPANS_SQL}")


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches whose key (text[lo:hi], in every window; lo -1: the anchor) is
    hot -> their windows that hold more bytes left of the key, and the others,
    with the longer keys these share."""
    digest = xxhash.xxh3_64_intdigest
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
    for b in batches:
        rows = []
        for gram, whole, off, starts, text, lo, hi, n in zip(*(b.column(c).to_pylist() for c in ("gram", "whole", "off", "starts", "text", "lo", "hi", "n"))):
            if lo < 0:
                lo = next(stretches([text]))[3]
                hi = lo + GRAM
            room = LENGTH - (hi - lo)
            left = (room + 1) // 2
            cut = min(max(lo - left + 1, 0), starts)  # windows before this one hold so many bytes left of the key
            for first, last, p, q in ((0, cut, lo - left, hi), (cut, starts, lo, hi + room - left + 1)):
                if first < last:
                    part = text[first:last - 1 + LENGTH]
                    rows.append((_signed(digest(text[p:q], seed=q - p)), _signed(digest(part)), gram, whole, off + first, last - first, part, p - first, q - first, n))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "sub", "gram", "whole", "off", "starts", "text", "lo", "hi", "n"])


_HALVES = "key long, sub long, gram long, whole long, off int, starts int, text binary, lo int, hi int, n long"


def _hot_spans(stretches_of_hot_grams: DataFrame) -> DataFrame:
    """(gram, whole, text, starts, n) of hot grams -> gram, whole, spans."""
    level = stretches_of_hot_grams.select("gram", "whole", F.lit(0).alias("off"), "starts", "text", F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), "n")
    found = None
    while True:
        halves = cut_lineage(level.mapInArrow(released(_halves), _HALVES))
        parts = cut_lineage(halves.groupBy("key", "sub").agg(F.sum("n").alias("n"), F.first("starts").alias("starts"), F.first("text").alias("text"),
                                                              F.first(F.col("hi") - F.col("lo")).alias("held")))
        # a key as long as a window is one distinct text
        hot = cut_lineage(parts.where(F.col("held") < LENGTH).groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("key"))
        cold = parts.join(hot, "key", "left_anti").select(F.col("key").alias("gram"), F.col("sub").alias("whole"), "text", "starts", "n")
        solved = _solved(cold).where(F.size("spans") > 0).select(F.col("gram").alias("key"), F.col("whole").alias("sub"), "spans")
        moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("off")).alias("a"), (s["b"] + F.col("off")).alias("b")))
        own = halves.select("key", "sub", "gram", "whole", "off").join(solved, ["key", "sub"]).select("gram", "whole", moved.alias("spans"))
        found = own if found is None else found.unionByName(own)
        if hot.isEmpty():
            return found.groupBy("gram", "whole").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        level = halves.join(hot, "key", "left_semi").select("gram", "whole", "off", "starts", "text", "lo", "hi", "n")


def _mixed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the places of their mixed stretches -> the stretches' bytes."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for b in small(batches):
        rows, size = [], 0
        for t, places in zip(utf8(b.column("text")), b.column("places").to_pylist()):
            for p in places:
                s = t[p["start"]:p["start"] + p["starts"] + LENGTH - 1]
                rows.append((p["gram"], p["whole"], p["starts"], s))
                size += len(s)
            if size > CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["gram", "whole", "starts", "text"])
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["gram", "whole", "starts", "text"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        n_bytes, n_removed, removed, hashes = [], [], [], []
        for t, spans in zip(utf8(b.column("text")), b.column("spans").to_pylist()):
            cut = merge([(s["a"], s["b"]) for s in spans or []])
            kept, at = hashlib.sha256(), 0
            for a, z in cut:
                kept.update(t[at:a])
                at = z
            kept.update(t[at:])
            n_bytes.append(len(t))
            n_removed.append(sum(z - a for a, z in cut))
            removed.append([{"a": a, "b": z} for a, z in cut])
            hashes.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, _SPANS), pa.array(hashes)],
                                         ["doc_id", "n_bytes", "n_removed", "removed", "kept_sha256"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (byte spans), kept_sha256 per row."""
    rows = id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    pieces = rows.where(F.octet_length("text") >= LENGTH).mapInArrow(
        released(_stretch_rows), "doc_id long, text_key long, start int, starts int, gram long, whole long")
    again = cut_lineage(pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
                        .where("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed")))
    found = cut_lineage(pieces.join(again, "gram"))
    mixed = found.where("mixed")
    at = ["doc_id", "text_key"]
    # identical rows carry identical places: one copy of them per key, but every copy counts
    kinds = mixed.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"))
    kinds = cut_lineage(kinds)
    hot = cut_lineage(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("gram"))
    chosen = mixed.groupBy("gram", "whole").agg(F.min_by(F.struct("doc_id", "text_key", "start", "starts"), F.struct("doc_id", "text_key", "start")).alias("p"))
    places = chosen.select(F.col("p.doc_id").alias("doc_id"), F.col("p.text_key").alias("text_key"), F.struct("gram", "whole", "p.start", "p.starts").alias("place"))
    places = places.groupBy(*at).agg(F.collect_list("place").alias("places"))
    same = [rows[c].eqNullSafe(places[c]) for c in at]
    # one row per key is enough to read a stretch from
    texts = rows.join(places, same).select(rows["text"], places["places"]).mapInArrow(released(_mixed_texts), "gram long, whole long, starts int, text binary")
    texts = texts.groupBy("gram", "whole").agg(F.first("starts").alias("starts"), F.first("text").alias("text")).join(kinds, ["gram", "whole"])
    texts = cut_lineage(texts)
    cold = texts.join(hot, "gram", "left_anti")
    repeats = _solved(cold)
    if not hot.isEmpty():
        repeats = repeats.unionByName(_hot_spans(texts.join(hot, "gram", "left_semi")))
    solved = cut_lineage(repeats.where(F.size("spans") > 0))
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    plain = found.where(~F.col("mixed")).select(*at, F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("starts") + (LENGTH - 1)).alias("b"))).alias("spans"))
    parts = plain.unionByName(mixed.join(solved, ["gram", "whole"]).select(*at, moved.alias("spans")))
    spans = parts.groupBy(*at).agg(F.flatten(F.collect_set("spans")).alias("spans"))
    same = [rows[c].eqNullSafe(spans[c]) for c in at]
    return rows.join(spans, same, "left").select(rows["doc_id"], rows["text"], spans["spans"]).mapInArrow(
        released(_removed), f"doc_id long, n_bytes long, n_removed long, removed {_SPANS_SQL}, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
