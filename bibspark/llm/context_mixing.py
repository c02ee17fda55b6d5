"""Language-model scoring by online logistic context mixing.

A text is its tokens: words (A-Z lower-cased, runs of other bytes than
``[\\x20\\x09-\\x0D]``), each closed by a space, then one end. The model gives
every bit of every byte a probability: hashed contexts (orders one to four,
the word so far, the word so far with the class of the token before) look up
bit counts; their stretched probabilities are combined by logistic weights
chosen by a gate (how often the long contexts were seen); the result is
refined by an adaptive map per order-one context. The sum of the bits' log
probabilities is the text's.

Contexts do not reach beyond the word and the class of the token before, so
a token's probability depends on (class, word) only. That makes the job one
over distinct tokens:

1. Documents are dealt into blocks by a hash (packed); a block packs its distinct
   (class, word) pairs with counts per bucket of words, and keeps its documents
   as numbers of those pairs, so texts are split into words once. Buckets add
   them up: exact training counts of every word (c, N, V), whatever the corpus size.
2. Buckets count (context, next byte) by a 64-bit key, which holds 56 bits of
   the context's hash and the byte, in chunks of words. Parts of the key space
   add the chunks' counts up and answer each chunk with the bit counts of the
   nodes it asked for. The number of parts follows the distinct words: there
   is no table of a fixed size and no two contexts share a place.
3. Weights and maps are learned online over the words of one training fold
   that the counts did not see, bucket by bucket, and averaged.
4. Buckets score their distinct pairs once and answer every block in the
   order it asked; blocks add the answers up per document.

Learned from: rows whose crc32(doc_id as text) mod 5 is not 1. Weights and
maps are learned on fold 4 over counts of folds 0, 2 and 3; the scores use
word counts and tables of all four.

Edge cases: null text counts as empty and is one end token; bytes that occur
in no training text get the contexts' default of a half per bit; a table
without training rows scores every bit a half; repeated rows count twice;
very long words are processed whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from .common import fold_of_id, id_text, release, utf8

HELD_OUT, MIX_FOLD = 1, 4
#: Text bytes per block and per bucket, word bytes handled together.
BLOCK_BYTES, CHUNK = 16 << 20, 1 << 19
#: Contexts, gates, map columns.
CONTEXTS, GATES, COLUMNS = 6, 16, 33
#: Places per context that a part of the key space is sized for, and the fewest parts.
_SLOTS, MIN_PARTS = 1 << 20, 16
_END = b"\n"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]

# Class of the token before by its last byte: 1 start, 2 sentence end, 3 other punctuation, 4 letter or digit.
_CLASS = np.array([4 if c >= 128 or chr(c).isalnum() else 2 if c in b".!?" else 3 for c in range(256)], np.int32)
_BEFORE = [bytes([c]) for c in range(1, 5)]


def _numbered(words: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words, each closed by a space -> the distinct ones as they come, and which one each is."""
    ends = np.flatnonzero(np.frombuffer(words, np.uint8) == 32) + 1
    each = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(words)]).dictionary_encode()
    return [w[:-1] for w in each.dictionary.to_pylist()], each.indices.to_numpy()


def tokens_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts' distinct words, their tokens text by text, and how many each
    text has. A token's number is four times that of its word, plus the class
    of the token before, less one; the end is the word newline."""
    spaced, sizes = [], np.empty(len(texts), np.int64)
    for k, t in enumerate(texts):
        own = t.lower().split()  # bytes split at exactly the six white-space bytes
        sizes[k] = len(own) + 1
        spaced.append(b" ".join([*own, _END, b""]))
    words, own = _numbered(b"".join(spaced))
    after = _CLASS[np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)]
    before = np.append(np.int32(1), after[own[:-1]])
    before[np.cumsum(sizes)[:-1]] = 1
    return words, (own * 4 + before - 1).astype(np.int32), sizes


def _ask(texts: list[bytes], ids: list[int | None], buckets: int):
    """Per bucket: a block's distinct tokens (sorted by word) and their counts
    in the table folds and in the mixing fold. Then the tokens' numbers text
    by text, frequent ones low, how many each text has, and the numbers in the
    order asked."""
    words, number, sizes = tokens_of(texts)
    fold = np.repeat(np.array([fold_of_id(i) for i in ids], np.int8), sizes)
    size = 4 * len(words)
    every, mix, out = (np.bincount(x, minlength=size) for x in (number, number[fold == MIX_FOLD], number[fold == HELD_OUT]))
    table = every - mix - out
    used = np.flatnonzero(every)
    rank = np.empty(size, np.int32)
    rank[used[np.argsort(-every[used], kind="stable")]] = np.arange(len(used))
    parts: list[list[int]] = [[] for _ in range(buckets)]
    for x, w in enumerate(words):
        parts[zlib.crc32(w) % buckets].append(x)
    asked, order = [], []
    for k, own in enumerate(parts):
        own.sort(key=words.__getitem__)
        four = (np.array(own, np.int64)[:, None] * 4 + np.arange(4)).ravel()
        has = np.flatnonzero(every[four])
        if len(has):
            four = four[has]
            asked.append((k, [_BEFORE[x & 3] + words[x >> 2] for x in four.tolist()], table[four], mix[four]))
            order.append(rank[four])
    return asked, rank[number], sizes, np.concatenate(order)


def _freed(run):
    """A pass over groups that gives its memory back after each."""

    def one(group: pa.Table) -> pa.Table:
        out = run(group)
        release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        release()
        return out

    return one if run.__code__.co_argcount == 1 else two


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _longs(values) -> bytes:
    return _pack(np.asarray(values, np.int64).tobytes())


def _numbers(packed: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(_unpack(packed), kind)


def _words(packed: bytes) -> list[bytes]:
    return _unpack(packed).split(b" ")


_DEALT = "block int, ids array<long>, sizes array<int>, texts binary"


def _dealing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> per block one packed row of a batch's texts."""
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), utf8(b.column("text"))
        parts: dict[int, list[int]] = {}
        for k, block in enumerate(b.column("block").to_pylist()):
            parts.setdefault(block, []).append(k)
        for block, own in parts.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int32()), pa.array([[ids[k] for k in own]], pa.list_(pa.int64())), pa.array([[len(texts[k]) for k in own]], pa.list_(pa.int32())),
                pa.array([_pack(b"".join(texts[k] for k in own))], pa.binary())], ["block", "ids", "sizes", "texts"])


def _dealt(group: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """(ids, texts) of a block's packed rows."""
    all_ids: list[int | None] = []
    texts: list[bytes] = []
    for ids, sizes, packed in zip(*(group.column(c).to_pylist() for c in ("ids", "sizes", "texts"))):
        raw, at = _unpack(packed), 0
        all_ids += ids
        for n in sizes:
            texts.append(raw[at:at + n])
            at += n
    return all_ids, texts


#: a row without a bucket holds a block's documents: numbers, how many each has, the numbers asked
_ASKED = "bucket int, block int, tokens binary, a binary, b binary, ids array<long>, sizes array<int>"


def _asking(buckets: int):
    @_freed
    def run(group: pa.Table) -> pa.Table:
        ids, texts = _dealt(group)
        asked, number, sizes, order = _ask(texts, ids, buckets)
        block, n = group.column("block")[0].as_py(), len(asked)
        return pa.table({"bucket": pa.array([*(k for k, *_ in asked), None], pa.int32()), "block": pa.array([block] * (n + 1), pa.int32()),
                         "tokens": pa.array([*(_pack(b" ".join(p)) for _, p, _, _ in asked), _planes(number)], pa.binary()),
                         "a": pa.array([*(_longs(a) for *_, a, _ in asked), _longs(sizes)], pa.binary()), "b": pa.array([*(_longs(b) for *_, b in asked), _planes(order)], pa.binary()),
                         "ids": pa.array([*[None] * n, ids], pa.list_(pa.int64())), "sizes": pa.array([*[None] * n, list(map(len, texts))], pa.list_(pa.int32()))})

    return run


@_freed
def _adding(group: pa.Table) -> pa.Table:
    """All that blocks ask of a bucket -> its distinct tokens with total counts."""
    tokens, number = _numbered(b"".join([_unpack(t) + b" " for t in group.column("tokens").to_pylist()]))
    order = sorted(range(len(tokens)), key=tokens.__getitem__)
    every, place = [tokens[x] for x in order], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    place = place[number]
    a, b = (np.rint(np.bincount(place, np.concatenate([_numbers(x) for x in group.column(c).to_pylist()]).astype(np.float64), len(every))).astype(np.int64) for c in ("a", "b"))
    _, word = _numbered(b"".join([t[1:] + b" " for t in every]))
    words = np.rint(np.bincount(word, (a + b).astype(np.float64))).astype(np.int64)
    return pa.table({"bucket": group.column("bucket").slice(0, 1), "tokens": pa.array([_pack(b" ".join(every))], pa.binary()), "a": pa.array([_longs(a)], pa.binary()),
                     "b": pa.array([_longs(b)], pa.binary()), "c": pa.array([_longs(words[word])], pa.binary()), "size": pa.array([sum(map(len, every))], pa.int64()),
                     "n": pa.array([int(words.sum())], pa.int64()), "v": pa.array([int((words > 0).sum())], pa.int64())})


class Spelled:
    """Bytes of many tokens in a row with their hashed contexts."""

    def __init__(self, tokens: list[bytes]):
        parts = [t[1:] if t[1:] == _END else t[1:] + b" " for t in tokens]
        self.byte = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(parts)), sizes)
        n = len(self.byte)
        begin = np.repeat(self.first, sizes)
        within = np.arange(n) - begin
        kind = np.repeat(np.array([t[0] for t in tokens], np.uint64), sizes)
        b = self.byte.astype(np.uint64)
        last = []
        for k in range(1, 5):
            shifted = np.full(n, 32, np.uint64)
            shifted[k:] = b[:-k] if n > k else b[:0]
            shifted[within < k] = 32
            last.append(shifted)
        self.order1 = last[0].astype(np.int64)
        up = np.cumprod(np.full(n + 1, _ODD[5], np.uint64))
        down = np.cumprod(np.full(n + 1, np.uint64(pow(int(_ODD[5]), -1, 1 << 64)), np.uint64))
        total = np.append(np.uint64(0), np.cumsum((b + np.uint64(1)) * up[:n]))
        prefix = (total[:-1] - total[begin]) * down[begin] + within.astype(np.uint64)
        order = [last[0]]
        for k in range(1, 4):
            order.append(order[-1] * np.uint64(257) + last[k])
        start = (within == 0).astype(np.uint64)
        contexts = [order[0] + kind * np.uint64(256) + start * np.uint64(4096), order[1], order[2], order[3], prefix, prefix + kind * _ODD[3]]
        #: the distinct (context, byte) in order, and which one every context and byte has
        keys = np.empty((CONTEXTS, n), np.uint64)
        for k, (row, c) in enumerate(zip(keys, contexts)):
            np.multiply(c, _ODD[0], out=row)
            row += _ODD[k + 1]
            row ^= row >> np.uint64(31)
            row *= _ODD[1]
            row ^= row >> np.uint64(29)
            row &= ~np.uint64(255)
            row |= b
        del contexts, order, last, shifted, prefix, total, up, down, row, c  # before the most memory is needed
        self.keys, self.key = _distinct(keys.ravel())

    def counts(self, n: np.ndarray) -> np.ndarray:
        """How often every distinct key is seen if the tokens are seen n times."""
        return np.rint(np.bincount(self.key, np.tile(n[self.owner].astype(np.float64), CONTEXTS), len(self.keys))).astype(np.int64)

    def nodes(self) -> Iterator[np.ndarray]:
        """The place of its node for every distinct key, for each of eight bits."""
        base = 0
        for bit in range(8):
            place = np.cumsum(_nodes(self.keys, bit)) + (base - 1)
            base = int(place[-1]) + 1
            yield place

    def bits(self) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """(bit, the place of its node for every context) for the eight bits of all bytes."""
        for bit, place in enumerate(self.nodes()):
            yield (self.byte >> (7 - bit)) & 1, list(place[self.key].reshape(CONTEXTS, -1))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of every key among them."""
    order, own = _ordered(keys)
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    place = np.empty(len(own), np.int64)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return own[new], place


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and they in it: sorted as one number of the
    hash's first bits, the byte and the place (much faster than argsort); the
    few contexts that share those bits are put in order afterwards."""
    n = len(keys)
    at = np.uint64(n.bit_length())
    packed = keys >> np.uint64(8)
    if n:
        packed -= packed.min()
        drop = np.uint64(max(0, int(packed.max()).bit_length() + int(at) + 8 - 64))
    for k in range(0, n, 1 << 15):  # few enough to stay in the cache
        part = packed[k:k + (1 << 15)]
        part >>= drop
        part <<= np.uint64(8)
        part |= keys[k:k + (1 << 15)] & np.uint64(255)
        part <<= at
        part |= np.arange(k, k + len(part), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << at) - np.uint64(1))).view(np.int64)
    own = keys[order]
    wrong = np.flatnonzero(own[1:] < own[:-1])
    if len(wrong) > 1 + n // 1000:
        order = np.argsort(keys)
        return order, keys[order]
    if len(wrong):
        packed >>= at + np.uint64(8)
        for shared in np.unique(packed[wrong]):
            a, z = np.searchsorted(packed, [shared, shared + np.uint64(1)])
            order[a:z] = order[a:z][np.argsort(own[a:z])]
            own[a:z] = keys[order[a:z]]
    return order, own


def _nodes(keys: np.ndarray, bit: int) -> np.ndarray:
    """Does a key (ordered) open a new node, a context with the byte's bits before this one?"""
    node = keys >> np.uint64(8 - bit)
    new = np.ones(len(keys), bool)
    new[1:] = node[1:] != node[:-1]
    return new


def _chunks(tokens: list[bytes]) -> Iterator[slice]:
    """Runs of about CHUNK bytes."""
    a, size = 0, 0
    for z, t in enumerate(tokens):
        size += len(t)
        if size >= CHUNK:
            yield slice(a, z + 1)
            a, size = z + 1, 0
    if a < len(tokens):
        yield slice(a, len(tokens))


def _planes(values: np.ndarray) -> bytes:
    """Numbers packed byte by byte."""
    return _pack(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())  # tobytes alone is slow on columns


def _flat(packed: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(_numbers(packed, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_flat(packed, np.uint64), dtype=np.uint64)


_KEYS = "part int, bucket int, chunk int, keys binary, a binary, b binary"


def _counting(parts: int):
    """Words of a bucket -> per chunk and part the distinct keys with their
    counts in the table folds and in the mixing fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob, a, b in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tokens", "a", "b"))):
                words, a, b = _words(blob), _numbers(a), _numbers(b)
                for chunk, own in enumerate(_chunks(words)):
                    spelled = Spelled(words[own])
                    x, y = spelled.counts(a[own]), spelled.counts(b[own])
                    part = (spelled.keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # in the order of the keys, contexts stay whole
                    edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                    cuts = [(k, slice(i, j)) for k, (i, j) in enumerate(zip(edge.tolist(), edge[1:].tolist())) if i < j]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k for k, _ in cuts], pa.int32()), pa.array([bucket] * len(cuts), pa.int32()), pa.array([chunk] * len(cuts), pa.int32()), pa.array([_pack_keys(spelled.keys[c]) for _, c in cuts], pa.binary()),
                        pa.array([_planes(x[c]) for _, c in cuts], pa.binary()), pa.array([_planes(y[c]) for _, c in cuts], pa.binary())], ["part", "bucket", "chunk", "keys", "a", "b"])

    return run


_SEEN = "bucket int, chunk int, part int, a binary, b binary"


@_freed
def _summing(group: pa.Table) -> pa.Table:
    """All that chunks ask of a part -> per chunk what rebuilds the counts of
    its nodes, in the table folds and in the mixing fold: the counts of its
    keys, and for the nodes above them what their other keys add (mostly 0)."""
    asked = [_unpack_keys(k) for k in group.column("keys").to_pylist()]
    keys, place = _distinct(np.concatenate(asked))
    totals = [np.rint(np.bincount(place, np.concatenate([_flat(x) for x in group.column(c).to_pylist()]).astype(np.float64), len(keys))).astype(np.int64) for c in ("a", "b")]
    places = np.split(place, np.cumsum([len(k) for k in asked])[:-1])
    below = [[t[p] for t in totals] for p in places]  # counts of the nodes one bit on
    child = [np.arange(len(k)) for k in asked]  # their numbers by key
    found: list[list[list[np.ndarray]]] = [[[x] for x in own] for own in below]
    for bit in range(7, -1, -1):
        new = _nodes(keys, bit)
        first, node = np.flatnonzero(new), np.cumsum(new) - 1
        sums = [np.add.reduceat(t, first) for t in totals]
        for k, (own, its) in enumerate(zip(asked, places)):
            opens = _nodes(own, bit)
            start = np.flatnonzero(opens)
            for which, total in enumerate(sums):
                here = total[node[its[start]]]
                found[k][which].append(here - np.add.reduceat(below[k][which], child[k][start]))
                below[k][which] = here
            child[k] = np.cumsum(opens) - 1
    columns = [pa.array([_planes(np.concatenate([np.array([len(x) for x in own[which]], np.int64), *own[which]])) for own in found], pa.binary()) for which in range(2)]
    return pa.table({"bucket": group.column("bucket"), "chunk": group.column("chunk"), "part": group.column("part"), "a": columns[0], "b": columns[1]})


def _stretch(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (total - ones + 0.4)).astype(np.float16).astype(np.float32)


#: most nodes are seen seldom: their stretched probabilities by total and ones
_FEW = 128
_STRETCHED = _stretch(np.minimum(np.arange(_FEW), np.arange(_FEW)[:, None]), np.arange(_FEW)[:, None]).ravel()


def _levels(ones: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    stretch = _STRETCHED.take(total * _FEW + ones, mode="clip")
    often = np.flatnonzero(total >= _FEW)
    stretch[often] = _stretch(ones[often], total[often])
    return stretch, (total >= 1).view(np.uint8) + (total >= 4).view(np.uint8) + (total >= 32).view(np.uint8)


class Tables:
    """Stretched probability and count level of every place."""

    def __init__(self, counts: np.ndarray):
        pairs = counts.reshape(-1, 2)
        self.stretch, self.level = _levels(pairs[:, 1].astype(np.int64), pairs.sum(1).astype(np.int64))

    def at(self, places: np.ndarray) -> Tables:
        """The same for the nodes at these places."""
        own = Tables.__new__(Tables)
        own.stretch, own.level = self.stretch[places], self.level[places]
        return own

    @classmethod
    def rebuilt(cls, keys: np.ndarray, answers: list[np.ndarray]) -> Tables:
        """From the counts of a chunk's keys and what other keys add above them."""
        below, child, levels = answers[0], np.arange(len(keys)), []
        for bit, rest in zip(range(7, -1, -1), answers[1:]):
            opens = _nodes(keys, bit)
            start = np.flatnonzero(opens)
            head = child[start]
            one = np.zeros(len(below), np.int64)
            one[child] = (keys >> np.uint64(7 - bit)) & np.uint64(1)
            ones = np.add.reduceat(below * one, head) + rest * (1 - one[head])  # the rest is on the other side of an only child
            below = np.add.reduceat(below, head) + rest
            levels.append(_levels(ones, below))
            child = np.cumsum(opens) - 1
        own = cls.__new__(cls)
        own.stretch, own.level = (np.concatenate(x) for x in zip(*levels[::-1]))
        return own


def _answers(seen: pa.Table, columns: list[str]) -> dict[int, list[np.ndarray]]:
    """Per chunk what the parts answered, put together in the order of the keys."""
    chunks: dict[int, list[tuple[int, list[np.ndarray]]]] = {}
    for chunk, part, *folds in zip(*(seen.column(c).to_pylist() for c in ("chunk", "part", *columns))):
        flat = [_flat(x) for x in folds]
        values, sizes = sum(flat), flat[0][:9]
        chunks.setdefault(chunk, []).append((part, np.split(values[9:], np.cumsum(sizes)[:-1])))
    return {chunk: [np.concatenate(x) for x in zip(*(values for _, values in sorted(own, key=lambda e: e[0])))] for chunk, own in chunks.items()}


class Mixer:
    """Gated weights, and the adaptive map that refines their result."""

    def __init__(self, weights: np.ndarray | None = None, hits: np.ndarray | None = None):
        self.weights = np.full((GATES, CONTEXTS + 1), 0.3) if weights is None else weights
        if weights is None:
            self.weights[:, -1] = 0
        #: per order-one byte and column of stretched probability: zeros and ones seen
        self.hits = np.zeros((256, COLUMNS, 2)) if hits is None else hits

    @staticmethod
    def inputs(tables: Tables, places: list[np.ndarray] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a row for every context, the last one 1; the gate)"""
        x = np.ones((CONTEXTS + 1, len(places[0])))
        for row, at in zip(x, places):
            row[:] = tables.stretch[at]
        # gate: how often the word so far and order four were seen
        return x, tables.level[places[4]].astype(np.int64) * 4 + tables.level[places[3]]

    def stretched(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        s = np.zeros(len(gate))
        for row, weight in zip(x, np.ascontiguousarray(self.weights.T)):
            s += row * weight[gate]
        return np.clip(s, -11, 11)

    def learn(self, tables: Tables, spelled: Spelled, n: np.ndarray, rate: float = 0.2, batch: int = 1 << 11) -> None:
        """Online over the tokens with a count, in an order that is not their
        spelling's: predict a batch, note the outcome in the map, then step."""
        order = np.random.default_rng(13).permutation(np.flatnonzero(n))
        sizes = np.diff(np.append(spelled.first, len(spelled.byte)))[order]
        byte = np.repeat(spelled.first[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        weight, order1, key = n[spelled.owner[byte]].astype(np.float64), spelled.order1[byte], spelled.key.reshape(CONTEXTS, -1)[:, byte]
        row = np.arange(CONTEXTS + 1)[:, None] * GATES
        for k, node in enumerate(spelled.nodes()):
            here, y, hit = tables.at(node), (spelled.byte[byte] >> (7 - k)) & 1, np.empty(len(byte), np.int64)
            for a in range(0, len(byte), batch):
                own = slice(a, a + batch)
                x, gate = self.inputs(here, key[:, own])
                w, bit = weight[own], y[own]
                s = self.stretched(x, gate)
                column = np.rint((s + 8) * (COLUMNS - 1) / 16).clip(0, COLUMNS - 1).astype(np.int64)
                hit[own] = (order1[own] * COLUMNS + column) * 2 + bit
                err = (bit - 1 / (1 + np.exp(-s))) * w
                at = (row + gate).ravel()
                step, scale = (np.bincount(at, weights=v.ravel(), minlength=row.size * GATES).reshape(-1, GATES) for v in (err * x, w * x ** 2))
                scale += np.bincount(gate, weights=w, minlength=GATES)
                self.weights += (rate * step / (scale + 1e-9)).T
            self.hits += np.bincount(hit, weights=weight, minlength=self.hits.size).reshape(self.hits.shape)

    def refined(self) -> np.ndarray:
        """Probability of a one per order-one byte and column."""
        centre = 1 / (1 + np.exp(-np.linspace(-8, 8, COLUMNS)))
        return (self.hits[:, :, 1] + 16 * centre) / (self.hits.sum(2) + 16)

    def log2(self, tables: Tables, spelled: Spelled, batch: int = 1 << 13) -> np.ndarray:
        """log2 of every token's probability."""
        final = self.refined().ravel()
        total, key = np.zeros(len(spelled.byte)), spelled.key.reshape(CONTEXTS, -1)
        for k, node in enumerate(spelled.nodes()):
            here, y = tables.at(node), (spelled.byte >> (7 - k)) & 1
            for a in range(0, len(y), batch):  # few enough to stay in the cache
                own = slice(a, a + batch)
                x, gate = self.inputs(here, key[:, own])
                s = self.stretched(x, gate)
                place = ((s + 8) * (COLUMNS - 1) / 16).clip(0, COLUMNS - 1.001)
                low = place.astype(np.int64)
                part = place - low
                low += spelled.order1[own] * COLUMNS
                p = 0.5 / (1 + np.exp(-s)) + 0.5 * ((1 - part) * final[low] + part * final[low + 1])
                p = p.clip(1 / 65536, 1 - 1 / 65536)
                total[own] += np.log2(np.where(y[own] == 1, p, 1 - p))
        return np.add.reduceat(total, spelled.first)


_MIXER = "bucket int, mass long, weights binary, hits binary"


@_freed
def _mixing(own: pa.Table, seen: pa.Table) -> pa.Table:
    """A bucket's words and their nodes -> the mixer learned over the mixing fold."""
    mixer, mass = Mixer(), 0
    for words, b in zip(own.column("tokens").to_pylist(), own.column("b").to_pylist()):
        words, n = _words(words), _numbers(b)
        answers = _answers(seen, ["a"])
        for chunk, part in enumerate(_chunks(words)):
            if n[part].any():
                spelled = Spelled(words[part])
                mixer.learn(Tables.rebuilt(spelled.keys, answers[chunk]), spelled, n[part])
                mass += int(n[part].sum())
    return pa.table({"bucket": own.column("bucket").slice(0, 1), "mass": pa.array([mass] * min(1, own.num_rows), pa.int64()), "weights": pa.array([mixer.weights.tobytes()] * min(1, own.num_rows), pa.binary()), "hits": pa.array([mixer.hits.tobytes()] * min(1, own.num_rows), pa.binary())})


def _mean(group: pa.Table) -> pa.Table:
    """Mixers of buckets -> one, weights averaged by mass and hits added."""
    mass = group.column("mass").to_pylist()
    weights = sum(np.frombuffer(w) * (m / max(1, sum(mass))) for w, m in zip(group.column("weights").to_pylist(), mass))
    hits = sum(np.frombuffer(h) for h in group.column("hits").to_pylist())
    return pa.table({"bucket": group.column("bucket").slice(0, 1), "mass": pa.array([sum(mass)], pa.int64()), "weights": pa.array([weights.tobytes()], pa.binary()), "hits": pa.array([hits.tobytes()], pa.binary())})


_SCORED = "bucket int, tokens binary, c binary, log2 binary"


def _tokens_scored(mixer: Mixer):
    """A bucket's tokens and their nodes -> the log2 probability of each."""

    @_freed
    def run(own: pa.Table, seen: pa.Table) -> pa.Table:
        answers, logs = _answers(seen, ["a", "b"]), []
        for packed in own.column("tokens").to_pylist():
            tokens, got = _words(packed), [np.zeros(0)]
            for chunk, part in enumerate(_chunks(tokens)):
                spelled = Spelled(tokens[part])
                got.append(mixer.log2(Tables.rebuilt(spelled.keys, answers[chunk]), spelled))
            logs.append(np.concatenate(got))
        return pa.table({"bucket": own.column("bucket"), "tokens": own.column("tokens"), "c": own.column("c"), "log2": pa.array([_pack(x.astype(np.float32).tobytes()) for x in logs], pa.binary())})

    return run


@_freed
def _answering(asked: pa.Table, own: pa.Table) -> pa.Table:
    """What blocks asked of a bucket, and the bucket's scored tokens -> per
    block the training count and log2 probability of each token it asked for."""
    count, log2 = _numbers(own.column("c")[0].as_py()), _numbers(own.column("log2")[0].as_py(), np.float32)
    blobs = [_unpack(t) + b" " for t in [own.column("tokens")[0].as_py(), *asked.column("tokens").to_pylist()]]
    _, place = _numbered(b"".join(blobs))  # the bucket's own tokens come first, so a number is a place
    places = np.split(place, np.cumsum([x.count(b" ") for x in blobs[:-1]]))[1:]
    return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "c": pa.array([_longs(count[p]) for p in places], pa.binary()),
                     "log2": pa.array([_pack(log2[p].tobytes()) for p in places], pa.binary())})


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _scoring(n: int, v: int):
    """A block's documents and the answers to what it asked -> scores."""

    @_freed
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        number, sizes, order = _flat(docs.column("tokens")[0].as_py(), np.int32), _numbers(docs.column("a")[0].as_py()), _flat(docs.column("b")[0].as_py(), np.int32)
        ids, bytes_in = docs.column("ids")[0].as_py(), docs.column("sizes")[0].as_py()
        c, model = np.empty(len(order), np.int64), np.empty(len(order))
        answers = answers.sort_by("bucket")  # as asked
        c[order] = np.concatenate([_numbers(x) for x in answers.column("c").to_pylist()])
        model[order] = np.concatenate([_numbers(x, np.float32) for x in answers.column("log2").to_pylist()])
        base, known = np.log10((c + 0.5) / (n + 0.5 * (v + 1))), c > 0
        out: list[list] = [[] for _ in range(5)]
        for size, own in zip(bytes_in, np.split(number, np.cumsum(sizes)[:-1])):
            bits = -float(model[own].sum())
            for column, value in zip(out, (len(own), int(known[own].sum()), float(base[own].sum()), -bits * math.log10(2), bits / max(1, size))):
                column.append(value)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([fold_of_id(i) == HELD_OUT for i in ids], pa.bool_()), "n_tokens": pa.array(out[0], pa.int64()), "n_known": pa.array(out[1], pa.int64()),
                         "train_tokens": pa.array([n] * len(ids), pa.int64()), "base_score": pa.array(out[2], pa.float64()), "score": pa.array(out[3], pa.float64()), "bits_per_byte": pa.array(out[4], pa.float64())})

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    (log10 probability of the text), bits_per_byte (of the text's UTF-8 bytes)."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    size, count = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.lit(0)), F.count(F.lit(1))).first()
    if not count:
        return spark.createDataFrame([], _SCORES)
    blocks = -(-size // BLOCK_BYTES)
    buckets = blocks
    # repeated rows are spread by their place; any place does, scores don't depend on it
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).mapInArrow(_dealing, _DEALT)
    asked = cut_lineage(dealt.groupBy("block").applyInArrow(_asking(buckets), _ASKED))
    numbered, asked = asked.where("bucket IS NULL").drop("bucket"), asked.where("bucket IS NOT NULL").drop("ids", "sizes")
    words = cut_lineage(asked.groupBy("bucket").applyInArrow(_adding, "bucket int, tokens binary, a binary, b binary, c binary, size long, n long, v long"))
    n, v, distinct = words.agg(F.sum("n"), F.sum("v"), F.sum("size")).first()
    parts = max(MIN_PARTS, -(-distinct // _SLOTS))
    seen = cut_lineage(words.mapInArrow(_counting(parts), _KEYS).groupBy("part").applyInArrow(_summing, _SEEN))
    learned = words.select("bucket", "tokens", "b").groupBy("bucket").cogroup(seen.select("bucket", "chunk", "part", "a").groupBy("bucket")).applyInArrow(_mixing, _MIXER)
    learned = learned.where("mass > 0").groupBy(F.col("bucket") % MIN_PARTS).applyInArrow(_mean, _MIXER).collect()
    mixer = Mixer()
    if learned:
        mass = sum(r["mass"] for r in learned)
        mixer = Mixer(sum(np.frombuffer(r["weights"]).reshape(GATES, -1) * (r["mass"] / mass) for r in learned),
                      sum(np.frombuffer(r["hits"]).reshape(256, COLUMNS, 2) for r in learned))
    # scores use the counts of all training folds
    scored = words.select("bucket", "tokens", "c").groupBy("bucket").cogroup(seen.groupBy("bucket")).applyInArrow(_tokens_scored(mixer), _SCORED)
    answers = asked.select("bucket", "block", "tokens").groupBy("bucket").cogroup(scored.groupBy("bucket")).applyInArrow(_answering, "block int, bucket int, c binary, log2 binary")
    return numbered.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scoring(n or 0, v or 0), _SCORES)


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
