"""Byte-level BPE encoding and decoding with the tokenizers library.

A rank file (base64 token, rank per line) is turned into a library model:
every byte is mapped to one printable character, every way to cut a token
into two tokens becomes a merge, ordered by the token's rank. Texts pass as
Arrow batches. A text is cut into chunks at white space, in a way that never
cuts one of the pattern's matches; chunks seen for the first time go through
the library (pattern split, byte mapping, merges) in one call per batch, and
a bounded per-worker table remembers their ids. ``encode`` returns the ids
with their code-point offsets, from the bytes of the ids.

Decoding looks every id up in the reversed byte table and joins the bytes
first, so characters that are split over several tokens come back whole.

Edge cases: null text counts as empty (no tokens, hashes of the empty
string); special-token strings are ordinary text; very long chunks are
encoded whole but not remembered.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table
from .common import id_text, release, resident, strings

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Chunks in each of the two remembered generations of a Python worker, and
#: the longest chunk remembered.
CACHE_CHUNKS = 200_000
CACHE_LENGTH = 64
#: Unicode white space, as the pattern's \s has it.
_WS = r"\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """One printable character per byte: printable Latin-1 stands for
    itself, the other bytes take the code points from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by the rule itself: join the leftmost adjacent pair of
    lowest rank until no pair is a token. Pairs wait in a heap by rank and
    place, parts are linked to their neighbours: n log n for long runs."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here; 0: no part begins here
    before = list(range(-1, n - 1))

    def pair(i: int) -> tuple[int, int, int] | None:
        j = end[i]
        rank = ranks.get(piece[i:end[j]]) if j < n else None
        return None if rank is None else (rank, i, end[j])

    waiting = [p for p in map(pair, range(n - 1)) if p]
    heapq.heapify(waiting)
    while waiting:
        _, i, stop = heapq.heappop(waiting)
        j = end[i]
        if j == 0 or j >= n or end[j] != stop:  # a part of the pair has changed
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(waiting, p)
    return [ranks[piece[i:end[i]]] for i in range(n) if end[i]]


class Codec:
    """Encoder and decoder for one vocabulary file (one per worker process)."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        chars = byte_characters()
        spell = lambda token: "".join(chars[b] for b in token)
        merges, unordered = [], []
        for token in sorted(self.ranks, key=self.ranks.get):
            n = len(token)
            cuts = [i for i in range(1, n) if token[:i] in self.ranks and token[i:] in self.ranks]
            # Two cuts i and n-i of one token can compete for the middle part; the leftmost pair must win.
            after = {i for i in cuts if n - i in cuts and i != n - i and token[n - i:] == token[:i] and token[i:] != token[:n - i]}
            unordered += [token for i in cuts if 2 * i != n and n - i in cuts and token[i:] == token[:n - i] and token[n - i:] == token[:i]]
            first = [i for i in cuts if n - i in cuts and token[i:] == token[:n - i]]
            merges += [(spell(token[:i]), spell(token[i:])) for i in first + [i for i in cuts if i not in first and i not in after] + [i for i in cuts if i in after and i not in first]]
        #: Tokens whose cuts can't be ordered: pieces holding one are merged by the rule itself.
        self.unordered = re.compile(b"|".join(re.escape(t) for t in dict.fromkeys(unordered)) or b"(?!)")
        self.tokenizer = Tokenizer(models.BPE(vocab={spell(t): i for t, i in self.ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pieces = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        reverse = {c: b for b, c in enumerate(chars)}
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = bytes(reverse[c] for c in token)
        self.digits = [str(i) for i in range(size)]
        #: chunk -> (number of ids, their decimal digits joined by commas, the
        #: bytes they decode to); chunks used lately, and those of the turn before
        self.young: dict[str, tuple[int, str, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes]] = {}

    def _learn(self, chunks: list[str]) -> dict[str, tuple[int, str, bytes]]:
        out: dict[str, tuple[int, ...]] = {}
        plain = []
        for c in chunks:
            if self.unordered.search(c.encode("utf-8", "surrogatepass")):
                out[c] = tuple(i for m in self.pieces.findall(c) for i in merge_by_rank(m.encode("utf-8", "surrogatepass"), self.ranks))
            else:
                plain.append(c)
        if plain:
            coded = self.tokenizer.encode(plain, is_pretokenized=True, add_special_tokens=False)
            ids = coded.ids
            ends = np.bincount(np.array(coded.word_ids), minlength=len(plain)).cumsum().tolist()
            out |= {c: tuple(ids[a:b]) for c, a, b in zip(plain, [0, *ends], ends)}
        return {c: (len(i), ",".join(map(self.digits.__getitem__, i)), b"".join(map(self.bytes_of.__getitem__, i))) for c, i in out.items()}

    def code_chunks(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """What is known of every chunk of every text, in order."""
        cut = [_CHUNK.findall(t) for t in texts]
        known = self.young
        missing = set().union(*cut).difference(known)
        known.update((c, self.old[c]) for c in missing.intersection(self.old))
        missing.difference_update(known)
        new = self._learn(list(missing)) if missing else {}
        known.update(new)
        coded = [list(map(known.__getitem__, chunks)) for chunks in cut]
        for c in new:
            if len(c) > CACHE_LENGTH:
                del known[c]
        if len(known) > CACHE_CHUNKS:
            self.old, self.young = known, {}
        return coded

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for c in chunks for i in c[1].split(",")] for chunks in self.code_chunks(texts)]

    def decode(self, ids: list[int] | tuple[int, ...]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Code-point span of every token of the text."""
        starts, ends = self.spans(text, self.encode_batch([text])[0])
        return list(zip(starts.tolist(), ends.tolist()))

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one code point that every id of the text's has
        bytes of (as the library's offsets), from the reversed byte table."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        point = np.cumsum((raw & 0xC0) != 0x80) - 1
        sizes = np.fromiter((len(self.bytes_of[i]) for i in ids), np.int64, len(ids))
        ends = np.cumsum(sizes)
        return point[ends - sizes].astype(np.int32), (point[ends - 1] + 1).astype(np.int32)


def codec(path: str, pattern: str | None = None) -> Codec:
    """The worker's codec of a vocabulary file."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return resident(("codec", path, pattern), lambda: Codec(path, pattern))


#: Texts encoded together: enough to share one library call, bounded in bytes.
GROUP_BYTES = 2_000_000


def _groups(b: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for i, t in zip(b.column("doc_id").to_pylist(), strings(b.column("text"))):
        ids.append(i)
        texts.append(t)
        size += len(t)
        if size >= GROUP_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids, starts, ends (arrays of int): the token ids of every whole
    text and the code-point span of each."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for ids, texts in _groups(b):
                coded = own.encode_batch(texts)
                spans = [own.spans(t, i) for t, i in zip(texts, coded)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in (coded, [s for s, _ in spans], [e for _, e in spans]))], ["doc_id", "ids", "starts", "ends"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, raw binary: the bytes of every id list (null list: empty)."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([own.decode(i or []) for i in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "raw"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, raw binary")


_HASHES = ["n_tokens", "ids_sha256", "decoded_sha256"]


def _hashes(own: Codec, texts: list[str]) -> list[pa.Array]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    coded = own.code_chunks(texts)
    return [pa.array([sum(map(itemgetter(0), chunks)) for chunks in coded], pa.int64()),
            pa.array([sha(",".join(map(itemgetter(1), chunks)).encode()) for chunks in coded], pa.string()),
            pa.array([sha(b"".join(map(itemgetter(2), chunks))) for chunks in coded], pa.string())]


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns of docs with n_tokens, ids_sha256, decoded_sha256 (columns
    of these names are replaced): encode and decode in one pass, so the id
    lists never leave the task."""
    path = path or vocabulary_path()
    docs = docs.drop(*_HASHES)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            texts, a = strings(b.column(at)), 0
            while a < len(texts):
                z, size = a, 0
                while z < len(texts) and size < GROUP_BYTES:
                    size += len(texts[z])
                    z += 1
                yield pa.RecordBatch.from_arrays([*b.slice(a, z - a).columns, *_hashes(own, texts[a:z])], [*b.schema.names, *_HASHES])
                a = z
        release()

    schema = T.StructType([*docs.schema.fields, T.StructField(_HASHES[0], T.LongType()), *[T.StructField(h, T.StringType()) for h in _HASHES[1:]]])
    return docs.mapInArrow(run, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(id_text(table(spark, sf_dir, "documents"))).drop("text")
