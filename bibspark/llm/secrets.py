"""Secret scan: base patterns plus a linear-chain conditional random field.

Base spans are the leftmost non-overlapping matches of three patterns on the
whole text. The random field tags every token (a run of ``[A-Za-z0-9_+/-]``)
as B(egin), I(nside) or O(utside) of a secret. Its features: the token's
shape (character classes with length), the gap before it, the shapes of both
neighbours, whether the word before is a credential word, and two features
of the whole text (share of tokens with digits, length). Tags come from
Viterbi decoding; spans the base patterns miss are added, base spans stay.

Fit: the labels are the base spans of a bounded sample (``SAMPLE_DOCS`` rows
of the smallest hashes, ``MAX_WINDOWS`` windows of ``WINDOW`` tokens), by
maximum likelihood (forward-backward, Adam, fixed seed) on the driver.

Decoding is exact and cheap: emission scores of all tokens of a batch are
array sums. A token whose O score leads by more than any change of its two
transitions can give back is O on the best path, so the chain is cut there
and dynamic programming runs on the short stretches in between.

One Arrow pass over the texts, no shuffle. Null text counts as empty (no
spans, hash of the empty string); offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import id_text, strings

#: Bounds of the sample that the field is fitted on.
SAMPLE_DOCS, MAX_WINDOWS, WINDOW = 6_000, 8_000, 24
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Words without which the assign pattern can't match (tested before it).
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_CREDENTIAL = (b"passw", b"secret", b"token", b"key", b"auth", b"bearer", b"credential", b"pwd", b"cert")

# Character classes as bits; 0 marks what separates tokens.
_CLASS = np.zeros(256, np.uint8)
for _bit, _chars in enumerate((b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"_+/-")):
    _CLASS[list(_chars)] = 1 << _bit
_CLASS[128:] = 1 << 1  # bytes of other letters count as ordinary ones
_GAP = np.zeros(256, np.uint8)
_GAP[np.flatnonzero(_CLASS == 0)] = 16
for _bit, _chars in enumerate((b" \t", b"\n\r\x0b\x0c", b":=", b"\"'")):
    _GAP[list(_chars)] = 1 << _bit
_LENGTHS = np.array([1, 8, 12, 16, 20, 32, 64])
# Feature groups: sizes and offsets in one weight table.
_GROUPS = {"shape": 64 * 8, "gap": 32, "before": 64 * 2, "after": 64 * 2, "text": 16, "word": 2}
_OFFSET = dict(zip(_GROUPS, np.cumsum([0, *_GROUPS.values()])))
_SIZE = sum(_GROUPS.values())
_STATES = 3  # O, B, I


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, sorted."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Tokens:
    """Tokens of many texts at once: byte ranges in one buffer and features."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join([*texts, b""])
        raw = np.frombuffer(self.buffer, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.text_end = np.cumsum(sizes)
        bits = _CLASS[raw]
        edge = np.diff((bits > 0).view(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        n = len(self.start)
        self.end = np.flatnonzero(edge == -1)[:n]  # the buffer ends with a separator
        self.text = np.searchsorted(self.text_end, self.start, side="right")
        if not n:
            self.features = np.zeros((0, len(_GROUPS)), np.int32)
            return
        classes = np.bitwise_or.reduceat(bits, self.start).astype(np.int32)
        gap_after = np.bitwise_or.reduceat(_GAP[raw], self.start).astype(np.int32)
        length = self.end - self.start
        shape = classes * 8 + np.searchsorted(_LENGTHS, length, side="right")
        side = classes * 2 + (length >= 12)
        first = np.diff(self.text, prepend=-1) != 0
        last = np.append(first[1:], True)
        gap = np.where(first, 0, np.roll(gap_after, 1))
        before = np.where(first, 0, np.roll(side, 1))
        after = np.where(last, 0, np.roll(side, -1))
        per_text = np.bincount(self.text, minlength=len(texts))
        digits = np.bincount(self.text, weights=(classes & 16) > 0, minlength=len(texts))
        share = np.searchsorted([0.001, 0.02, 0.2], digits / np.maximum(per_text, 1), side="right")
        whole = (share * 4 + np.searchsorted([50, 500, 5000], per_text, side="right")).astype(np.int32)
        word = np.where(first, 0, np.roll(self._credential(), 1))
        groups = {"shape": shape, "gap": gap, "before": before, "after": after, "text": whole[self.text], "word": word}
        self.features = np.stack([v + _OFFSET[k] for k, v in groups.items()], 1).astype(np.int32)

    def _credential(self) -> np.ndarray:
        """1 for every token that holds a credential word."""
        out = np.zeros(len(self.start), np.int32)
        low = self.buffer.lower()
        for word in _CREDENTIAL:
            at = low.find(word)
            hits = []
            while at >= 0:
                hits.append(at)
                at = low.find(word, at + 1)
            out[np.searchsorted(self.start, hits, side="right") - 1] = 1
        return out


class ChainField:
    """Weights of the random field: emissions (features x states) and
    transitions (states x states)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, epochs: int = 24, batch: int = 128, rate: float = 0.05, decay: float = 1e-4) -> ChainField:
        """x: windows x tokens x features (-1 pads a window), y: states."""
        rng = np.random.default_rng(11)
        emit, move = np.zeros((_SIZE + 1, _STATES)), np.zeros((_STATES, _STATES))
        ms = [np.zeros_like(emit), np.zeros_like(move)]
        vs = [np.zeros_like(emit), np.zeros_like(move)]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at:at + batch]
                grads = _gradient(emit, move, x[rows], y[rows])
                t += 1
                for p, g, m, v in zip((emit, move), grads, ms, vs):
                    g += decay * p
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
                emit[_SIZE] = 0  # the place of padding
        return cls(emit[:_SIZE].copy(), move)

    def viterbi(self, scores: np.ndarray, left: bool, right: bool) -> list[int]:
        """Best states of a stretch; left/right: an O token lies beside it."""
        move = self.move
        best = scores[0] + (move[0] if left else 0)
        back = []
        for s in scores[1:]:
            paths = best[:, None] + move
            back.append(paths.argmax(0))
            best = paths.max(0) + s
        if right:
            best = best + move[:, 0]
        state = int(best.argmax())
        out = [state]
        for b in reversed(back):
            state = int(b[state])
            out.append(state)
        return out[::-1]

    def tag(self, tokens: Tokens) -> np.ndarray:
        """State of every token: the best path of every text."""
        n = len(tokens.start)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        scores = self.emit[tokens.features[:, 0]]
        for k in range(1, tokens.features.shape[1]):
            scores += self.emit[tokens.features[:, k]]
        # the most that state x in place of O can gain in both transitions (nothing at an end)
        gain = [max(0, (self.move[:, x] - self.move[:, 0]).max()) + max(0, (self.move[x] - self.move[0]).max()) for x in range(_STATES)]
        rest = np.flatnonzero((scores[:, 0] - scores[:, 1] <= gain[1]) | (scores[:, 0] - scores[:, 2] <= gain[2]))
        if not len(rest):
            return out
        cuts = np.flatnonzero((np.diff(rest) != 1) | (np.diff(tokens.text[rest]) != 0)) + 1
        for part in np.split(rest, cuts):
            a, b = int(part[0]), int(part[-1])
            own = tokens.text[a]
            out[a:b + 1] = self.viterbi(scores[a:b + 1], a > 0 and tokens.text[a - 1] == own, b + 1 < n and tokens.text[b + 1] == own)
        return out


def _gradient(emit: np.ndarray, move: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the negative log-likelihood per window, by forward-backward."""
    n, length, _ = x.shape
    idx = np.where(x < 0, _SIZE, x)
    scores = emit[idx].sum(2)
    there = (x[:, :, 0] >= 0)
    forward = np.zeros((n, length, _STATES))
    backward = np.zeros((n, length, _STATES))
    lse = lambda a, axis: np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis)) + a.max(axis)
    forward[:, 0] = scores[:, 0]
    for t in range(1, length):
        step = lse(forward[:, t - 1, :, None] + move, 1) + scores[:, t]
        forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = lse(move + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(there[:, t + 1, None], step, 0)
    total = lse(forward[:, -1], 1)
    g_state = np.exp(forward + backward - total[:, None, None])
    truth = np.eye(_STATES)[y]
    diff = np.where(there[..., None], g_state - truth, 0) / n
    g_emit = np.stack([np.bincount(idx.reshape(-1), weights=np.repeat(diff[..., s].reshape(-1), idx.shape[2]), minlength=_SIZE + 1) for s in range(_STATES)], 1)
    g_move = np.zeros_like(move)
    for t in range(1, length):
        pair = np.exp(forward[:, t - 1, :, None] + move + (scores[:, t] + backward[:, t])[:, None, :] - total[:, None, None])
        pair -= truth[:, t - 1, :, None] * truth[:, t, None, :]
        g_move += (pair * there[:, t, None, None]).sum(0) / n
    return [g_emit, g_move]


def _labelled_windows(texts: list[str]) -> Iterator[tuple[list[list[int]], list[int]]]:
    """Windows around the base spans, and two per text elsewhere."""
    for text in texts:
        tokens = Tokens([text.encode("utf-8", "surrogatepass")])
        n = len(tokens.start)
        if not n:
            continue
        state = np.zeros(n, np.int64)
        centres = []
        for a, kind, b in base_spans(text):
            if kind == 0:  # the value, not the word that announces it
                a = _ASSIGN.match(text, a).start(2)
            a, b = len(text[:a].encode("utf-8", "surrogatepass")), len(text[:b].encode("utf-8", "surrogatepass"))
            inside = np.flatnonzero((tokens.end > a) & (tokens.start < b))
            if len(inside):
                state[inside] = 2
                state[inside[0]] = 1
                centres.append(int(inside[0]))
        for c in [*centres, n // 3, 2 * n // 3]:
            a = max(0, min(c - WINDOW // 2, n - WINDOW))
            own = range(a, min(n, a + WINDOW))
            x = tokens.features[a:a + WINDOW].tolist()
            pad = WINDOW - len(x)
            yield x + [[-1] * len(_GROUPS)] * pad, state[own].tolist() + [0] * pad


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ChainField | None:
    rows = id_text(docs, id_col, text_col)
    picked = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(_labelled_windows(strings(b.column("text"))))
            flat = [[i for token in x for i in token] for x, _ in got]
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.list_(pa.int32())), pa.array([y for _, y in got], pa.list_(pa.int32()))], ["x", "y"])

    found = rows.join(F.broadcast(picked), "doc_id").select("text").mapInArrow(run, "x array<int>, y array<int>")
    windows = found.orderBy(F.array_max("y").desc(), F.xxhash64("x")).limit(MAX_WINDOWS).collect()
    if not windows:
        return None
    x = np.array([r.x for r in windows], np.int64).reshape(len(windows), WINDOW, len(_GROUPS))
    return ChainField.fit(x, np.array([r.y for r in windows]))


def added_spans(field: ChainField, texts: list[str]) -> list[list[tuple[int, int]]]:
    """Tagged spans of every text, in code points."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    tokens = Tokens(raw)
    states = field.tag(tokens)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    marked = np.flatnonzero(states)
    if len(marked):
        new = (states[marked] == 1) | (np.diff(marked, prepend=-2) != 1) | (np.diff(tokens.text[marked], prepend=-1) != 0)
        heads = np.flatnonzero(new)
        for h, nxt in zip(heads, [*heads[1:], len(marked)]):
            i, j = int(marked[h]), int(marked[nxt - 1])
            k = int(tokens.text[i])
            at = int(tokens.text_end[k]) - len(raw[k]) - 1
            a, b = int(tokens.start[i]) - at, int(tokens.end[j]) - at
            head = raw[k][:a].decode("utf-8", "surrogatepass")
            out[k].append((len(head), len(head) + len(raw[k][a:b].decode("utf-8", "surrogatepass"))))
    return out


#: Texts tagged together, in characters: bounds the arrays of a task.
_GROUP_CHARS = 2_000_000


def scan(docs: DataFrame, field: ChainField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), strings(b.column("text"))
            a = 0
            while a < len(texts):
                z, size = a, 0
                while z < len(texts) and size < _GROUP_CHARS:
                    size += len(texts[z])
                    z += 1
                group = texts[a:z]
                more = added_spans(field, group) if field is not None else [[] for _ in group]
                rows = []
                for text, extra in zip(group, more):
                    base = base_spans(text)
                    # a tagged span is added where no base span lies
                    own = base + [(s, 3, e) for s, e in extra if not any(s < q and p < e for p, _, q in base)]
                    rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(own)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:z], pa.int64()), pa.array(rows, kind)], ["doc_id", "spans"])
                a = z

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
