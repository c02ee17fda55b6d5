"""Toxicity score by a factorization machine over hashed terms.

Terms of a text are its lower-cased words and their first three, four and
five letters, each hashed to one of 2^22 places; a text is the set of its
places. The machine scores

    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>        over the places present,

so a pair of terms (an insult next to a group mention) can weigh more than
both alone, which additive weights cannot express.

Fit: a bounded sample of labelled rows (``MAX_POSITIVE`` + ``MAX_NEGATIVE``,
the smallest hashes of doc_id, training folds only) gives, by one
aggregation, the ``PLACES`` terms that separate the classes best and the
``COMMON`` terms of the most documents, whatever their classes; only these
reach the driver. There all pairs of them are counted, and the terms of pairs
that separate the classes better than both alone (``PAIRED`` at most) join
the first ``PLACES``; on these the machine is fitted by Adam with fixed seeds.
Scoring is one Arrow pass over all texts without any shuffle. Labels, lang,
source and doc_id are never inputs of a score.

Edge cases: null text counts as empty and scores as the machine's bias; null
labels are ignored, a row labelled twice counts with its larger label;
without a positive or a negative label every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from .common import fold_of, id_text, released, small, strings

#: Bounds of the labelled sample that the machine is fitted on.
MAX_POSITIVE, MAX_NEGATIVE = 4_000, 8_000
#: Hashed space, places kept by the fit, size of a term's vector.
SPACE_BITS, PLACES, RANK = 22, 1_024, 8
#: Terms by document frequency whose pairs are counted, terms taken for their
#: pairs, what a pair's z must have above its terms' (chance among 13 million
#: pairs stays below).
COMMON, PAIRED, EXCESS = 4_096, 512, 6.0
#: Words remembered per Python worker while scoring.
CACHE_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def places_of(word: str) -> list[int]:
    """The hashed places of one lower-case word."""
    terms = {word, *(f"{word[:k]}*" for k in (3, 4, 5) if len(word) >= k)}
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) & ((1 << SPACE_BITS) - 1) for t in terms]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class FactorizationMachine:
    """Weights over selected places; ``score`` takes lists of their indices."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = 30, batch: int = 256, rate: float = 0.02, decay: float = 1e-4) -> FactorizationMachine:
        rng = np.random.default_rng(7)
        n, d = x.shape
        p = {"w0": np.array(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))), "w": np.zeros(d), "v": rng.normal(0, 0.02, (d, rank))}
        m = {k: np.zeros_like(a) for k, a in p.items()}
        s = {k: np.zeros_like(a) for k, a in p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                rows = order[at:at + batch]
                xb = x[rows]
                sums = xb @ p["v"]
                z = p["w0"] + xb @ p["w"] + 0.5 * (sums ** 2 - xb @ (p["v"] ** 2)).sum(1)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                grad = {"w0": g.sum(), "w": xb.T @ g + decay * p["w"], "v": xb.T @ (g[:, None] * sums) - (xb.T @ g)[:, None] * p["v"] + decay * p["v"]}
                t += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    s[k] = 0.999 * s[k] + 0.001 * grad[k] ** 2
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
        return cls(float(p["w0"]), p["w"], p["v"])

    def score(self, active: list[int]) -> float:
        z = self.w0
        if active:
            v = self.v[active]
            z += self.w[active].sum() + 0.5 * ((v.sum(0) ** 2) - (v ** 2).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _places(rows: DataFrame, keep: dict[int, int] | None = None) -> DataFrame:
    """(y, places): the distinct hashed places of every text, or (packed) the
    indices of those in ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = [list({p for w in words_of(t) for p in places_of(w)}) for t in strings(b.column("text"))]
            if keep is not None:
                out = [np.array(sorted(keep[p] for p in row if p in keep), np.int32).tobytes() for row in out]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(out, pa.list_(pa.int32()) if keep is None else pa.binary())], ["y", "places"])

    return rows.select("y", "text").mapInArrow(released(run), "y int, places " + ("array<int>" if keep is None else "binary"))


def pair_terms(x: np.ndarray, y: np.ndarray, known: int) -> list[int]:
    """The columns from ``known`` on that belong to the pairs of columns whose
    joint presence separates the classes better than both alone."""
    pos, neg = (x[y == k] for k in (1, 0))
    n, scale = len(x), 1 / len(pos) + 1 / len(neg)

    def joint(rows: np.ndarray, own: slice) -> np.ndarray:
        """Rows that hold both columns, by blocks of rows (exact: below 2^24)."""
        blocks = (rows[k:k + 1024].astype(np.float32) for k in range(0, len(rows), 1024))
        return sum((b[:, own].T @ b for b in blocks), np.zeros((len(range(*own.indices(rows.shape[1]))), rows.shape[1]), np.float32))

    def z(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.abs(a / len(pos) - b / len(neg)) / np.sqrt((a + b + 1) / n * scale)

    single = z(pos.sum(0, dtype=np.float32), neg.sum(0, dtype=np.float32))
    pairs: list[tuple[float, int, int]] = []
    for at in range(0, x.shape[1], 512):
        own = slice(at, at + 512)
        excess = z(joint(pos, own), joint(neg, own)) - np.maximum(single[own][:, None], single)
        found = np.argwhere(excess > EXCESS)
        found = found[found[:, 0] + at < found[:, 1]]
        value = excess[found[:, 0], found[:, 1]]
        best = np.argsort(-value, kind="stable")[:20_000]
        pairs += zip((-value[best]).tolist(), (found[best, 0] + at).tolist(), found[best, 1].tolist())
    out: dict[int, None] = {}
    for _, a, b in sorted(pairs):
        new = {k for k in (a, b) if k >= known and k not in out}
        if len(out) + len(new) <= PAIRED:
            out.update(dict.fromkeys(sorted(new)))
    return sorted(out)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out_fold: int = 0) -> DataFrame:
    """(y, text) of the bounded sample: training folds, both classes."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != held_out_fold))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    return id_text(docs).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("y", "text")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out_fold: int = 0) -> tuple[dict[int, int], FactorizationMachine] | None:
    """({place: index}, machine), or None without both classes."""
    sample = training_rows(docs, labels, label_col, held_out_fold)
    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not pos or pos == n:
        return None
    neg = n - pos
    share = lambda y, k: F.sum(F.when(F.col("y") == y, 1).otherwise(0)) / F.lit(float(k))
    counts = _places(sample).select("y", F.explode("places").alias("place")).groupBy("place").agg(
        F.count(F.lit(1)).alias("df"), share(1, pos).alias("a"), share(0, neg).alias("b"))
    # difference of the class shares against its spread under one common share
    spread = F.sqrt((F.col("df") + 1) / F.lit(float(n)) * F.lit(1.0 / pos + 1.0 / neg))
    counts = cut_lineage(counts.where("df > 1").select("place", "df", (F.abs(F.col("a") - F.col("b")) / spread).alias("z")))
    best = [r.place for r in counts.orderBy(F.desc("z"), "place").limit(PLACES).collect()]
    common = [r.place for r in counts.orderBy(F.desc("df"), "place").limit(COMMON).collect()]
    keep = {p: i for i, p in enumerate(dict.fromkeys([*best, *common]))}
    rows = _places(sample, keep).collect()
    x = np.zeros((len(rows), max(1, len(keep))), np.uint8)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.places, np.int32)] = 1
    y = np.array([r.y for r in rows])
    chosen = [*range(max(1, len(best))), *pair_terms(x, y, len(best))]
    place = list(keep)
    keep = {place[k]: i for i, k in enumerate(chosen) if k < len(place)}
    x = x[:, chosen].astype(np.float32)
    order = np.lexsort((*x.T[:32], y))  # the same machine whatever order the rows came in
    return keep, FactorizationMachine.fit(x[order], y[order].astype(np.float32))


def _scores(model: tuple[dict[int, int], FactorizationMachine] | None):
    """A function from texts to scores with a bounded memory of words."""
    known: dict[str, tuple[int, ...]] = {}

    def run(texts: list[str]) -> list[float]:
        if model is None:
            return [0.0] * len(texts)
        keep, machine = model
        out = []
        for text in texts:
            words = words_of(text)
            for w in words.difference(known):
                known[w] = tuple(keep[p] for p in places_of(w) if p in keep)
            out.append(machine.score(sorted({i for w in words for i in known[w]})))
            if len(known) > CACHE_WORDS:
                known.clear()
        return out

    return run


def score(docs: DataFrame, model: tuple[dict[int, int], FactorizationMachine] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(model)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(strings(b.column("text"))), pa.float64())], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(released(run), "doc_id long, score double")


def without_toxic(docs: DataFrame, model: tuple[dict[int, int], FactorizationMachine] | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, all columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(model)
        for b in small(batches):
            yield b.filter(pa.array([s < threshold for s in scores(strings(b.column(at)))], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
