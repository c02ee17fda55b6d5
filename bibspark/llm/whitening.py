"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become integers x = floor(64 * c) + 1,000,000; the *fit list* is every
distinct x vector once. The leading eigenvectors of its covariance V are found
without forming V: a block Q of a few columns more than asked for is multiplied
by V in one pass over the fit list, each task adding up its own centred
Xc^T (Xc Q), a dimension x block matrix, whatever its number of rows.

A round applies a Chebyshev polynomial of V to Q (one pass a degree): scaled
so that the spectrum below the block's smallest Ritz value stays within [-1, 1]
while what lies above it grows, which damps the unwanted directions. Then QR,
one pass for V Q, and Rayleigh-Ritz in the block. The residuals |V q - e q| of
the wanted pairs certify the result: rounds go on until they are at rounding
level (at most ``CERTIFIED`` of the largest eigenvalue; below it, until a round
no longer halves them). If ``PATIENCE`` rounds don't certify (many equal or
nearly equal eigenvalues at the block's edge), the block is doubled, at most to
the dimension, where Rayleigh-Ritz is exact.

The driver sees a few dimension x block matrices, never rows. Every pass reads
the fit list written once to the shared folder.

Edge cases: rows whose vector is null or holds a null, NaN, infinite entry or
one beyond 1e17 (no long holds its x) are dropped, and so are vectors whose
length is not the most frequent one (of equal counts the longest; empty vectors
never count). Repeated rows each get their own result. Eigenvalues at rounding
level (a fit list of lower rank, of one vector) give no components: their
whitened values are undefined. Without any component, and for an empty table,
the result is empty. A deviation beyond a long is null. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, table

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Degree of the filter, columns of the block for each component asked for,
#: rounds before the block is doubled.
DEGREE, BLOCK, PATIENCE = 10, 2, 8
#: Largest residual, against the largest eigenvalue, of a certified pair, and
#: the eigenvalue below which there is no direction left.
CERTIFIED, NO_RANK = 1e-11, 1e-12
ROUNDING = 1e-14
_LIMIT = 1e17


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of x as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class Whitening:
    """n x-vectors with exact sums; unit directions (dimension x components)
    with their eigenvalues, all by falling eigenvalue."""

    dim: int
    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int
    residual: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centre(x, self.n, self.sums)


def _centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: whole parts in longs, then the fraction."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that count, entries as longs."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LIMIT)
    vec = F.col(vec_col).cast("array<double>")
    x = lambda c: (F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT)).cast("long")
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v"))
            .where(F.col("v").isNotNull() & F.forall("v", entry) & (F.size("v") > 0))
            .select("vec_id", F.transform("v", x).alias("x")))


def _passes(fit_list: DataFrame, make, columns: int) -> np.ndarray:
    """Sum over all tasks of the matrix that ``make`` returns for a batch's
    vectors, as rows (row number, columns)."""
    names = [f"y{j}" for j in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = make(b.column("x"))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], ["row", *names])

    parts = fit_list.select("x").mapInArrow(run, "row int, " + ", ".join(f"{n} double" for n in names))
    rows = parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).collect()
    out = np.zeros((1 + max((r["row"] for r in rows), default=-1), columns))
    for r in rows:
        out[r["row"]] = r[1:]
    return out


def _sums(fit_list: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Exact number of vectors and sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"), dim)
                safe = float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0**62
                own = x.sum(axis=0).tolist() if safe else x.astype(object).sum(axis=0).tolist()
                n, total = n + len(x), [a + int(o) for a, o in zip(total, own)]
        if n:
            from decimal import Decimal
            yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([Decimal(t) for t in [*total, n]], pa.decimal128(38, 0))], ["row", "total"])

    got = fit_list.select("x").mapInArrow(run, "row int, total decimal(38,0)").groupBy("row").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    by_row = {r["row"]: int(r["total"]) for r in got}
    return by_row.get(dim, 0), [by_row.get(k, 0) for k in range(dim)]


def _rayleigh_ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors, and V times the vectors."""
    b = q.T @ vq
    values, turn = np.linalg.eigh((b + b.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
        degree: int = DEGREE, block: int | None = None, seed: int = 1) -> Whitening:
    """The whitening of the table's distinct vectors."""
    spark = vectors.sparkSession
    own = integers(vectors, id_col, vec_col)
    widths = own.groupBy(F.size("x").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).limit(1).collect()
    dim = widths[0]["dim"] if widths else 0
    nothing = Whitening(dim, 0, [], np.zeros((dim, 0)), np.zeros(0), 0.0, 0.0, 0, 0.0)
    if not dim:
        return nothing
    path = scratch_path(spark, "whitening-fit")
    own.where(F.size("x") == dim).select("x").distinct().write.parquet(path)
    fit_list = spark.read.parquet(path)
    n, sums = _sums(fit_list, dim)

    def squares(column: pa.Array) -> np.ndarray:
        return np.array([[float((_centre(_matrix(column, dim), n, sums) ** 2).sum())]])

    trace = float(_passes(fit_list, squares, 1)[0, 0]) / n
    passes = 1

    def times(q: np.ndarray) -> np.ndarray:
        """V q, by one pass."""
        nonlocal passes
        passes += 1

        def make(column: pa.Array) -> np.ndarray:
            c = _centre(_matrix(column, dim), n, sums)
            return c.T @ (c @ q)

        return _passes(fit_list, make, q.shape[1]) / n

    rng = np.random.default_rng(seed)
    width = min(dim, block or max(BLOCK * components, components + 4))
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    values, q, vq = _rayleigh_ritz(q, times(q))
    last, rounds = np.inf, 0
    while trace > 0:
        wanted = min(components, dim)
        rank = int((values > NO_RANK * values[0]).sum())
        worst = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max()) / values[0]
        if worst <= ROUNDING or worst <= CERTIFIED and worst > last / 2 or width == dim and rounds:
            break
        last, rounds = worst, rounds + 1
        if rounds % PATIENCE == 0 and width < dim:
            width = min(dim, 2 * width)
            more = rng.standard_normal((dim, width - q.shape[1]))
            more -= q @ (q.T @ more)
            q = np.linalg.qr(np.concatenate([q, more], axis=1))[0]
            values, q, vq = _rayleigh_ritz(q, times(q))
            last = np.inf
            continue
        # the filter: [0, edge] goes to [-1, 1]; scaled to stay near 1 at the largest value
        half = max(values[-1], NO_RANK * values[0]) / 2
        s1 = s = half / (values[0] - half) if values[0] > 2 * half else 1.0
        before, now = q, (vq - half * q) * (s / half)
        for _ in range(degree - 1):
            s2 = 1 / (2 / s1 - s)
            before, now = now, (times(now) - half * now) * (2 * s2 / half) - before * (s * s2)
            s = s2
        q = np.linalg.qr(now)[0]
        values, q, vq = _rayleigh_ritz(q, times(q))
    if trace <= 0:
        return Whitening(dim, n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0, 0.0, passes, 0.0)
    keep = min(components, rank)
    directions, eigenvalues = q[:, :keep], values[:keep]
    directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), np.arange(keep)] < 0, -1.0, 1.0)
    scaled = directions / np.sqrt(eigenvalues)

    def products(column: pa.Array) -> np.ndarray:
        w = _centre(_matrix(column, dim), n, sums) @ scaled
        return np.concatenate([w.T @ w, w.sum(axis=0, keepdims=True)])

    gram = _passes(fit_list, products, keep) / n
    off = gram[:-1] - np.outer(gram[-1], gram[-1]) - np.eye(keep)
    return Whitening(dim, n, sums, directions, eigenvalues, trace, float(np.abs(off).max()), passes + 1, worst)


def transform(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, whitened (array of double, one entry a component), deviation
    (long): one row per row that counts and has the model's dimension."""
    n, sums, dim = model.n, model.sums, model.dim
    scaled = model.directions / np.sqrt(model.eigenvalues)

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2, exact; in longs where they can't overflow."""
        whole = np.array([s // n for s in sums], np.int64)
        rest = np.array([s % n for s in sums], np.int64)
        near = x - whole
        if (float(np.abs(near).max(initial=0)) + 1) ** 2 * float(n) ** 2 * dim < 2.0**62:
            d = near * n - rest
            return (d * d).sum(axis=1).tolist()
        exact = [sum((int(v) * n - s) ** 2 for v, s in zip(row, sums)) for row in x]
        return [d if d < 2**63 else None for d in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"), dim)
                w = _centre(x, n, sums) @ scaled
                flat = pa.FixedSizeListArray.from_arrays(pa.array(w.reshape(-1)), w.shape[1]).cast(pa.list_(pa.float64())) if w.shape[1] else pa.array([[]] * len(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), flat, pa.array(deviations(x), pa.int64())], ["vec_id", "whitened", "deviation"])

    rows = integers(vectors, id_col, vec_col).where(F.size("x") == (dim if n else -1))
    return rows.mapInArrow(run, "vec_id long, whitened array<double>, deviation long")


def _literal(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = fit(vectors)
    shares = _literal(model.eigenvalues / model.trace if model.trace else model.eigenvalues)
    return (transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
            .select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(shares, F.col("k") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error")))
