"""Whitening against a plain eigendecomposition of the covariance."""
import math
from collections import Counter

import numpy as np
import pytest

from bibspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, v string, n string, whitened string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], SCHEMA).repartition(parts)


def brute(rows):
    """(rows that count, fit list, eigenvalues, eigenvectors)."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) and abs(c) < 1e17 for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=float)
    c = fit - fit.mean(axis=0)
    e, q = np.linalg.eigh(c.T @ c / len(fit))
    return good, fit, e[::-1], q[:, ::-1]


def cloud(n, d, seed=3, spread=0.9):
    rng = np.random.default_rng(seed)
    return [(k, (rng.standard_normal(d) * spread ** np.arange(d)).astype(np.float32).tolist()) for k in range(n)]


def compare(spark, rows, parts=3, **options):
    good, fit, e, q = brute(rows)
    model = whitening.fit(frame(spark, rows, parts), **options)
    k = len(model.eigenvalues)
    assert model.n == len(fit) and model.sums == [int(s) for s in fit.sum(axis=0)]
    np.testing.assert_allclose(model.eigenvalues, e[:k], rtol=1e-9)
    np.testing.assert_allclose(model.directions.T @ model.directions, np.eye(k), atol=1e-12)
    assert model.identity_error < 1e-9 and model.residual <= whitening.CERTIFIED
    got = whitening.transform(frame(spark, rows, parts), model).collect()
    assert Counter(r.vec_id for r in got) == Counter(i for i, _ in good)
    exact = Counter((i, sum((model.n * a - s) ** 2 for a, s in zip(x, model.sums))) for i, x in good)
    assert Counter((r.vec_id, r.deviation) for r in got) == exact
    return model, got, good, fit, e, q


def test_against_eigh(spark):
    rows = cloud(300, 40) + [(1000 + k, v) for k, v in cloud(300, 40)[:50]]  # copies count once in the fit list
    model, got, good, fit, e, q = compare(spark, rows)
    assert len(model.eigenvalues) == 16
    sign = np.sign((model.directions * q[:, :16]).sum(axis=0))
    want = {i: (np.array(x) - fit.mean(axis=0)) @ q[:, :16] * sign / np.sqrt(e[:16]) for i, x in good}
    for r in got:
        np.testing.assert_allclose(r.whitened, want[r.vec_id], atol=1e-7)
    np.testing.assert_allclose(model.trace, e.sum(), rtol=1e-12)


def test_flat_and_equal_spectra(spark):
    """Equal eigenvalues at the block's edge: any basis of them will do."""
    rows, d = [], 24
    for k in range(d):
        for s in (-1.0, 1.0):
            rows.append((len(rows), [s * 2 if j == k else 0.0 for j in range(d)]))
    model, *_ = compare(spark, rows, components=4, block=5)
    assert len(model.eigenvalues) == 4
    compare(spark, cloud(400, 30, spread=1.0), components=4, block=6)


def test_low_rank_small_and_degenerate(spark):
    base = cloud(3, 20, seed=9)
    model, got, *_ = compare(spark, base + base)
    assert len(model.eigenvalues) == 2 and len(got) == 6
    one = whitening.fit(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert one.n == 1 and len(one.eigenvalues) == 0
    assert [(r.whitened, r.deviation) for r in whitening.transform(frame(spark, [(1, [1.0, 2.0])]), one).collect()] == [([], 0)]
    compare(spark, cloud(50, 3))


def test_rows_that_do_not_count(spark):
    rows = cloud(60, 8) + [(100, None), (101, [1.0] * 7 + [None]), (102, [1.0] * 7 + [float("nan")]), (103, [float("inf")] + [0.0] * 7),
                           (104, [1e18] + [0.0] * 7), (105, []), (106, [1.0, 2.0]), (None, [0.5] * 8), (5, [0.25] * 8)]
    model, got, *_ = compare(spark, [r for r in rows if r[0] != 106])
    whole = whitening.fit(frame(spark, rows))
    assert whole.n == model.n and whole.sums == model.sums
    ids = [r.vec_id for r in whitening.transform(frame(spark, rows), whole).collect()]
    assert 106 not in ids and None in ids and ids.count(5) == 2


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(np.float32(v)) for v in x]) for k, x in enumerate([(1e15, 1.0), (-1e15, 2.0), (3e14, 5.0), (7e15, -1.0)])]
    model = whitening.fit(frame(spark, rows))
    _, fit, _, _ = brute(rows)
    exact = [sum(math.floor(64 * v[j]) + 1_000_000 for _, v in rows) for j in range(2)]
    assert model.sums == exact
    assert all(r.deviation is None for r in whitening.transform(frame(spark, rows), model).collect())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_empty(spark, rows):
    model = whitening.fit(frame(spark, rows, 1))
    assert model.n == 0 and whitening.transform(frame(spark, rows, 1), model).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = whitening.op13_whitening(spark, sf)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                          ("explained", "double"), ("identity_error", "double")]
    w = got.toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    good, fit, e, q = brute(rows)
    assert len(w) == 16 * len(good) and w.identity_error.nunique() == 1 and w.identity_error.iloc[0] < 1e-4
    shares = w.drop_duplicates("component").sort_values("component").explained.to_numpy()
    np.testing.assert_allclose(shares, e[:16] / e.sum(), rtol=1e-9)
