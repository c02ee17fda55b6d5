"""Lexical search against scoring every document of every item."""
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from bibspark.llm import lexical_search as search

DOCS = "doc_id long, text string, item_id string, score string, term string, item string, k string"
ITEMS = "item_id long, text string, doc_id string, bound string"
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(docs, items, best=10):
    words = lambda t: _TERM.findall((t or "").translate(_LOWER))
    coded = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    n, total = len(coded), sum(size for *_, size in coded)
    df = Counter(w for _, c, _ in coded for w in c)
    out = []
    for item_id, t in items:
        scored = []
        for i, c, size in coded:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in words(t) if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item_id, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(scored)[:best])]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def run(spark, docs, items, parts=3, best=10):
    d = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in docs], DOCS).repartition(parts)
    q = spark.createDataFrame([(i, t, "a", "b") for i, t in items], ITEMS).repartition(2)
    got = search.search(d, q, best)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return order(tuple(r) for r in got.collect())


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["ñandú", "日本", "Straße", "É"]
    pick = lambda: vocab[min(int(rng.expovariate(0.02)), len(vocab) - 1)]
    return rng, pick, [(k, " ".join(pick() for _ in range(rng.choice([1, 5, 40, 300])))) for k in range(n)]


def test_against_brute_force(spark):
    rng, pick, docs = corpus()
    docs += [(1000 + k, docs[7][1]) for k in range(40)] + [(1000, docs[7][1])]  # copies: the ten smallest ids count
    docs += [(2000, None), (2001, ""), (2002, "-- ++ \n"), (None, docs[9][1]), (9, docs[9][1]), (9, "another text of one id"), (2003, "W1_w2-W3 \x00w4\x7fw5")]
    items = [(k, " ".join(pick() for _ in range(rng.choice([1, 3, 25])))) for k in range(30)]
    items += [(50, None), (51, ""), (52, "unheard-of nothing"), (3, items[3][1]), (3, "w1 w1 w2"), (None, "w5 w7"), (53, docs[7][1] + " Straße É")]
    assert run(spark, docs, items) == order(brute(docs, items))
    assert run(spark, docs, items[:5], parts=1, best=3) == order(brute(docs, items[:5], 3))


def test_items_in_blocks_and_shuffled_candidates(spark, monkeypatch):
    rng, pick, docs = corpus(120, seed=6)
    items = [(k, " ".join(pick() for _ in range(20))) for k in range(12)]
    monkeypatch.setattr(search, "BLOCK_TERMS", 40)
    monkeypatch.setattr(search, "BROADCAST_PAIRS", 0)
    assert run(spark, docs, items) == order(brute(docs, items))


def test_long_texts_and_many_occurrences(spark):
    rng = random.Random(8)
    docs = [(1, "a " * 70_000 + "b"), (2, " ".join(f"t{rng.randrange(60_000)}" for _ in range(80_000))), (3, "a b c"), (4, "b " * 500 + "t5 t6"), (5, "x" * 300_000)]
    docs += [(10 + k, "a b " * k + "t7") for k in range(1, 40)]
    items = [(1, "a b"), (2, "t5 t6 t7 t8"), (3, "x" * 300_000)]
    assert run(spark, docs, items) == order(brute(docs, items))


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_empty(spark, docs, items):
    assert run(spark, docs, items, parts=1) == []


def test_bounds_never_underestimate_and_exclude(spark):
    """Signatures: the bound of every document reaches its exact score, and few others are scored."""
    rng, pick, docs = corpus(500, seed=11)
    rows = [{"item": 0, "term": w.encode(), "times": 1, "weight": 100} for w in ("w1", "w40", "w250")]
    words = [search.terms((t or "").encode()) for _, t in docs]
    query = search._Query(rows, len(docs), sum(map(len, words)))
    keys = [Counter(w) for w in words]
    width = 4096
    block = search._Block(width)
    for (i, _), c, w in zip(docs, keys, words):
        own = list(c)
        level = [k for n in c.values() for k in range(int(np.searchsorted(search.LEVELS, n, side="right")))]
        reached = [int(np.searchsorted(search.LEVELS, n, side="right")) for n in c.values()]
        block.add((i, 0, b"0" * 16, len(w)), search._probes(np.repeat(search._hashes(own), reached), np.array(level), width).ravel())
    sizes = np.array([len(w) for w in words])
    bounds = query.bounds(width, sizes, block.slices[:, :-(-len(docs) // 8)].ravel())[0]
    m = query.damping(sizes)
    exact = np.array([sum(100 * (search.SCALE * c[t] // (1000 * c[t] + search.SATURATION * int(x))) for t in (b"w1", b"w40", b"w250") if c[t]) for c, x in zip(keys, m)])
    assert (bounds >= exact).all()
    assert (bounds == exact).mean() > 0.8
