"""Exact dedup, near dedup, repeated substrings: against brute force."""
import hashlib
import random
import re
from collections import Counter

import pytest

from bibspark.llm import exact_dedup, jaccard_join, suffix_dedup
from tests_llm_brute import brute_exact, brute_join

SCHEMA = "doc_id long, text string, digest string, n string, block string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


# ------------------------------------------------------------------ op3
@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_dedup(spark, counters):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a b", "ab", "a  b\n", "c", "", None, " ", "é x", "éx", f"own {k}"])) for k in range(200)]
    rows += [(7, "a b"), (7, "a b"), (None, "c"), (None, None)]
    got = exact_dedup.exact_dedup(frame(spark, rows), counters=counters).collect()
    want, norm = brute_exact(rows)
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by_hash[r.text_sha256]
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter(by_hash.keys())  # one row of every group, repeated rows too


def test_exact_dedup_filter_and_empty(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "abc "), (3, None), (4, ""), (5, "other"), (5, "a bc")]
    out = exact_dedup.without_copies(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "digest", "n", "block"]
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "a b c"), (3, ""), (5, "other")]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_misra_gries_keeps_every_frequent_key(spark):
    rng = random.Random(2)
    keys = ["hot"] * 300 + ["warm"] * 120 + [f"k{rng.randrange(5000)}" for _ in range(500)]
    rng.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    got = {r.key: r.n for r in exact_dedup.misra_gries(df, "k", 9).collect()}
    assert len(got) <= 9 and {"hot", "warm"} <= set(got)
    true = Counter(keys)
    assert all(n <= true[k] for k, n in got.items())


# ------------------------------------------------------------------ op2
def near_copies(rng):
    rows = []
    for g in range(12):
        base = words(rng, rng.choice([4, 6, 30, 80])).split()
        for _ in range(rng.choice([1, 3, 9])):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(50)}"
            rows.append((len(rows), rng.choice([" ".join, "\n".join])(own) if g % 4 else " ".join(own).upper()))
    # a passage that many otherwise different texts share
    passage = words(rng, 25)
    rows += [(len(rows) + k, words(rng, rng.choice([5, 30]), 10_000) + " " + passage) for k in range(25)]
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "one"), (n + 5, "ONE two"), (n + 6, rows[0][1]), (n + 6, rows[0][1])]
    return rows


@pytest.mark.parametrize("block", [4, 512])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies(random.Random(block))
    got = jaccard_join.jaccard_join(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == brute_join(rows)


def test_jaccard_filter_and_empty(spark):
    rows = near_copies(random.Random(5))
    kept = jaccard_join.one_per_group(frame(spark, rows)).collect()
    want = {c for _, n, c, _ in brute_join(rows) if n} | {i for i, n, _, _ in brute_join(rows) if not n}
    assert sorted(r.doc_id for r in kept) == sorted(want)
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0


# ------------------------------------------------------------------ op4
def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[s:s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s:s + length]] > 1:
                gone[s:s + length] = b"\x01" * length
        runs = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [0, 2000])
def test_repeated_spans(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(hot)
    passage, line = words(rng, 120), "é" * 150
    rows = [(k, words(rng, 60, 10_000) + passage[rng.randrange(200):rng.randrange(300, 500)] + words(rng, 60, 10_000)) for k in range(30)]
    rows += [(100, passage + passage), (101, "a" * 1000), (102, line + line), (103, None), (104, ""), (105, "short"), (106, rows[0][1]), (106, rows[0][1]), (None, passage)]
    got = suffix_dedup.repeated_spans(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in got), key=str) == brute_repeats(rows, 200)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = random.Random(9)
    part = words(rng, 300)
    rows = [(1, words(rng, 900, 10_000) + part + words(rng, 400, 10_000)), (2, part[37:] + words(rng, 500, 10_000))]
    cut = list(suffix_dedup.stretches([t.encode() for _, t in rows]))
    for k, (_, t) in enumerate(rows):  # every window start belongs to one stretch
        starts = [s + j for i, s, c, _ in cut if i == k for j in range(c)]
        assert sorted(starts) == list(range(len(t.encode()) - suffix_dedup.LENGTH + 1))


def test_maximal_repeats_with_all_occurrences():
    texts = [b"xabcdy", b"zabcdw", b"qabcp"]
    array = suffix_dedup.SuffixArray(texts, [len(t) for t in texts])
    found = {(n, tuple(sorted((int(array.owner[k]), int(array.within[k])) for k in range(a, b + 1)))) for n, a, b in array.maximal_repeats(2)}
    assert found == {(4, ((0, 1), (1, 1))), (3, ((0, 1), (1, 1), (2, 1)))}


def test_repeated_spans_empty(spark):
    assert suffix_dedup.repeated_spans(frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [1, 4])
def test_a_passage_in_many_contexts(spark, monkeypatch, hot):
    """Hot grams: some contexts share more bytes on one side, some windows only a part of the passage."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(21)
    passage = words(rng, 60, 10_000)
    edge = words(rng, 12, 10_000)
    rows = []
    for k in range(60):
        left, right = words(rng, 30, 10_000), words(rng, 30, 10_000)
        rows.append((k, f"{left} {edge if k % 3 == 0 else ''}{passage}{edge if k % 4 == 0 else ''} {right}"))
    rows += [(100, passage[:210]), (101, passage[50:249]), (102, passage + passage), (103, passage[-201:] + "x")]
    got = suffix_dedup.repeated_spans(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in got), key=str) == brute_repeats(rows, 200)


def test_grams_stay_whole_beside_hot_ones(spark, monkeypatch):
    """A hot gram makes the others pass a join with few rows, which Spark turns
    into a broadcast: every gram still comes to one task."""
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    rng = random.Random(23)
    passage = words(rng, 60, 10_000)
    rows = [(k, f"{words(rng, 30, 10_000)} {passage} {words(rng, 30, 10_000)}") for k in range(40)]
    for k in range(100, 140):
        own = words(rng, 50, 10_000)
        rows += [(2 * k, f"{own} {words(rng, 40, 10_000)}"), (2 * k + 1, f"{words(rng, 40, 10_000)} {own}")]
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        got = suffix_dedup.repeated_spans(frame(spark, rows)).collect()
    finally:
        spark.conf.set(conf, before)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in got), key=str) == brute_repeats(rows, 200)


def test_halves_keep_every_window_once():
    """Cut again and again, the stretches of one gram give each window one place, under a key that it holds."""
    import pyarrow as pa
    rng = random.Random(22)
    text = words(rng, 120, 10_000).encode()
    names = ["gram", "whole", "off", "starts", "text", "lo", "hi", "n"]
    level = [(1, k, 0, c, text[s:s + c + suffix_dedup.LENGTH - 1], -1, -1, 1) for k, (_, s, c, _) in enumerate(suffix_dedup.stretches([text]))]
    sizes = {k: r[3] for k, r in enumerate(level)}
    texts = {r[1]: r[4] for r in level}
    for _ in range(9):
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "text" else pa.int64()) for n, c in zip(names, zip(*level))], names)
        out = [r for b in suffix_dedup._halves(iter([batch])) for r in b.to_pylist()]
        seen = sorted((r["whole"], r["off"] + j) for r in out for j in range(r["starts"]))
        assert seen == [(k, j) for k in sorted(sizes) for j in range(sizes[k])]
        for r in out:
            assert r["text"] == texts[r["whole"]][r["off"]:r["off"] + r["starts"] - 1 + suffix_dedup.LENGTH]
            assert 0 <= r["lo"] and r["starts"] - 1 <= r["lo"] and r["hi"] <= suffix_dedup.LENGTH  # in every window
        if all(r["hi"] - r["lo"] == suffix_dedup.LENGTH for r in out):
            assert all(r["starts"] == 1 for r in out)
            return
        level = [tuple(r[n] for n in names) for r in out if r["hi"] - r["lo"] < suffix_dedup.LENGTH]
        done = [r for r in out if r["hi"] - r["lo"] == suffix_dedup.LENGTH]
        for r in done:  # finished windows leave
            sizes[r["whole"]] = sizes.get(r["whole"])
        if done:
            left = {(r[1], r[2] + j) for r in level for j in range(r[3])}
            break
    assert len(left) + len(done) <= sum(sizes.values())
