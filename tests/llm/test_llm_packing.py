"""Packing: every id in exactly one piece, bins of a fixed count, little padding."""
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from bibspark.llm import packing

SCHEMA = "doc_id long, text string, kind string, at string, seq string, ids string, length string"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(packing.vocabulary_path())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], SCHEMA).repartition(parts)


def texts(n=120):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñß ") for _ in range(rng.randrange(1, 9)))
    rows = [(k, " ".join(word() for _ in range(rng.randrange(900)))) for k in range(n)]
    odd = [None, "", " ", "don't  can't\n\n  x²3 b", "<|endoftext|> a", "日本語テキスト。", "a" * 5000, "tail \n", "x,y;z 'll it's"]
    return rows + [(1000 + k, t) for k, t in enumerate(odd)] + [(5, rows[5][1]), (5, "another text of the same id"), (None, "no id"), (None, "no id")]


def test_every_id_in_one_piece(spark, plain):
    rows = texts()
    got = packing.pack(frame(spark, rows)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.text_key].append(r)
        by_seq[r.sequence_id].append(r)
    for r in got:
        assert r.length > 0
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(plain(t))
    for (i, _), mine in by_doc.items():
        n = mine[0].doc_tokens
        same = [w for w in want[i] if len(w) == n]
        copies = sum(r.length for r in mine) // n  # repeated rows are documents of their own
        assert copies * n == sum(r.length for r in mine)
        for w in [next(w for w in same if all(zlib.crc32(np.array(w[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in mine))]:
            covered = np.zeros(n, int)
            for r in mine:
                covered[r.start:r.start + r.length] += 1
            assert (covered == copies).all() and len(w) == n
    assert sum(r.length for r in got) == sum(len(w) for ws in want.values() for w in ws)
    padding = 0
    for mine in by_seq.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert padding <= 0.01 * sum(r.length for r in got)


def test_sequences_hold_the_ids(spark, plain):
    rows = [(i, t) for i, t in texts(40) if i != 5]
    docs = frame(spark, rows)
    packed = packing.pack(docs).cache()
    seqs = {r.sequence_id: r.ids for r in packing.sequences(docs, packed).collect()}
    ids = {i: plain(t) for i, t in rows}
    for r in packed.collect():
        assert seqs[r.sequence_id][r.offset:r.offset + r.length] == ids[r.doc_id][r.start:r.start + r.length]
    assert sum(map(len, seqs.values())) == sum(len(plain(t)) for _, t in rows)


def test_bins_of_a_class_hold_a_fixed_count(spark):
    rows = [(k, "word " * 330) for k in range(100)]  # class 6 of 2048: 331 ids
    got = packing.pack(frame(spark, rows, parts=4), cut_cost=float("inf")).collect()
    count = defaultdict(int)
    for r in got:
        count[r.sequence_id] += 1
    assert sorted(count.values())[-16:] == [6] * 16  # 16 whole bins; four documents are laid end to end
    assert sum(count.values()) == len(got) and sum(r.length for r in got) == 100 * 332


@pytest.mark.parametrize("cut_cost", [0.0, 8.0, float("inf")])
def test_recipe(cut_cost):
    first = packing.recipe(256, cut_cost)
    for n in range(1, 2000, 7):
        pieces = packing.pieces_of(n, 256, first)
        assert sum(pieces) == n and pieces[:n // 256] == [256] * (n // 256)
        if cut_cost == 0:
            assert all(p & (p - 1) == 0 for p in pieces)
        if cut_cost == float("inf"):
            assert len(pieces) == -(-n // 256)


def test_empty_and_small_tables(spark, plain):
    assert packing.pack(frame(spark, [], 1)).count() == 0
    got = packing.pack(frame(spark, [(1, None)], 1)).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in got] == [(1, 0, 1, 1, 0)]
    assert got[0].ids_crc32 == zlib.crc32(np.array([packing.END_ID], "<u4").tobytes())


def test_long_text_in_parts(plain, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_CHARS", 500)
    monkeypatch.setattr(packing, "CHUNKS_AT_ONCE", 7)
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 20)
    own = packing.Encoder(packing.vocabulary_path())
    for _, t in texts(30):
        assert np.frombuffer(own([t or ""])[0], "<u4").tolist() == plain(t)[:-1]
