"""Dispatch with ageing against a replay, lines framed from chunks."""

import datetime as dt
import heapq
import random

import pytest
from pyspark.sql import functions as F

from bibspark.operators import dispatch
from bibspark.sources import chunks

SCHEMA = "n LONG, action STRING, system BOOLEAN, depth INT, priority INT, ts TIMESTAMP_NTZ, item STRING, seq INT, rank INT"


def replay(ops):
    queues, served, out = ([], []), 0, []
    for n, action, system, depth, priority, ts, item, *_ in sorted(ops):
        if action == "send":
            if (depth or 0) <= 4:
                newest = -ts.timestamp() if ts else float("inf")
                heapq.heappush(queues[0 if system else 1], [(depth or 0), (priority or 0), newest, n, item])
        elif action == "receive":
            queue = queues[0] or queues[1]
            if queue:
                _, p, _, _, got = heapq.heappop(queue)
                served += 1
                out.append((served, n, got, p))
                if served % 100 == 0:
                    for q in queues:
                        for x in q:
                            x[1] -= 1
                        heapq.heapify(q)
    return out


def operations(n, seed, p_send=0.52):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    return [(k * 3 + 2**40, "send" if rng.random() < p_send else "receive", rng.choice([True, False, False, None]), rng.choice([0, 1, 1, 2, 4, 5, None]),
             rng.choice([101, 102, 103, None]), rng.choice([base + dt.timedelta(seconds=rng.randrange(500)), base, None]), f"i{k}", 7, 8) for k in range(n)]


def run(spark, ops, **kw):
    df = spark.createDataFrame(ops, SCHEMA).repartition(5)
    out = dispatch.dispatched(df, ["n"], "item", **kw)
    assert out.columns == ["serve", "at_n", "item", "priority_read"]
    return sorted(tuple(r) for r in out.collect())


def test_one_set(spark):
    ops = operations(1500, 1)
    got = run(spark, ops)
    assert got == replay(ops) and len(got) > 500
    unaged = [x for x in replay(ops) if x[3] >= 101]
    assert len(unaged) < len(got)  # ageing took part


@pytest.mark.parametrize("leaf,ways", [(60, 4), (10, 16)])
def test_dealt_to_many_sets(spark, leaf, ways):
    ops = operations(1500, 2)
    assert run(spark, ops, leaf=leaf, ways=ways) == replay(ops)


def test_queue_that_runs_empty_and_one_that_only_grows(spark):
    ops = operations(600, 3, 0.3)
    assert run(spark, ops, leaf=20, ways=4) == replay(ops)
    ops = operations(600, 4, 0.95)
    assert run(spark, ops, leaf=100, ways=2) == replay(ops)


def test_nothing_to_hand_out(spark):
    assert run(spark, []) == []
    assert run(spark, [r for r in operations(50, 5) if r[1] == "receive"]) == []
    assert run(spark, [r for r in operations(50, 6) if r[1] == "send"]) == []


def framed(raw):
    parts = raw.split(b"\n")
    if parts[-1] == b"":
        parts.pop()
    return [p.decode("utf-8", "replace").strip() for p in parts]


@pytest.mark.parametrize("size", [1, 3, 7, 1024])
def test_frame_lines(spark, size):
    rng = random.Random(7)
    conns = {k: "".join(rng.choice("ab é日\n\n \t\x85") for _ in range(rng.randrange(1, 120))).encode() for k in range(12)}
    conns |= {100: b"\n", 101: b"no newline", 102: b"x\n", 103: "　 é\x1f\n\n".encode(), 104: b"a" * 3000 + b"\nb"}
    df = spark.createDataFrame([(k, "c", v) for k, v in conns.items()], "conn INT, other STRING, raw BINARY")
    cut = chunks.cut(df, ["conn", "other"], F.col("raw"), size)
    assert cut.agg(F.max(F.octet_length("data"))).first()[0] <= size
    out = chunks.frame_lines(cut.repartition(4), ["conn", "other"])
    got = {}
    for r in out.orderBy("conn", "line_no").collect():
        got.setdefault(r["conn"], []).append(r["line"])
        assert r["line_no"] == len(got[r["conn"]]) - 1
    assert got == {k: framed(v) for k, v in conns.items() if framed(v)}


def test_frame_lines_nulls_and_nothing(spark):
    schema = "c STRING, seq LONG, data BINARY"
    rows = [(None, 0, b"a\nb"), (None, 1, None), (None, 2, b"c"), ("x", 5, b""), ("x", 9, b"\xff\xfe ok")]
    got = sorted((r["c"] or "", r["line_no"], r["line"]) for r in chunks.frame_lines(spark.createDataFrame(rows, schema), ["c"]).collect())
    assert got == [("", 0, "a"), ("", 1, "bc"), ("x", 0, "�� ok")]
    assert chunks.frame_lines(spark.createDataFrame([], schema), ["c"]).count() == 0
