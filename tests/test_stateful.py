"""Keyed state over several micro-batches: answers, bounded dedupe, hourly
readings, counters that go on."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from bibspark.streaming import stateful


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_first_arrival_is_new(spark):
    rng = random.Random(1)
    keys = ["hot"] * 40 + [f"k{n}" for n in range(30)] + [None]
    rows = [(rng.choice(keys), n % 3, n, 2**60 + n) for n in range(600)]
    df = spark.createDataFrame([(k, b, n, big) for k, b, n, big in rows], "k STRING, batch INT, n INT, big LONG").repartition(4)
    parts = [df.where(F.col("batch") == b) for b in range(3)] + [df.where("false")]
    out = stateful.run_parts(spark, parts, "t-new", lambda s: stateful.new_item_answers(s, ["k"], ["big"]))
    got = {r["big"]: r["is_new"] for r in out.collect()}
    seen, want = set(), {}
    for k, _, _, big in sorted(rows, key=lambda r: (r[1], r[3])):
        want[big] = k not in seen
        seen.add(k)
    assert got == want and out.columns == ["k", "big", "is_new"]


def test_key_columns_of_several_types_and_replay(spark):
    """A query restarted from its checkpoint remembers; the same file is read once."""
    df = spark.createDataFrame([(1, "a", 1), (None, "a", 2), (1, None, 3), (1, "a", 4), (None, "a", 5)], "u LONG, t STRING, n INT").coalesce(1)
    out = stateful.run_parts(spark, [df, df.withColumn("n", F.col("n") + 10)], "t-keys", lambda s: stateful.new_item_answers(s, ["u", "t"], ["n"]))
    assert sorted((r["n"], r["is_new"]) for r in out.collect()) == [(1, True), (2, True), (3, True), (4, False), (5, False)] + [(n, False) for n in range(11, 16)]


def brute_ttl(rows, ttl):
    last, kept = {}, []
    for k, t, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t > last[k] + ttl:
            last[k] = t
            kept.append(n)
    return sorted(kept)


def test_ttl_dedupe_and_state_size(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(40)}" if t > 600 else f"old{t}", t, 2**60 + t) for t in range(2000)]
    rows += [("hot", t, 2**61 + t) for t in range(0, 2000, 3)]
    df = spark.createDataFrame([(k, at(t), n, k == "k7") for k, t, n in rows], "k STRING, ts TIMESTAMP_NTZ, n LONG, sys BOOLEAN")
    parts = [df.where((F.col("ts") >= at(a)) & (F.col("ts") < at(a + 500))).repartition(2) for a in range(0, 2000, 500)]
    out = stateful.run_parts(spark, parts, "t-ttl", lambda s: stateful.dedupe_ttl(s, ["k"], "ts", ["n"], "60 minutes", "5 minutes", "sys"))
    system = sorted(n for k, _, n in rows if k == "k7")
    normal = [(k, t, n) for k, t, n in rows if k != "k7"]
    assert sorted(r["n"] for r in out.collect()) == sorted(brute_ttl(normal, 60) + system)
    assert out.dtypes == df.dtypes

    # the state: keys of one ttl + delay, not every key ever seen
    base = tempfile.mkdtemp(prefix="bibspark-ttl-")
    df.where("not sys").write.parquet(f"{base}/in/part-0")
    df.where("not sys").limit(1).withColumn("ts", F.lit(at(5000)).cast("timestamp_ntz")).write.parquet(f"{base}/late")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    q = (stateful.dedupe_ttl(stream, ["k"], "ts", ["n"], "60 minutes", "5 minutes").writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    inside = {k for k, t, _ in normal if t >= 1999 - 60 - 65}
    assert len({k for k, *_ in normal}) > 600 and sizes[-1] <= len(inside) < 45


def brute_reads(batches, delay):
    """batches: lists of (key, minute, blocked) -> {(key, reading): [blocked, pages, late]}"""
    waiting, nxt, done, mark = {}, {}, {}, 0
    for batch in batches:
        to_come = -(-mark // 60) * 60
        for key in {k for k, *_ in batch}:
            for k, t, b in batch:
                if k == key:
                    due = (t // 60 + 1) * 60
                    mine = waiting.setdefault((k, max(due, to_come)), [0, 0, 0])
                    mine[0] += b
                    mine[1] += 1
                    mine[2] += due < to_come
            nxt.setdefault(key, min(d for k, d in waiting if k == key))
        mark = max([mark, *(t - delay for _, t, _ in batch)])
        for key in nxt:
            while nxt[key] < mark:
                done[key, nxt[key]] = waiting.pop((key, nxt[key]), [0, 0, 0])
                nxt[key] += 60
    return done


def test_read_and_clear_with_late_pages(spark):
    rng = random.Random(3)
    batches = [[(rng.choice("ab"), rng.randrange(600 * b, 600 * b + 600), rng.random() < 0.1) for _ in range(60)] for b in range(3)]
    batches[1] += [("a", 5, True), ("b", 30, False), ("c", 10, True)]  # read long ago
    batches[2] += [("c", 700, False), ("a", 601, True)]
    frame = lambda rows: spark.createDataFrame([(k, at(t), b) for k, t, b in rows] + [("a", None, True)], "k STRING, ts TIMESTAMP_NTZ, bad BOOLEAN").repartition(3)
    out = stateful.run_parts(spark, [frame(b) for b in batches], "t-reads", lambda s: stateful.read_and_clear(s, "ts", F.col("bad"), ["k"], delay="30 minutes"))
    got = {(r["k"], int((r["check"] - at(0)).total_seconds() // 60)): r for r in out.collect()}
    # the mark of an empty stream is the epoch, long before the first page
    want = brute_reads(batches, 30)
    assert set(got) == set(want)
    for k, (n_blocked, n_pages, n_late) in want.items():
        r = got[k]
        assert (r["n_blocked"], r["n_pages"], r["n_late"], r["was_blocked"], r["reverse"], r["flag_after"]) == (n_blocked, n_pages, n_late, n_blocked > 0, n_blocked == 0, False)
    assert sum(r["n_late"] for r in got.values()) >= 4


def test_read_and_clear_without_keys(spark):
    df = spark.createDataFrame([(at(10), True), (at(150), None), (at(400), False)], "ts TIMESTAMP_NTZ, bad BOOLEAN").coalesce(1)
    out = stateful.run_parts(spark, [df], "t-one", lambda s: stateful.read_and_clear(s, "ts", F.col("bad")))
    assert sorted((r["check"], r["was_blocked"], r["n_pages"]) for r in out.collect()) == [(at(60 * k), k == 1, int(k in (1, 3))) for k in range(1, 7)]


def test_counters_go_on_from_saved_ones(spark):
    rows = [("x", at(5)), ("y", at(6)), ("x", at(1))]
    df = spark.createDataFrame(rows, "c STRING, ts TIMESTAMP_NTZ")
    base = tempfile.mkdtemp(prefix="bibspark-counters-")
    first = stateful.run_parts(spark, [df, df.where("c = 'x'")], "t-count", lambda s: stateful.resumed_counts(s, "c", "ts"), "update", ["content"])
    assert sorted(map(tuple, first.collect())) == [("x", 4, at(5)), ("y", 1, at(6))]
    stateful.save_counts(first, f"{base}/saved")
    later = spark.createDataFrame([("x", at(3)), ("z", at(9))], "c STRING, ts TIMESTAMP_NTZ")
    again = stateful.run_parts(spark, [later, later.where("c = 'z'")], "t-resume", lambda s: stateful.resumed_counts(s, "c", "ts", f"{base}/saved"), "update", ["content"])
    assert sorted(map(tuple, again.select("content", "n", "last_ts").collect())) == [("x", 5, at(5)), ("y", 1, at(6)), ("z", 2, at(9))]
