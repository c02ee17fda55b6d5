"""The pipeline against a brute-force run of its stages, and the queries."""
import random
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from bibspark.llm import decontaminate, queries, toxicity  # noqa: E402
from tests_llm_brute import brute_exact, brute_join  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_brute_force_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    rows = {r.doc_id: r.text for r in docs.collect()}
    left = {r.doc_id: rows[r.doc_id] for r in scored if r.score < 0.5}
    winners, norm = brute_exact(list(left.items()))
    left = {i: t for i, t in left.items() if winners[norm(t)][0] == i}
    left = {i: left[i] for i, n, c, _ in brute_join(list(left.items())) if c == i or not n}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Index([(k, t.encode()) for k, t in enumerate(items)])
    left = {i for i, t in left.items() if not index.matches(decontaminate.normalise(t.encode())[0])}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id for r in out.collect()} == left
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "byte_bpe"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.ORACLES[name])
    cols = sorted(c[0] for c in cur.description)
    want = sorted(tuple(str(r[[c[0] for c in cur.description].index(k)]) for k in cols) for r in cur.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(tuple(str(v) for v in r) for r in df.select(cols).collect()) == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_over_the_whole_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").count()
    n = int(name[2:].split("_")[0])
    if n == 5:
        assert df.count() > 0
    elif n == 11:  # ten documents an item
        assert df.count() == 10 * rows("benchmark")
    elif n == 12:
        assert df.select("doc_id").distinct().count() == rows("documents")
    elif n == 13:
        assert df.where("component = 16").count() == rows("embeddings")
    else:
        assert df.count() == rows("pages" if n == 1 else "documents")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, kept string, bucket string, id string, label string"
ITEM = "the seventh harbour clock was mended by a patient keeper who counted every bell before the grey morning ferries left the quay"


def fed(spark, folder, rows, items=((1, ITEM),)):
    """A folder of tables with clashing columns."""
    spark.createDataFrame([(*r, None, None, None, "a", "b", "c", "d", "e", "f") for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1 if t and "vile" in t else 0, "x") for i, t in rows if i is not None], "doc_id long, toxic int, text string").write.parquet(f"{folder}/labels.parquet")


def test_nulls_copies_ties_and_clashing_columns(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"word{rng.randrange(2000)}" for _ in range(n))
    rows = [(k, prose(rng.randrange(20, 90))) for k in range(120)]
    rows += [(200 + k, prose(30) + " vile slur here") for k in range(40)]  # toxic
    rows += [(300, rows[3][1]), (301, rows[3][1].replace(" ", "\n")), (302, rows[4][1] + "  "), (302, rows[4][1] + "  ")]  # copies, a repeated row
    long = prose(400)
    rows += [(400, long), (401, long + " one more"), (402, "added " + long)]  # near copies
    rows += [(500, None), (501, ""), (502, " "), (None, prose(40)), (None, None)]
    rows += [(600, prose(20) + " " + ITEM + " " + prose(20)), (601, ITEM.replace("patient", "pateint"))]  # leaks
    fed(spark, str(tmp_path), rows)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*[c.split(" ")[0] for c in SCHEMA.split(", ") if not c.startswith("n_tokens")], "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(set(kept))
    assert not set(range(200, 240)) & set(kept) and not {600, 601} & set(kept)
    assert set(range(120)) - {4} <= set(kept)  # clean documents stay (302's copy of 4 is the longer one)
    assert len({4, 302} & set(kept)) == 1 and not {300} & set(kept) or 3 in kept
    assert len({400, 401, 402} & set(kept)) == 1
    assert len({500, 501, 502} & set(kept)) + (None in kept) >= 1


def test_empty_tables(spark, tmp_path):
    fed(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in queries.QUERIES.items():
        if int(name[2:].split("_")[0]) in (11, 12):
            assert query(spark, str(tmp_path)).count() == 0
