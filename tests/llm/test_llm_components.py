"""Components take many rounds on long chains; the plans' size estimates stay."""

from pyspark.sql import functions as F

from bibspark.llm import components


def test_size_estimates_do_not_grow_with_the_rounds(spark, monkeypatch):
    bits, star = [], components._star

    def watched(edges, large):
        bits.append(edges._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return star(edges, large)

    monkeypatch.setattr(components, "_star", watched)
    name = lambda c: F.xxhash64(c)  # noqa: E731 - a chain whose names are in no order
    chains = spark.range(120).where("id % 40 <> 39").select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b"))
    found = {r["node"]: r["label"] for r in components.components(chains).collect()}
    every = [r["n"] for r in spark.range(120).select(name(F.col("id")).alias("n")).collect()]
    assert found == {n: min(every[k // 40 * 40:k // 40 * 40 + 40]) for k, n in enumerate(every)}
    assert len(bits) >= 6 and max(bits[2:]) <= 64
