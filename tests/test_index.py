"""Index-based finds return exactly what full scans return."""

from pyspark.sql import functions as F

from bibspark.functions import html as H
from bibspark.operators.extract.common import with_nodes


def test_index_matches_scan(spark):
    html = ('<div id="a" class="x y"><p class="x">1</p><div class="y"><p id="b">2</p><span class="x">3</span></div>'
            '</div><p class="x z">4</p><span class="a b">5</span>')
    p = with_nodes(spark.createDataFrame([(html,)], "html STRING"))
    n, ix = F.col("nodes"), F.col("nidx")
    outer = H.find(n, id="a")
    cases = [dict(tag="p"), dict(cls="x"), dict(tag="p", cls="x"), dict(id="b"), dict(tag="span", cls="a b"),
             dict(tag="div", cls="y")]
    cols = []
    for i, kw in enumerate(cases):
        cols.append(F.transform(H.find_all(n, None, None, **kw), lambda x: x["id"]).alias(f"s{i}"))
        cols.append(F.transform(H.find_all(n, None, ix, **kw), lambda x: x["id"]).alias(f"i{i}"))
        cols.append(F.transform(H.find_all(n, outer, None, **kw), lambda x: x["id"]).alias(f"se{i}"))
        cols.append(F.transform(H.find_all(n, outer, ix, **kw), lambda x: x["id"]).alias(f"ie{i}"))
    r = p.select(*cols).first()
    for i in range(len(cases)):
        assert r[f"s{i}"] == r[f"i{i}"] and r[f"se{i}"] == r[f"ie{i}"], cases[i]
    assert r["s1"] == [0, 1, 6, 8]
