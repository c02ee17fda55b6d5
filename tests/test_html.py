"""Tree rules (H1), selectors (H2-H14) and extractors on small pages."""

import pyarrow as pa
from pyspark.sql import functions as F

from bibspark.functions import html as H
from bibspark.operators.extract import core, dblp, quality, scholar, scimago
from bibspark.sources import seeds


def pages(spark, *htmls, extra=None):
    data = [(i, h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(data, "page_no INT, html STRING")


def test_tree_rules():
    nodes = H.parse_nodes("<div><p>a<p>b</div><br><b>x</i>y</b><img src=q><!--c--><script>1<2</script>")
    tags = [(n["tag"], n["parent"]) for n in nodes]
    # unclosed <p> nests; </div> closes both; void <br>; stray </i> ignored
    assert tags[:5] == [("div", -1), ("p", 0), ("#text", 1), ("p", 1), ("#text", 3)]
    assert nodes[0]["last"] == 4
    assert ("br", -1) in tags and ("#comment", -1) in tags
    assert nodes[[n["tag"] for n in nodes].index("script") + 1]["tag"] == "#raw"
    b = [n for n in nodes if n["tag"] == "b"][0]
    assert [n["text"] for n in nodes if n["parent"] == b["id"]] == ["x", "y"]
    assert H.parse_nodes('<a class="x  y" class="z">')[0]["attrs"] == {"class": "z"}


def test_selectors(spark):
    html = ('<div id="s"><ul><li class="entry article"><span itemprop="author"><span itemprop="name"> A B </span>'
            '</span><cite class="data tts-content"><a href="l">L</a></cite></li></ul></div><a href="n">next</a>')
    df = pages(spark, html).select(H.html_nodes("html").alias("n"))
    n = F.col("n")
    li = H.find(n, tag="li", cls="entry")
    r = df.select(
        H.text(n, li, strip=True).alias("t"),
        F.transform(H.select(n, [{"attrs": {"itemprop": "author"}}, {"attrs": {"itemprop": "name"}}]),
                    lambda x: H.text(n, x, strip=True)).alias("names"),
        H.find(n, tag="cite", cls="data tts-content")["tag"].alias("exact"),
        H.find(n, tag="cite", cls="tts-content data")["tag"].alias("wrong_order"),
        H.find_next(n, li, tag="a")["attrs"]["href"].alias("next_a"),
        H.parent_of(n, H.find(n, tag="cite"), "li")["attrs"]["class"].alias("parent"),
    ).first()
    assert r["t"] == "A BL" and r["names"] == ["A B"]
    assert r["exact"] == "cite" and r["wrong_order"] is None
    assert r["next_a"] == "l" and r["parent"] == "entry article"


def test_dblp(spark):
    def entry(cls, title=True, authors=True, venue=True, link=True):
        a = '<span itemprop="author"><a><span itemprop="name">Ada Love</span></a></span>' if authors else ""
        t = '<span class="title">T.</span>' if title else ""
        v = '<span itemprop="isPartOf"><span itemprop="name">Proc. ICSE (1) 2020, 12</span></span>' if venue else ""
        if link:
            v = f'<a href="https://j/">{v}</a>'
        return f'<li class="entry {cls}"><cite class="data tts-content">{a}: {t}{v}</cite></li>'
    html = ('<div id="publ-section"><ul>' + entry("article") + entry("inproceedings") + entry("informal")
            + entry("inproceedings", title=False) + entry("inproceedings", authors=False)
            + entry("inproceedings", venue=False) + entry("article", link=False) + "</ul></div>")
    jp = spark.createDataFrame([("https://j/", '<header id="headline"><h1>Full Name, Vol 3</h1></header>')],
                               "url STRING, html STRING")
    out = dblp.publications(pages(spark, html), ["page_no"], jp).orderBy("pos").collect()
    assert [(r["type"], r["journal_name"], r["conference_acronym"]) for r in out] == [
        ("Journal", "Full Name", None), ("Conference", None, "Proc"), ("Journal", "Full Name", None)]
    assert out[0]["authors"] == ["Ada Love"] and out[0]["title"] == "T."


def test_scimago(spark):
    def page(pag, year_title="SJR 2021", cells=13, q='<span class="q2">Q2</span><span class="q1">Q1</span>'):
        row = "<tr>" + "".join(f"<td>{i}{q if i == 3 else ''}</td>" for i in range(cells)) + "</tr>"
        return (f'<div class="pagination">{pag}</div><div class="table_wrap"><table><thead><tr>'
                f'<th title="{year_title}">x</th></tr></thead><tbody>{row}</tbody></table></div>')
    df = pages(spark, page("1 - 50 of 50"), page("1 - 50 of 90"), page("bad"), page("1 - 2 of 2", cells=12),
               page("1 - 2 of 2", year_title="none"))
    out = {r["page_no"]: r for r in scimago.journals(df, ["page_no"]).collect()}
    assert sorted(out) == [0, 1, 2]
    assert out[0]["is_end"] is True and out[1]["is_end"] is False and out[2]["is_end"] is False
    assert out[0]["q_rank"] == "Q1" and out[0]["year"] == 2021 and out[0]["sjr_raw"] == "3Q2Q1"


def test_core(spark):
    def row(n, src="CORE2023", link=True):
        cells = ["T", "A", src, "A*", "", '<a href="d">x</a>' if link else "", "46", "", "4"][:n]
        return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    html = ('<div id="container"><table><tr><th>h</th></tr>' + row(9) + row(8) + row(9, "National")
            + row(9, link=False) + "</table></div>")
    df = pages(spark, html, "<p>Server Error</p>", "<p>no table</p>")
    rows, info = core.conferences(df, ["page_no"])
    out = rows.orderBy("pos").collect()
    assert [(r["year"], r["dblp_link"]) for r in out] == [(2023, "d"), (0, "d"), (2023, "N/A")]
    assert sorted(r["page_no"] for r in info.collect()) == [0, 2]


def test_quality_and_roots(spark):
    df = spark.createDataFrame([
        (0, "u0", "<p>Too many <b>REQUESTS</b></p>"),
        (1, "u1", "<script>Too Many Requests</script><p>fine</p>"),
        (2, "u2", '<script>grecaptcha.render("x", {"sitekey":"k1"})</script><iframe title="reCAPTCHA"></iframe>'),
        (3, "u3", '<script>grecaptcha.render()</script>'),
        (4, "u4", "<p>Error analysis of sorting</p>"),
    ], "page_id INT, url STRING, html STRING")
    df = df.withColumns({"iface": F.lit("dblp"), "page_kind": F.lit("search")})
    out = {r["page_id"]: r for r in quality.classify(df, ["page_id"]).collect()}
    assert out[0]["blocked"] and not out[1]["blocked"] and not out[4]["blocked"]
    assert out[2]["challenge"] and out[2]["site_key"] == "k1" and not out[3]["challenge"]
    roots = spark.createDataFrame([(0, '<script>var x=[{"n":"Ada Love","k":3},{"n":"Bob Low"}]</script>'
                                       '<!-- {"c":"Cy Dee"} -->')], "page_id INT, html STRING")
    names = [r["name"] for r in seeds.root_names(roots, ["page_id"]).orderBy("pos").collect()]
    assert names == ["Cy Dee", "Bob Low", "Ada Love"]


def test_scholar_publication(spark):
    html = ('<div id="gsc_oci_title">  Plain title </div>'
            '<div class="gs_scl"><div class="gsc_oci_field">Autori</div><div class="gsc_oci_value">A, B </div></div>'
            '<div class="gs_scl"><div class="gsc_oci_field">Data</div><div class="gsc_oci_value">2019/5/1</div></div>'
            '<div class="gs_scl"><div class="gsc_oci_field">Volume</div><div class="gsc_oci_value">1949</div></div>'
            '<div class="gs_scl"><div class="gsc_oci_field">Descrizione</div><div class="gsc_oci_value" '
            'id="gsc_oci_descr"><svg><text>no</text></svg>Text <b>here</b></div></div>'
            '<a href="/s?cites=77">Citato da 12</a>'
            '<a class="gsc_oci_g_a" href="/s?as_ylo=2020&x"><span>3</span></a><a class="gsc_oci_g_a" href="/s">'
            '<span>9</span></a><a class="gsc_oms_link" href="rel">r</a>')
    df = spark.createDataFrame([(0, "https://x?citation_for_view=U:1", html)], "k INT, url STRING, html STRING")
    r = scholar.publication(df, ["k"], "url", 2024).first()
    assert r["title"] == "Plain title" and r["title_link"] == "Title link not available"
    assert r["authors"] == ["A", "B"] and r["publication_date"] == 2019
    assert r["description"] == "Text here" and r["total_citations"] == 12 and r["cites_id"] == "77"
    assert [(g["year"], g["citations"]) for g in r["citation_graph"]] == [(2020, 3)]
    assert r["related_articles_url"] == "rel" and r["all_versions_url"] == "No all versions link"


def test_dblp_entry_years(spark):
    html = ('<div id="publ-section"><ul><li class="year">2021</li><li class="entry article">a</li>'
            '<li class="entry article">b</li><li class="year">20x1</li><li class="entry">c</li></ul>'
            '<ul><li class="entry">d</li></ul></div>')
    got = [r["year"] for r in dblp.entry_years(pages(spark, html), ["page_no"]).orderBy("pos").collect()]
    assert got == ["2021", "2021", "Unknown", "Unknown"]


def test_dblp_candidates(spark):
    html = ('<div id="completesearch-authors"><ul class="result-list">'
            '<li><a href="https://dblp.org/pid/1"><span itemprop="name">Ada Love</span></a> <small>Univ Pisa</small></li>'
            '<li><a href="https://dblp.org/pid/2"><span itemprop="name">Ada Lovelace</span></a> <small>MIT</small></li>'
            '</ul></div><a href="https://elsewhere/">x</a>')
    out = dblp.candidates(pages(spark, html), ["page_no"]).orderBy("pos").collect()
    assert [(r["pos"], r["name"], r["href"], r["org"]) for r in out] == [
        (0, "Ada Love", "https://dblp.org/pid/1", "Univ Pisa"), (1, "Ada Lovelace", "https://dblp.org/pid/2", "MIT")]
    short = html.replace(" <small>MIT</small>", "")
    assert dblp.candidates(pages(spark, short), ["page_no"]).count() == 0


def test_unquoted_values_may_hold_quotes():
    for tag in ("<a href=x'y>", '<a href=x"y>', "<a b=c href=x'y'>", "<a href=it's title='q>'>"):
        nodes = H.parse_nodes(f"<p>one {tag}two</a> three</p>")
        assert [n["tag"] for n in nodes] == ["p", "#text", "a", "#text", "#text"]
        assert nodes[2]["attrs"]["href"][:2] in ("x'", 'x"', "it") and nodes[3]["text"] == "two"


def test_tags_that_never_end_are_text_in_linear_time():
    import time
    began = time.time()
    for piece in ('<a "', "<a '", '<a b="c', '<a "\'', "<i x='<a \""):
        nodes = H.parse_nodes("<p>" + piece * 100_000)
        assert nodes[0]["tag"] == "p" and "".join(n["text"] or "" for n in nodes if n["tag"] == "#text").startswith(piece[:2])
    assert time.time() - began < 30


def test_nodes_leave_a_task_a_few_pages_at_a_time(monkeypatch):
    """One Arrow batch of pages becomes many small ones; order, nulls and single large pages included."""
    import pyarrow as pa
    monkeypatch.setattr(H, "PARSE_BYTES", 100)
    pages_in = ["<p>%d</p>" % k for k in range(30)] + [None, "<b>" + "x" * 500 + "</b>", ""] + ["<i>z</i>"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages_in))), pa.array(pages_in)], ["k", "html"])
    out = list(H._parse_rows(iter([batch])))
    assert [k for b in out for k in b.column("k").to_pylist()] == list(range(len(pages_in)))
    assert all(sum(len(pages_in[k] or "") for k in b.column("k").to_pylist()) <= 100 or b.num_rows == 1 for b in out)
    whole = H._nodes_arrow(pa.array(pages_in)).to_pylist()
    assert [n for b in out for n in b.column("nodes").to_pylist()] == [w["nodes"] if w else None for w in whole]
    assert [n for b in out for n in b.column("nidx").to_pylist()] == [w["index"] if w else None for w in whole]


def test_pages_parsed_together_equal_pages_parsed_alone():
    """Plain pages are read many at a time, the others one by one: same nodes and index."""
    plain = ['<!DOCTYPE html>\n<html><body class="a b a"><p id="x">1 &amp; 2</p> \n <br><img src=\'y\'/></BR>é</body></html>', "", None, "only text", "<div><p>never closed"]
    other = ["<div><p></div>", "a > b", "<!-- <b> --><b>c</b>", "<script>if (a<b) {}</script>", '<a title="x><b">c</b>', "a<!DOCTYPE html>b", "<pre> </pre>"]
    odd, _ = H._nested_pages(pa.array(plain + other), {})
    assert odd.tolist()[:len(plain)] == [False] * len(plain) and odd.any()
    assert not H._nested_pages(pa.array(plain), {})[0].any()

    def view(a):
        return [(r["nodes"], sorted(r["index"])) if r and r["nodes"] is not None else None for r in a.to_pylist()]
    pages = pa.array([x for two in zip(plain * 2, other * 2) for x in two] + plain)
    for part in (pages, pages.slice(3), pages.slice(2, 4), pages.slice(0, 0)):
        assert view(H._nodes_arrow(part)) == view(H._nodes_by_page(part))


def test_a_key_that_is_also_the_user_is_read_once(spark):
    pages = spark.createDataFrame([("u1", '<div id="gsc_prf_w"><div id="gsc_prf_in">N</div></div>')], "request_id STRING, html STRING")
    row = scholar.profile(pages, ["request_id"], "request_id").collect()[0]
    assert (row["request_id"], row["name"]) == ("u1", "N")
