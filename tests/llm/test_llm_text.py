"""Decontamination, secrets, tokenisation, scoring, toxicity, extraction,
sharding: against brute force, round trips and held-out accuracy."""
import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from bibspark.llm import bpe, context_mixing, decontaminate, html_extract, kd_shards, secrets, toxicity


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, score string, start string")


# ------------------------------------------------------------------ op1
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="nav-open">
<header class="site"><a href="/">Home</a> <a href="/b">Blog</a></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
<div id="cookie-notice">We use cookies to give you the best experience on this website, all the time.</div>
<!-- <p>not here</p> --><div class="content"><h1>Heading &amp; more</h1><p>First   &eacute;&#233; line<br>goes on.<p>Short.
<script>var t="</p>";</script><div class="ad">Buy now, very cheap offers for everybody today and tomorrow.</div><p><b>Another</b> paragraph
that is long enough to be content by itself, surely.</p><section class="comments"><p>A reader says something rather long here. It is a comment, not the article.</p></section></div>
<aside><p>Related: a list of other stories you may want to read after this one.</p></aside><form><label>Name</label><textarea>x</textarea></form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    text, _, kept = html_extract.main_text(PAGE)
    assert text == "Heading & more\n\nFirst éé line goes on.\n\nShort.\n\nAnother paragraph that is long enough to be content by itself, surely."
    assert kept == 4
    for empty in (None, "", "<html></html>", "<!-- open", "<script>never closed"):
        assert html_extract.main_text(empty)[0] == ""


def test_head_without_end_tag():
    body = "<p>The first paragraph is long enough to be the content of this page, surely it is.</p><p>So is the second one, which goes on in the very same manner as the first.</p>"
    want = re.sub(r"</p><p>", "\n\n", body)[3:-4]
    for page in (f"<html><head><title>T</title><body><article>{body}</article></body></html>", f"<head><meta charset=x><style>p{{}}</style><script>1</script>{body}", f"<html><head><title>T</title></head><body>{body}</body>"):
        assert html_extract.main_text(page)[0] == want
    text = want.split("\n")[0]
    assert html_extract.main_text(f"<head><title>T</title>\n{text}")[0] == html_extract.main_text(f"<head><title>T</title>{text}<br>")[0] == text
    assert html_extract.main_text("<head><title>T</title>\n<meta name=x> ")[0] == ""


def test_wrappers_with_words_against():
    paragraphs = ["The first paragraph is long enough to be the content of this page, surely it is, and it goes on for a while, as paragraphs do.", "So is the second one, which goes on in the very same manner as the first, with a few more words put in at its end."]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    want = "\n\n".join(paragraphs)
    rest = "<nav><a href=x>One</a></nav><div class='sidebar'><p>Other stories of the site that readers of this page may like to read next.</p></div><div class='comments'><p>A reader says that this is all wrong and goes on about it for a while.</p></div>"
    for names in ("has-sidebar", "no-sidebar", "comments-open", "hasSidebar", "layout-sidebar-left", "category-recommended tag-alert", "sidebar-wrapper", "share widget", "banner"):
        for page in (f"<body><div class='{names}'><article>{body}</article></div>{rest}</body>", f"<body><div id=x class='{names}'><div class=inner>{rest}<main>{body}</main></div></div></body>", f"<body>{rest}<article class='{names}'>{body}</article></body>"):
            assert html_extract.main_text(page)[0] == want, page
    long = "<p>A reader says that this is all wrong and goes on about it for a while, twice.</p>" * 4
    for names in ("comments", "sidebar", "sidebar-left", "navigation", "notification", "page-footer", "related-posts", "cookie-notice"):  # a name still counts beside the page's own text
        assert html_extract.main_text(f"<article>{body}</article><div class='{names}'><article>{long}</article></div>")[0] == want
    assert html_extract.main_text("<div class='cookie-notice'><p>We use cookies to give you the best experience on this website, all the time.</p></div>")[0] == ""


def test_minimum_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(1, 8)
        net = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(label):
            return sum(max(0, x) for x, k in zip(net, label) if not k) + sum(max(0, -x) for x, k in zip(net, label) if k) + sum(w for a, b, w in edges if label[a] != label[b])

        best = min(cost([m >> k & 1 == 1 for k in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(html_extract.minimum_cut(net, edges)), best, abs_tol=1e-9)


def test_extract_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "v", "plain text only", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[2] == "" and got[1].startswith("Heading") and html_extract.extract(df).count() == 4
    assert html_extract.extract(df.limit(0)).count() == 0


# ------------------------------------------------------------------ op5
def edit_distance(item, text):
    """Of the whole item against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != c)))
        row = new
    return min(row)


def test_leaks_against_edit_distance():
    rng = random.Random(4)
    items = [(k, words(rng, 25)) for k in range(6)]
    index = decontaminate.Index([(i, t.encode()) for i, t in items])
    for _ in range(60):
        k, t = rng.choice(items)
        own = list(t)
        for _ in range(rng.randrange(int(len(own) * 0.14))):
            p = rng.randrange(len(own))
            own[p:p + 1] = rng.choice([[], ["z"], [own[p], "q"]])
        text, _ = decontaminate.normalise((words(rng, 20) + " " + "".join(own) + " " + words(rng, 20)).encode())
        found = [m for m in index.matches(text) if index.ids[m[0]] == k]
        item, budget = index.texts[k], int(index.edits[k])
        best = edit_distance(item.tolist(), text.tolist())
        assert bool(found) == (best <= budget)
        if found:
            edits, start, end = min(m[1:] for m in found)
            assert edits == best and edit_distance(item.tolist(), text[start:end].tolist()) == best


def test_find_leaks(spark):
    rng = random.Random(5)
    items = [(1, words(rng, 20)), (2, words(rng, 30)), (2, words(rng, 30)), (3, None), (4, ""), (5, "tiny")]
    clean = [(10, words(rng, 50, 9000)), (11, None), (12, ""), (13, "tiny")]
    leaky = [(20, "é é " + items[0][1].upper().replace(" ", ",  ") + " end"), (21, items[1][1]), (21, items[1][1]), (22, "x\x00" + items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, clean + leaky)
    got = decontaminate.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(20, 1), (21, 2), (21, 2), (22, 1)]
    hit = next(r for r in got if r.doc_id == 20)
    assert leaky[0][1][hit.start:hit.end].lower().replace(",  ", " ") == items[0][1]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [10, 11, 12, 13]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


# ------------------------------------------------------------------ op6
def brute_base(text):
    out = []
    for kind, pattern, least, group in ((0, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
                                        (1, "AKIA[A-Z0-9]+", 18, 0), (2, "[0-9a-f]+", 16, 0)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


def secret_texts(rng, n):
    out = []
    for k in range(n):
        parts = [words(rng, rng.randrange(30), 9000)]
        for _ in range(rng.randrange(3)):
            value = "".join(rng.choice("abcdefXYZ0123456789+/_.=-") for _ in range(rng.randrange(6, 40)))
            parts.append(rng.choice([f'password = "{value}"', f"API_KEY:{value}", f"toKen={value}", "AKIA" + "".join(rng.choice("ABC12") for _ in range(rng.randrange(10, 22))),
                                     "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(10, 40))), "ſecret=abcdefghijklmnop", "pasKword: zzzzzzzzzzzzzz"]))
            parts.append(words(rng, rng.randrange(10), 9000))
        out.append("é\n".join(parts))
    return out


def test_base_spans():
    for text in secret_texts(random.Random(6), 300) + ["", "token", "secret=" + "a" * 5000, "AKIAAKIA" + "Z" * 20]:
        assert secrets.base_spans(text) == brute_base(text)


def trained_field():
    got = list(secrets._labelled_windows(secret_texts(random.Random(7), 300)))
    return secrets.ChainField.fit(np.array([x for x, _ in got]), np.array([y for _, y in got]))


def test_field_decodes_the_best_path():
    """Cutting the chain at sure tokens gives the path of full Viterbi."""
    field = trained_field()
    for text in secret_texts(random.Random(8), 60):
        tokens = secrets.Tokens([text.encode()])
        if not len(tokens.start):
            continue
        scores = field.emit[tokens.features].sum(1)
        full = field.viterbi(scores, False, False)
        cut = field.tag(tokens).tolist()
        value = lambda path: sum(s[p] for s, p in zip(scores, path)) + sum(field.move[a, b] for a, b in zip(path, path[1:]))
        assert math.isclose(value(full), value(cut), rel_tol=1e-9)


def test_field_finds_held_out_secrets():
    field = trained_field()
    texts = secret_texts(random.Random(11), 200)
    hit = total = 0
    for text, spans in zip(texts, secrets.added_spans(field, texts)):
        for a, _, b in secrets.base_spans(text):
            total += 1
            hit += any(s < b and a < e for s, e in spans)
    assert total > 100 and hit / total > 0.8
    clean = [words(random.Random(k), 60, 9000) for k in range(50)]
    assert sum(len(s) for s in secrets.added_spans(field, clean)) == 0


def test_secret_scan_frame(spark):
    texts = secret_texts(random.Random(12), 60)
    rows = [*enumerate(texts), (60, None), (61, ""), (0, texts[0])]
    df = frame(spark, rows)
    got = secrets.scan(df, secrets.fit(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = [(s.start, secrets.KINDS.index(s.kind), s.end) for s in r.spans if s.kind != "crf"]
        assert base == brute_base(dict(rows)[r.doc_id] or "")
    assert secrets.scan(df.limit(0), secrets.fit(df.limit(0))).count() == 0


# ------------------------------------------------------------------ op7
def test_kd_shards(spark):
    rng = random.Random(13)
    rows = [(k, words(rng, rng.randrange(80), 9000), f"s{k % 3 if k % 2 else 0}", rng.choice(["en", "de", None])) for k in range(900)]
    rows += [(1000 + k, "same text again", "s1", "en") for k in range(200)] + [(2000, None, None, None), (2001, "", "s1", "en"), (5, rows[5][1], "s0", "en"), (None, "a", "b", "c")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, lang string, size int, row int")
    for n in (1, 3, 8):
        got = kd_shards.kd_shards(df, shards=n).collect()
        assert len(got) == len(rows)
        size, slots, texts = Counter(), defaultdict(list), defaultdict(set)
        for r in got:
            size[r.shard] += r["size"]
            slots[r.shard].append(r.slot)
        assert sorted(size) == list(range(n))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        mean = sum(size.values()) / n
        assert max(abs(x - mean) for x in size.values()) < max(0.03 * mean, 1000 if n == 1 else 500)
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert kd_shards.kd_shards(df.limit(0), shards=8).count() == 0


# ------------------------------------------------------------------ op8
def test_base_score_and_probabilities(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "BLOCK_BYTES", 4000)
    rng = random.Random(14)
    rows = [(k, words(rng, rng.randrange(40), 60) + rng.choice(["", ".", " Ärger!", "\n"])) for k in range(150)] + [(150, None), (151, ""), (3, "W1 w1"), (None, "w2")]
    got = context_mixing.score_texts(frame(spark, rows)).collect()
    train = Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    for i, t in rows:
        if fold(i) != 1:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    want = Counter((i, fold(i) == 1, len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    # words like the training texts' are likelier than strange bytes
    strange = context_mixing.score_texts(frame(spark, [*rows, (1000, "qzxj kvvb ###")])).where("doc_id = 1000").first()
    usual = [r.score / r.n_tokens for r in got if r.n_tokens > 3]
    assert strange.score / strange.n_tokens < min(usual)
    assert context_mixing.score_texts(frame(spark, [])).count() == 0


def test_bits_are_a_distribution():
    """The probabilities of all byte values after a prefix add up to one."""
    tables = context_mixing.Tables(np.random.default_rng(1).integers(0, 9, context_mixing.CONTEXTS * 2 * context_mixing._SLOTS).astype(np.float32))
    mixer = context_mixing.Mixer()
    spelled = context_mixing.Spelled([b"\x04" + b"ab" + bytes([c]) for c in range(256)])
    last = np.append(spelled.first[1:], len(spelled.byte)) - 2  # the byte before the closing space
    final, total = mixer.refined(), np.zeros(256)
    for y, places in spelled.bits():
        x, gate = mixer.inputs(tables, [p[last] for p in places])
        s = mixer.stretched(x, gate)
        p = 1 / (1 + np.exp(-s))
        total += np.log(np.where(y[last] == 1, p, 1 - p))
    assert math.isclose(np.exp(total).sum(), 1, rel_tol=1e-9) and final.shape == (256, context_mixing.COLUMNS)


def test_nodes_have_their_own_counts(monkeypatch):
    """Every node's counts are those of its context alone, whatever the number
    of contexts, chunks, buckets and parts."""
    monkeypatch.setattr(context_mixing, "CHUNK", 300)
    rng = random.Random(18)
    tokens = sorted({bytes([rng.choice([1, 2, 4])]) + bytes(rng.choice(b"aabcde\xc3\xa9") for _ in range(rng.randrange(1, 9))) for _ in range(400)} | {b"\x04\n"})
    a, b = ([rng.randrange(3) for _ in tokens] for _ in range(2))

    def nodes(token):
        """(bit, the six contexts with the bits before) of every bit."""
        word = token[1:] if token[1:] == b"\n" else token[1:] + b" "
        for i, byte in enumerate(word):
            last = b"    " + word[:i]
            contexts = [(1, token[0], i == 0, last[-1:]), (2, last[-2:]), (3, last[-3:]), (4, last[-4:]), (5, word[:i]), (6, token[0], word[:i])]
            for bit in range(8):
                yield byte >> (7 - bit) & 1, [(c, bit, byte >> (8 - bit)) for c in contexts]

    brute = [defaultdict(lambda: [0, 0]) for _ in range(2)]
    for t, x, y in zip(tokens, a, b):
        for bit, own in nodes(t):
            for c in own:
                brute[0][c][bit] += x
                brute[1][c][bit] += x + y
    asked = []
    for bucket in range(3):
        p = [(t, x, y) for k, (t, x, y) in enumerate(zip(tokens, a, b)) if k % 3 == bucket]
        rows = pa.RecordBatch.from_pydict({"bucket": [bucket], "tokens": [context_mixing._pack(b" ".join(t for t, _, _ in p))], "a": [context_mixing._longs([x for _, x, _ in p])], "b": [context_mixing._longs([y for _, _, y in p])]})
        asked += context_mixing._counting(5)([rows])
    asked = pa.Table.from_batches(asked)
    seen = pa.concat_tables([context_mixing._summing(asked.filter(pc.equal(asked.column("part"), part))) for part in range(5)])
    checked = 0
    for bucket in range(3):
        own = [(t, y) for k, (t, y) in enumerate(zip(tokens, b)) if k % 3 == bucket]
        for which, columns in enumerate((["a"], ["a", "b"])):
            answers = context_mixing._answers(seen.filter(pc.equal(seen.column("bucket"), bucket)), columns)
            for chunk, part in enumerate(context_mixing._chunks([t for t, _ in own])):
                used = [t for t, _ in own[part]]
                spelled = context_mixing.Spelled(used)
                tables = context_mixing.Tables.rebuilt(spelled.keys, answers[chunk])
                want = [list(nodes(t)) for t in used]
                for bit, (y, places) in enumerate(spelled.bits()):
                    each = [n for w in want for n in w[bit::8]]
                    assert y.tolist() == [n[0] for n in each]
                    for k, at in enumerate(places):
                        pairs = [brute[which][n[1][k]] for n in each]
                        assert np.allclose(tables.stretch[at], [math.log((one + 0.4) / (zero + 0.4)) for zero, one in pairs], atol=2e-3)
                        assert tables.level[at].tolist() == np.digitize([sum(x) for x in pairs], [1, 4, 32]).tolist()
                        checked += len(at)
    assert checked > 50_000


def test_documents_are_split_into_words_once():
    """What a block asks has its documents as numbers of what it asked, so
    scores need no second pass over the texts."""
    texts, ids = [b"Ab  ab. ab!\x0b\xc3\x9f x", b"", b"ab ab\x85 " * 40, b"x ab."], [7, None, 12, 12]
    dealt = pa.table({"block": [3], "ids": [ids], "sizes": [[len(t) for t in texts]], "texts": [context_mixing._pack(b"".join(texts))]})
    got = context_mixing._asking(5)(dealt).to_pylist()
    asked, docs = [r for r in got if r["bucket"] is not None], [r for r in got if r["bucket"] is None]
    assert len(docs) == 1 and docs[0]["ids"] == ids and docs[0]["sizes"] == [len(t) for t in texts]
    tokens = [t for r in asked for t in context_mixing._words(r["tokens"])]
    named = dict(zip(context_mixing._flat(docs[0]["b"], np.int32).tolist(), tokens))
    number, sizes = context_mixing._flat(docs[0]["tokens"], np.int32), context_mixing._numbers(docs[0]["a"])
    own = [[named[x] for x in part.tolist()] for part in np.split(number, np.cumsum(sizes)[:-1])]
    kind = lambda w: 4 if w[-1] >= 128 or chr(w[-1]).isalnum() else 2 if w[-1:] in b".!?" else 3
    want = []
    for t in texts:
        split = t.lower().split()
        want.append([bytes([c]) + w for c, w in zip([1, *map(kind, split)], [*split, b"\n"])])
    assert own == want and sorted(tokens) == sorted({t for x in want for t in x})
    fold = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i in ids]
    for column, kept in (("a", lambda f: f not in (1, 4)), ("b", lambda f: f == 4)):
        counts = Counter(t for x, f in zip(want, fold) for t in x if kept(f))
        assert [n for r in asked for n in context_mixing._numbers(r[column]).tolist()] == [counts[t] for t in tokens]


def test_keys_are_ordered_whatever_they_share():
    rng = np.random.default_rng(21)
    for keys in (rng.integers(0, 1 << 64, 70_000, np.uint64), rng.integers(0, 50, 70_000).astype(np.uint64), np.zeros(0, np.uint64),
                 (rng.integers(0, 1 << 20, 70_000, np.uint64) << np.uint64(44)) + rng.integers(0, 600, 70_000, np.uint64),
                 np.append(rng.integers(0, 1 << 64, 70_000, np.uint64), [1 << 60 | x for x in (512, 3, 259, 256)]).astype(np.uint64)):
        order, own = context_mixing._ordered(keys)
        assert (own == np.sort(keys)).all() and (keys[order] == own).all() and sorted(order.tolist()) == list(range(len(keys)))


# ------------------------------------------------------------------ op9
def test_bpe_equals_the_rule_and_round_trips(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    path = bpe.vocabulary_path()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(15)
    alphabet = "aaabe  -=_\n\t 's'll12éß日本🦆\x1c\x85\xa0.,!*"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["-" * n for n in range(90)] + ["ab" * n + "  " for n in range(90)] + ["", "<|endoftext|>", "x" * 5000]
    own = bpe.codec(path)
    assert own.encode_batch(texts) == [plain.encode_ordinary(t) for t in texts]
    rows = [*enumerate(texts[:200]), (200, None), (0, texts[0])]
    df = frame(spark, rows)
    by_id = {i: t or "" for i, t in rows}
    for r in bpe.round_trip(df).collect():
        ids, t = plain.encode_ordinary(by_id[r.doc_id]), by_id[r.doc_id].encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t).hexdigest())
    assert {r.doc_id: bytes(r.raw).decode() for r in bpe.decode(bpe.encode(df)).collect()} == by_id
    assert own.offsets("héllo wörld")[-1][1] == 11
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_encode_gives_spans(spark):
    own = bpe.codec(bpe.vocabulary_path())
    rng = random.Random(20)
    texts = ["".join(rng.choice("aaabe  -=_\n\t 's'll12éß日本🦆\x1c\x85\xa0.,!*") for _ in range(rng.randrange(60))) for _ in range(300)] + ["-" * n for n in range(90)] + ["", None, "🦆" * 40]
    got = {r.doc_id: r for r in bpe.encode(frame(spark, list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    library = 0
    for k, t in enumerate(texts):
        r, t = got[k], t or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        at = 0
        for i, a, b in zip(r.ids, r.starts, r.ends):  # the span is the least that has the token's bytes
            n = len(own.bytes_of[i])
            assert len(t[:a].encode()) <= at < len(t[:a + 1].encode()) and len(t[:b - 1].encode()) < at + n <= len(t[:b].encode())
            at += n
        assert at == len(t.encode())
        coded = own.tokenizer.encode(t, add_special_tokens=False)
        if coded.ids == r.ids:
            library += 1
            assert list(coded.offsets) == list(zip(r.starts, r.ends))
    assert library > 300


# ------------------------------------------------------------------ op10
def test_machine_learns_a_pair():
    """Toxic only when both words are present: no sum of weights says that."""
    rng = np.random.default_rng(16)
    x = (rng.random((3000, 2)) < 0.5).astype(np.float32)
    y = (x[:, 0] * x[:, 1]).astype(np.float32)
    machine = toxicity.FactorizationMachine.fit(x, y, epochs=60)
    got = [machine.score([k for k in range(2) if m >> k & 1]) >= 0.5 for m in range(4)]
    assert got == [False, False, False, True]


def test_pair_of_neutral_terms(spark):
    """Two words, each as common in both classes, are toxic only together,
    in a vocabulary with more separating words than the machine has places."""
    rng = random.Random(19)
    rows, labels = [], []
    for k in range(2400):
        bad = int(rng.random() < 0.4)
        own = [f"{rng.choice('abcdefghijklmnop')}{''.join(rng.choice('qrstuvwxyz') for _ in range(3))}" for _ in range(60)]
        own += rng.choice([["Lantern", "OTTER"], []]) if bad else rng.choice([["lantern"], ["otter"]])
        if bad and own[-1] != "OTTER":
            own.append("vilething")
        rng.shuffle(own)
        rows.append((k, " ".join(own)))
        labels.append((k, bad))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.fit(docs, table)
    assert len(model[0]) > toxicity.PLACES
    assert {toxicity.places_of("lantern")[0], toxicity.places_of("otter")[0]} <= set(model[0])
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, model).collect()}
    held = [(got[k], y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(g == bool(y) for g, y in held) / len(held) > 0.9


def test_toxicity_held_out(spark):
    rng = random.Random(17)
    rows, labels = [], []
    for k in range(600):
        bad = rng.random() < 0.3
        own = words(rng, 30).split()
        if bad:
            own[rng.randrange(30)] = rng.choice(["Vilename", "vilething", "nastyword"]) + rng.choice(["", "!", ","])
        rows.append((k, " ".join(own)))
        labels.append((k, int(bad)))
    rows += [(600, None), (601, ""), (602, "é"), (5, rows[5][1])]
    labels += [(600, None), (None, 1), (5, labels[5][1])]
    docs = frame(spark, rows)
    table = spark.createDataFrame([(i, y, 9) for i, y in labels], "doc_id long, toxic int, text int")
    model = toxicity.fit(docs, table)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: y for i, y in labels if y is not None}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, table.limit(0)) is None and toxicity.score(docs, None).where("score <> 0").count() == 0


def test_merging_long_runs_by_rank():
    """The heap gives what joining the leftmost lowest pair again and again gives, and long runs take seconds."""
    import time

    def plain(piece, ranks):
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    own = bpe.codec(bpe.vocabulary_path())
    rng = random.Random(12)
    for piece in [b"-" * n for n in range(1, 90)] + [b"a" * 77, b"w" * 50, b"0" * 61] + [bytes(rng.choice(b"-a0w.") for _ in range(rng.randrange(1, 60))) for _ in range(300)]:
        assert bpe.merge_by_rank(piece, own.ranks) == ([own.ranks[piece]] if piece in own.ranks else plain(piece, own.ranks))
    began = time.time()
    ids = bpe.merge_by_rank(b"-" * 1_000_000, own.ranks)
    assert time.time() - began < 60 and own.decode(ids) == b"-" * 1_000_000


def test_round_trip_replaces_its_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, n_tokens int, ids_sha256 string")
    out = bpe.round_trip(df)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"] and out.first().n_tokens == 2


PARAGRAPH = "<p>" + "A long running sentence of the article, with enough words to count as text. " * 3 + "</p>"


def test_a_page_that_is_one_form_keeps_its_text():
    plain, *_ = html_extract.main_text(f"<body>{PARAGRAPH * 5}</body>")
    for inner in (PARAGRAPH * 5, f"<article>{PARAGRAPH * 5}</article>", f'<div class="newsletter widget">{PARAGRAPH * 5}</div>'):
        assert html_extract.main_text(f'<body><form id="aspnetForm">{inner}</form></body>')[0] == plain
    page = f'<body><article>{PARAGRAPH * 3}</article><form class="signup">{PARAGRAPH}<input></form></body>'
    assert html_extract.main_text(page)[0] == html_extract.main_text(f"<article>{PARAGRAPH * 3}</article>")[0]


def test_quotes_in_unquoted_values_are_markup():
    for tag in ("<a href=x'y>", '<a href=x"y>', "<a title=it's href='a>b'>"):
        assert html_extract.main_text(f"<article><p>See {tag}this link</a> and more of it.</p>{PARAGRAPH}</article>")[0].startswith("See this link and more of it.\n\n")


def test_many_blocks_and_open_tags_take_seconds():
    import time
    began = time.time()
    html_extract.main_text("<p>Some words that are here for a test, quite long enough to count as text.</p><nav>menu</nav>" * 50_000)
    html_extract.main_text("<p>x</p>" + '<a "' * 100_000)
    html_extract.main_text("<p>x</p>" + "<a '" * 100_001)
    assert time.time() - began < 60


def test_minimum_cut_against_every_labelling():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 9)
        net = [rng.choice([-3.0, -1.5, -0.5, 0.0, 0.7, 2.0, 4.0]) for _ in range(n)]
        edges = [(a, b, rng.choice([0.3, 0.8, 1.1])) for a in range(n) for b in range(a) if rng.random() < 0.4]

        def cost(label):
            return sum(x for x, on in zip(net, label) if x > 0 and not on) - sum(x for x, on in zip(net, label) if x < 0 and on) + sum(w for a, b, w in edges if label[a] != label[b])

        best = min(cost([k >> i & 1 == 1 for i in range(n)]) for k in range(1 << n))
        assert abs(cost(html_extract.minimum_cut(net, edges)) - best) < 1e-6
