"""HTML pages as node arrays (H1) and selectors over them.

``html_nodes(html)`` is the only Python step: an Arrow-batched pandas UDF
that turns each page into ``ARRAY<STRUCT<id, last, parent, tag, attrs,
text>>`` in document order. ``last`` is the highest id inside an element, so
its subtree is the contiguous slice ``nodes[id+1 .. last]`` and "descendant
of" is an integer interval test. Everything after the parse (find, select,
text, attributes, siblings, tables) is a Spark higher-order expression that
runs in the JVM.

Tree rules: void elements close at once; no implied end tags (an unclosed
``<p>`` nests); an end tag closes the nearest open element of that name and
is ignored when none is open; the last duplicate attribute wins. Text pieces
are ``#text`` nodes, script/style bodies ``#raw``, comments ``#comment``.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape as _unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

NODE = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("cls", T.ArrayType(T.StringType())),
])
NODES = T.ArrayType(NODE)
# lookup keys: "tag", "#id", ".class" → ids of the matching elements, in order
INDEX = T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))
PARSED = T.StructType([T.StructField("nodes", NODES), T.StructField("index", INDEX)])

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr "
                 "basefont bgsound command frame image isindex menuitem nextid spacer".split())
RAW_TEXT = frozenset(("script", "style"))
TEXT, RAW, COMMENT = "#text", "#raw", "#comment"


# Tokens of the standard library's HTML parser (Python 3.13.0 rules), as one
# regex: comments, declarations/bogus comments, processing instructions,
# end tags, start tags (quoted attribute values may hold '>', unquoted ones
# quotes), text. Nothing is tried twice within a start tag.
_TOKEN = re.compile(r"""
    <!--(?P<comment>.*?)(?:-->|\Z)
  | <!(?P<bang>[^>]*)>
  | <\?[^>]*>
  | </(?P<end>[a-zA-Z][^\t\n\r\f />]*)[^>]*>
  | </(?P<bogus>[^>]*)>
  | <(?P<start>[a-zA-Z][^\t\n\r\f />\x00]*)(?P<attrs>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|"[^"]*+"|'[^']*+')*+)>
  | (?P<text>[^<]+|<)
""", re.S | re.X)
# The attribute pattern of the standard library's html.parser, as it stands there.
_ATTR = re.compile(r"""((?<=['"\s/])[^\s/>][^\s/=>]*)(\s*=+\s*('[^']*'|"[^"]*"|(?!['"])[^>\s]*))?(?:\s|/(?!>))*""")
_RAW_END = {t: re.compile(r"</\s*%s\s*>" % t, re.I) for t in ("script", "style")}
_KEEP_SPACE = frozenset(("pre", "textarea"))
# A start tag and the pieces of its attributes, as in _TOKEN.
OPEN_TAG = re.compile(r"<[a-zA-Z][^\t\n\r\f />\x00]*")
_PIECE = re.compile(r"""[^>"'=]++|=\s*+(?:(?P<value>"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+|(?P<quoted>"[^"]*+"|'[^']*+')""")


class Unclosed:
    """Start tags that never end: an open quote takes in the rest of the page.
    A later tag that such a scan met between its attribute values would run
    the same way, so it is text without being scanned again; only tags inside
    values are. Scans that meet go on together, so a page is scanned a few
    times at most, however many of its tags are open."""

    def __init__(self, html: str):
        self.html = html
        self.scans: list[tuple[int, int, list[int], list[int]]] = []

    def known(self, at: int) -> bool:
        for begun, stop, starts, ends in self.scans:
            if begun <= at < stop:
                k = bisect_right(starts, at) - 1
                if k < 0 or at >= ends[k]:
                    return True
        return False

    def add(self, at: int) -> None:
        starts, ends = [], []
        pos = OPEN_TAG.match(self.html, at).end()
        while m := _PIECE.match(self.html, pos):
            name = m.lastgroup
            if name:
                starts.append(m.start(name))
                ends.append(m.end(name))
            pos = m.end()
        self.scans.append((at, pos, starts, ends))


class _TreeBuilder:
    """Builds one page's nodes into flat, column-wise lists."""

    def __init__(self):
        self.parent: list[int] = []
        self.last: list[int] = []
        self.tag: list[str] = []
        self.keys: list[list[str]] = []
        self.vals: list[list[str]] = []
        self.text: list[str | None] = []
        self.cls: list[list[str]] = []
        self.stack: list[int] = []
        self.pending: list[str] = []
        self.index: dict[str, list[int]] = {}

    def _add(self, tag, attrs, text):
        i = len(self.tag)
        self.parent.append(self.stack[-1] if self.stack else -1)
        self.last.append(i)
        self.tag.append(tag)
        if attrs:
            self.keys.append(list(attrs.keys()))
            self.vals.append(list(attrs.values()))
            c = attrs.get("class")
            self.cls.append(c.split() if c else [])
        else:
            self.keys.append([])
            self.vals.append([])
            self.cls.append([])
        self.text.append(text)
        return i

    def flush(self):
        """Adjacent text pieces form one string; a whitespace-only string
        becomes one newline or space (outside pre/textarea)."""
        if not self.pending:
            return
        data = "".join(self.pending)
        self.pending = []
        if data.isspace() and not data.strip(" \n\t\x0c\r") and not any(self.tag[i] in _KEEP_SPACE for i in self.stack):
            data = "\n" if "\n" in data else " "
        self._add(TEXT, None, data)

    def start(self, tag, attrs, closed):
        self.flush()
        i = self._add(tag, attrs, None)
        ix = self.index
        ix.setdefault(tag, []).append(i)
        if attrs:
            if "id" in attrs:
                ix.setdefault("#" + attrs["id"], []).append(i)
            for c in self.cls[i]:
                ix.setdefault("." + c, []).append(i)
        if tag not in VOID and not closed:
            self.stack.append(i)

    def end(self, tag):
        self.flush()
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.tag[self.stack[depth]] == tag:
                del self.stack[depth:]
                return

    def special(self, tag, text):
        self.flush()
        self._add(tag, None, text)

    def feed(self, html: str):
        pos, n = 0, len(html)
        match = _TOKEN.match
        unclosed = Unclosed(html)
        while pos < n:
            if unclosed.scans and unclosed.known(pos) and OPEN_TAG.match(html, pos):
                self.pending.append("<")
                pos += 1
                continue
            m = match(html, pos)
            kind = m.lastgroup
            if kind == "text" and m.end() == pos + 1 and OPEN_TAG.match(html, pos):
                unclosed.add(pos)
            pos = m.end()
            if kind == "text":
                t = m.group("text")
                self.pending.append(_unescape(t) if "&" in t else t)
            elif kind == "attrs":  # a start tag (its last group is the attributes)
                tag = m.group("start").lower()
                raw = m.group("attrs")
                closed = raw.endswith("/")
                attrs = _attrs(raw) if raw.strip(" \t\n\r\f/") else None
                self.start(tag, attrs, closed)
                if tag in _RAW_END and not closed:
                    e = _RAW_END[tag].search(html, pos)
                    stop = e.start() if e else n
                    if stop > pos:
                        self.special(RAW, html[pos:stop])
                    if e:
                        self.end(tag)
                        pos = e.end()
                    else:
                        pos = n
            elif kind == "end":
                self.end(m.group("end").lower())
            elif kind == "comment":
                self.special(COMMENT, m.group("comment"))
            elif kind == "bang":
                b = m.group("bang")
                if not b[:7].upper().startswith("DOCTYPE") and not b.startswith("["):
                    self.special(COMMENT, b)
            elif kind == "bogus":
                if m.group("bogus"):
                    self.special(COMMENT, m.group("bogus"))
        self.flush()
        return self

    def finish(self):
        last, parent = self.last, self.parent
        # close the intervals: last = highest id in the subtree
        for i in range(len(last) - 1, -1, -1):
            p = parent[i]
            if p >= 0 and last[p] < last[i]:
                last[p] = last[i]
        return self


def _attrs(raw: str) -> dict:
    """Attribute list of a start tag: names lower-cased, values unquoted and
    unescaped, a bare name gets ``""``; the last duplicate wins."""
    d = {}
    for m in _ATTR.finditer(" " + raw):
        name = m.group(1)
        if not name:
            continue
        v = m.group(3)
        if v is None:
            v = ""
        elif v[:1] in ("'", '"') and v[-1:] == v[:1] and len(v) >= 2:
            v = v[1:-1]
        d[name.lower()] = _unescape(v) if "&" in v else v
    return d


# The tree builder travels with the UDF (pickled by value), so executors
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _build(html: str) -> _TreeBuilder:
    return _TreeBuilder().feed(html).finish()


def parse_nodes(html: str | None) -> list[dict] | None:
    """Plain-Python view of one page's nodes (unit tests, debugging)."""
    if html is None:
        return None
    b = _build(html)
    return [{"id": i, "last": b.last[i], "parent": b.parent[i], "tag": b.tag[i],
             "attrs": dict(zip(b.keys[i], b.vals[i])), "text": b.text[i], "cls": b.cls[i]}
            for i in range(len(b.tag))]


# What a tag does to the tree, as _TreeBuilder.feed has it.
OPENS, SINGLE, CLOSES, NOTHING, ODD = range(5)
_PLAIN_ATTR = re.compile(r' ([a-zA-Z-]+)="([^"]*)"')
#: Distinct tags that a task remembers.
TAGS_KEPT = 1 << 16


def _tag_of(tag: str) -> tuple:
    """(what it does, name, attribute names, values, classes, index keys)."""
    m = _TOKEN.match(tag)
    kind = m.lastgroup
    if m.end() < len(tag) or kind in ("comment", "bogus", "text"):
        return ODD, "", (), (), (), ()
    if kind == "end":
        name = m.group("end").lower()
        return (SINGLE if name in VOID else CLOSES), name, None, (), (), ()
    if kind != "attrs":  # a declaration or a processing instruction
        b = m.group("bang")
        return (NOTHING if b is None or b[:7].upper().startswith("DOCTYPE") or b.startswith("[") else ODD), "", None, (), (), ()
    name, raw = m.group("start").lower(), m.group("attrs")
    if name in RAW_TEXT or name in _KEEP_SPACE:
        return ODD, name, (), (), (), ()
    attrs = {}
    if raw:
        plain = _PLAIN_ATTR.findall(raw)
        if sum(len(k) + len(v) + 4 for k, v in plain) == len(raw):
            attrs = {k.lower(): _unescape(v) if "&" in v else v for k, v in plain}
        elif raw.strip(" \t\n\r\f/"):
            attrs = _attrs(raw)
    cls = (attrs.get("class") or "").split()
    keys = [name, *(["#" + attrs["id"]] if "id" in attrs else []), *["." + c for c in cls]]
    return (SINGLE if name in VOID or raw.endswith("/") else OPENS), name, tuple(attrs), tuple(attrs.values()), cls, keys


def _text_of(piece: str) -> str:
    data = _unescape(piece) if "&" in piece else piece
    if data.isspace() and not data.strip(" \n\t\x0c\r"):
        return "\n" if "\n" in data else " "
    return data


def _offsets(lengths) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32))


def _flat(lists) -> list:
    return [x for own in lists for x in own]


def _nested_pages(pages: pa.Array, tags: dict) -> tuple[np.ndarray, pa.Array | None]:
    """The nodes of many pages at a time: (pages left over, nodes and index).

    A page that is nothing but text and tags whose end tags each close the
    element opened last has the same nodes here as in :class:`_TreeBuilder`:
    distinct tags and texts are read once, places in the tree follow from
    counting. Any other page (comments, scripts, stray signs, end tags that
    cross) is left over. The result is there if no page is."""
    n_pages = len(pages)
    whole = pc.fill_null(pages, "") if pages.null_count else pages
    at = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset:whole.offset + n_pages + 1].astype(np.int64)
    data = whole.buffers()[2]
    signs = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0]:at[-1]]
    found = np.flatnonzero((signs == 60) | (signs == 62))
    ends = signs[found] == 62
    found += at[0]
    first = np.searchsorted(found, at)
    count = np.diff(first)
    page = np.repeat(np.arange(n_pages), count)
    odd = count % 2 == 1
    odd[page[ends != ((np.arange(len(found)) - first[page]) % 2 == 1)]] = True
    if odd.any():
        return odd, None
    # pieces of a page: text, tag, text, ..., text
    starts = np.insert(found + ends, first[:-1], at[:-1])
    page = np.repeat(np.arange(n_pages), count + 1)
    place = np.arange(len(starts)) - np.concatenate([[0], np.cumsum(count + 1)])[page]
    bounds = np.append(starts, at[-1])
    filled = np.diff(bounds) > 0
    pieces = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), data or pa.py_buffer(b"")]).dictionary_encode()
    code = pieces.indices.to_numpy(zero_copy_only=False)
    if len(tags) > TAGS_KEPT:
        tags.clear()
    own, texts, empty = [], [], (ODD, TEXT, (), (), (), ())
    for piece in pieces.dictionary.to_pylist():
        if piece[:1] == "<":
            known = tags.get(piece)
            if known is None:
                known = tags[piece] = _tag_of(piece)
            own.append(known)
            texts.append(None)
        else:
            own.append(empty)
            texts.append(_text_of(piece))
    is_tag = place % 2 == 1
    does = np.where(is_tag, np.array([k[0] for k in own], np.int8)[code], NOTHING)
    odd[page[is_tag & (does == ODD)]] = True
    around = np.flatnonzero(is_tag & (does == NOTHING))  # texts around one are one text
    odd[page[around[(place[around] != 1) | (filled[around - 1] & filled[around + 1])]]] = True
    step = (does == OPENS).astype(np.int64) - (does == CLOSES)
    depth = np.cumsum(step)  # after the piece
    depth -= (depth - step)[place == 0][page] if n_pages else 0
    odd[page[depth < 0]] = True
    if odd.any():
        return odd, None
    numbers: dict[str, int] = {}
    name = np.array([numbers.setdefault(k[1], len(numbers)) for k in own], np.int64)[code]
    # an element and its end tag are neighbours among the tags of their level
    moves = np.flatnonzero(step)
    level = np.where(step > 0, depth - 1, depth)[moves]
    by_level = np.lexsort((moves, level, page[moves]))
    moves = moves[by_level]
    closing = np.flatnonzero(step[moves] < 0)
    opened, closed = moves[closing - 1], moves[closing]
    odd[page[closed[name[opened] != name[closed]]]] = True
    if odd.any():
        return odd, None
    element = is_tag & np.array([k[2] is not None for k in own], bool)[code]
    node = element | (~is_tag & filled)
    before = np.cumsum(node) - node  # nodes before the piece
    is_at = np.flatnonzero(node)
    of = page[is_at]
    sizes = np.bincount(of, minlength=n_pages)
    base = np.concatenate([[0], np.cumsum(sizes)])
    last = np.arange(len(before))
    last[:] = before
    last[step > 0] = (base[1:] - 1)[page[step > 0]]
    last[opened] = before[closed] - 1
    opens = moves[step[moves] > 0]
    deep = int(depth.max(initial=0)) + 2
    key = lambda p, lvl, x: (page[p] * deep + lvl) * len(starts) + x
    inside = (depth - np.maximum(step, 0))[is_at]  # open elements around a node
    parent = np.full(len(is_at), -1, np.int64)
    some = inside > 0
    if some.any():
        q = is_at[some]
        parent[some] = before[opens[np.searchsorted(key(opens, depth[opens] - 1, opens), key(q, inside[some] - 1, q)) - 1]]
        parent[some] -= base[of[some]]
    # columns: one row per distinct piece, then as often as it stands
    row = pa.array(code[is_at], pa.int32())
    lists = [(k[2] or (), k[3], k[4], k[5]) for k in own]
    attrs = pa.MapArray.from_arrays(_offsets([len(k[0]) for k in lists]), pa.array(_flat(k[0] for k in lists), pa.string()), pa.array(_flat(k[1] for k in lists), pa.string())).take(row)
    cls = pa.ListArray.from_arrays(_offsets([len(k[2]) for k in lists]), pa.array(_flat(k[2] for k in lists), pa.string())).take(row)
    columns = [pa.array(np.arange(len(is_at)) - base[of], pa.int32()), pa.array(last[is_at] - base[of], pa.int32()), pa.array(parent, pa.int32()),
               pa.array([k[1] for k in own], pa.string()).take(row), attrs, pa.array(texts, pa.string()).take(row), cls]
    struct = pa.StructArray.from_arrays(columns, fields=[pa.field(f, c.type) for f, c in zip(NODE.names, columns)])
    mask = pc.is_null(pages)
    nodes = pa.ListArray.from_arrays(pa.array(base, pa.int32()), struct, mask=mask)
    # the index: nodes by page and key
    words: dict[str, int] = {}
    keys = [[words.setdefault(w, len(words)) for w in k[3]] for k in lists]
    n_keys = np.array([len(k) for k in keys], np.int64)
    here = code[is_at]
    many = n_keys[here]
    entry = np.repeat(np.arange(len(here)), many)
    place_in = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
    word = np.array(_flat(keys), np.int64)[(np.cumsum(n_keys) - n_keys)[here[entry]] + place_in] if len(entry) else np.zeros(0, np.int64)
    group = of[entry] * max(1, len(words)) + word
    order = np.argsort(group, kind="stable")
    group, entry = group[order], entry[order]
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    ids = pa.ListArray.from_arrays(pa.array(np.append(heads, len(group)), pa.int32()), pa.array(entry - base[of[entry]], pa.int32()))
    per_page = np.bincount(group[heads] // max(1, len(words)), minlength=n_pages) if len(heads) else np.zeros(n_pages, np.int64)
    names = pa.array(list(words), pa.string()).take(pa.array(group[heads] % max(1, len(words)), pa.int64()))
    index = pa.MapArray.from_arrays(_offsets(per_page), names, ids, mask=mask)
    return odd, pa.StructArray.from_arrays([nodes, index], fields=[pa.field("nodes", nodes.type), pa.field("index", index.type)], mask=mask)


def _nodes_arrow(pages: pa.Array, tags: dict | None = None) -> pa.Array:
    """``struct(nodes, index)`` of every page: those that are plainly nested
    all together, the others one by one."""
    tags = {} if tags is None else tags
    odd, out = _nested_pages(pages, tags)
    if out is not None:
        return out
    single = _nodes_by_page(pages.filter(pa.array(odd)))
    if odd.all():
        return single
    both = pa.concat_arrays([single, _nodes_arrow(pages.filter(pa.array(~odd)), tags)])
    return both.take(pa.array(np.argsort(np.argsort(~odd, kind="stable"), kind="stable")))


def _nodes_by_page(pages: pa.Array) -> pa.Array:
    ids, last, parent, tag, text = [], [], [], [], []
    mkeys, mvals, moff = [], [], [0]
    cvals, coff = [], [0]
    offsets, valid = [0], []
    ikeys, ioff, ivals, ivoff = [], [0], [], [0]
    for h in pages.to_pylist():
        if h is None:
            offsets.append(offsets[-1])
            ioff.append(ioff[-1])
            valid.append(False)
            continue
        b = _build(h)
        for k, v in b.index.items():
            ikeys.append(k)
            ivals.extend(v)
            ivoff.append(ivoff[-1] + len(v))
        ioff.append(ioff[-1] + len(b.index))
        n = len(b.tag)
        ids.extend(range(n))
        last.extend(b.last)
        parent.extend(b.parent)
        tag.extend(b.tag)
        text.extend(b.text)
        for k, v, c in zip(b.keys, b.vals, b.cls):
            mkeys.extend(k)
            mvals.extend(v)
            moff.append(moff[-1] + len(k))
            cvals.extend(c)
            coff.append(coff[-1] + len(c))
        offsets.append(offsets[-1] + n)
        valid.append(True)
    attrs = pa.MapArray.from_arrays(pa.array(moff, pa.int32()), pa.array(mkeys, pa.string()),
                                    pa.array(mvals, pa.string()))
    cls = pa.ListArray.from_arrays(pa.array(coff, pa.int32()), pa.array(cvals, pa.string()))
    struct = pa.StructArray.from_arrays(
        [pa.array(ids, pa.int32()), pa.array(last, pa.int32()), pa.array(parent, pa.int32()),
         pa.array(tag, pa.string()), attrs, pa.array(text, pa.string()), cls],
        fields=[pa.field("id", pa.int32()), pa.field("last", pa.int32()), pa.field("parent", pa.int32()),
                pa.field("tag", pa.string()), pa.field("attrs", attrs.type), pa.field("text", pa.string()),
                pa.field("cls", cls.type)])
    mask = pa.array([not v for v in valid], pa.bool_())
    nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct, mask=mask)
    ids_lists = pa.ListArray.from_arrays(pa.array(ivoff, pa.int32()), pa.array(ivals, pa.int32()))
    index = pa.MapArray.from_arrays(pa.array(ioff, pa.int32()), pa.array(ikeys, pa.string()), ids_lists, mask=mask)
    return pa.StructArray.from_arrays([nodes, index], fields=[pa.field("nodes", nodes.type),
                                                            pa.field("index", index.type)], mask=mask)


def _html_nodes(html: pa.Array) -> pa.Array:
    """H1: page text → ``struct(nodes, index)``, one call per Arrow batch of
    pages; the result is built column-wise straight into Arrow buffers."""
    return _nodes_arrow(html)


# Marked nondeterministic only as an optimizer barrier: filters on the parse
# result are then not pushed below the projection that parses (and so not
# below a repartition that spreads pages over cores), and the parse is never
# duplicated by project collapsing. The function itself is pure.
html_parse = F.arrow_udf(_html_nodes, PARSED).asNondeterministic()


#: Bytes of page text whose nodes a task holds at a time, when it holds more than one page.
PARSE_BYTES = 1 << 20


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(first, rows) of runs of pages that together stay within PARSE_BYTES."""
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and held + size > PARSE_BYTES:
            yield first, i - first
            first, held = i, 0
        held += size
    if len(sizes) > first:
        yield first, len(sizes) - first


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is the page -> the other columns, nodes, index."""
    tags: dict = {}
    for b in batches:
        pages = b.column(b.num_columns - 1)
        sizes = pc.fill_null(pc.binary_length(pages), 0).to_pylist()
        for first, rows in _slices(sizes):
            parsed = _nodes_arrow(pages.slice(first, rows), tags)
            kept = [b.column(i).slice(first, rows) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *parsed.flatten()], [*b.schema.names[:-1], "nodes", "nidx"])


def parse_pages(pages: DataFrame, html_col: str) -> DataFrame:
    """H1 over rows: the other columns of ``pages`` with ``nodes`` and ``nidx``.
    A page becomes many times its size in nodes, so they leave the task a few
    pages at a time and never as one block per Arrow batch."""
    rest = [f for f in pages.schema.fields if f.name != html_col]
    out = T.StructType([*rest, T.StructField("nodes", NODES), T.StructField("nidx", INDEX)])
    return pages.select(*[f.name for f in rest], html_col).mapInArrow(_parse_rows, out)


def html_nodes(html: Column | str) -> Column:
    """H1 as a single column: the node array only."""
    return html_parse(html)["nodes"]


# ------------------------------------------------------------------ helpers
_REFS = ("UnresolvedAttribute", "UnresolvedNamedLambdaVariable", "NamedLambdaVariable", "AttributeReference")


def _is_ref(c: Column) -> bool:
    """A plain column or lambda-variable reference (cheap to repeat)."""
    try:
        return c._jc.node().getClass().getSimpleName() in _REFS
    except Exception:  # noqa: BLE001 - unknown column kind: bind it
        return False


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a one-element
    ``transform``): higher-order expressions are not de-duplicated by the
    optimizer, so without this a nested selector repeats its inner finds.
    A plain reference is used directly."""
    if _is_ref(value):
        return body(value)
    return F.get(F.transform(F.array(value), body), 0)


def is_tag(n: Column, tag: str | None) -> Column:
    return F.lit(True) if tag is None else (n["tag"] == tag)


def has_class(n: Column, cls: str) -> Column:
    """H2/H3: a single class name matches any of the element's classes; a
    value with spaces must equal the whole attribute (bs4 rule)."""
    if " " in cls:
        return n["attrs"]["class"] == cls
    return F.array_contains(n["cls"], F.lit(cls))


def match(n: Column, tag: str | None = None, id: str | None = None, cls: str | None = None,
          attrs: dict | None = None) -> Column:
    """Element predicate: tag, id, class and attribute tests. An attribute
    value of ``True`` means "present"."""
    # a given tag already excludes text/raw/comment nodes
    p = (n["tag"] == tag) if tag is not None else ~n["tag"].startswith("#")
    if id is not None:
        p = p & (n["attrs"]["id"] == id)
    if cls is not None:
        p = p & has_class(n, cls)
    for k, v in (attrs or {}).items():
        p = p & (n["attrs"][k].isNotNull() if v is True else (n["attrs"][k] == v))
    return p


def _index(nodes: Column, el: Column) -> Column:
    """1-based array index of ``el`` in ``nodes`` (which may be a slice of
    the page's array: ids stay page-wide, so subtract the first id)."""
    return el["id"] - F.get(nodes, 0)["id"] + 1


def subtree(nodes: Column, el: Column) -> Column:
    """Descendants of ``el`` (contiguous in document order)."""
    return let(el, lambda e: F.slice(nodes, _index(nodes, e) + 1, F.greatest(e["last"] - e["id"], F.lit(0))))


def element_nodes(nodes: Column, el: Column) -> Column:
    """``el`` followed by its descendants: a self-contained node slice, so an
    exploded row carries only its own part of the page."""
    return let(el, lambda e: F.slice(nodes, _index(nodes, e), e["last"] - e["id"] + 1))


def root(en: Column) -> Column:
    """The element a node slice was cut for."""
    return F.get(en, 0)


def _index_key(tag=None, id=None, cls=None, attrs=None) -> str | None:
    if id is not None:
        return "#" + id
    if cls is not None and " " not in cls:
        return "." + cls
    return tag


def find_all(nodes: Column, el: Column | None = None, index: Column | None = None, **kw) -> Column:
    """H2: matching elements in document order (inside ``el`` if given).

    With the page's ``index`` (from :func:`with_nodes`) only the elements
    listed under the tag, id or class are tested, instead of every node; it
    applies to the whole page's node array only."""
    key = _index_key(**kw) if index is not None else None
    if key is None:
        scope = nodes if el is None else subtree(nodes, el)
        return F.filter(scope, lambda n: match(n, **kw))
    cand = F.transform(F.coalesce(F.element_at(index, F.lit(key)), F.array().cast("array<int>")),
                       lambda i: F.get(nodes, i))
    if el is None:
        return F.filter(cand, lambda n: match(n, **kw))
    return let(el, lambda e: F.filter(cand, lambda n: (n["id"] > e["id"]) & (n["id"] <= e["last"]) & match(n, **kw)))


def find(nodes: Column, el: Column | None = None, index: Column | None = None, **kw) -> Column:
    """H2: first match or null."""
    return F.get(find_all(nodes, el, index, **kw), 0)


def children(nodes: Column, el: Column) -> Column:
    """Direct children only."""
    return F.filter(subtree(nodes, el), lambda n: n["parent"] == el["id"])


def select(nodes: Column, steps: list[dict], el: Column | None = None, index: Column | None = None) -> Column:
    """H4: CSS descendant chain ``s1 s2 ... sk``: elements matching the last
    step that have ancestors matching the earlier steps, in order."""
    # level by level: step i keeps matches that lie inside a match of step
    # i-1, so each test runs against the (few) previous matches, not all nodes
    def level(i: int) -> Column:
        here = find_all(nodes, el, index, **steps[i])
        if i == 0:
            return here
        return let(level(i - 1), lambda prev: F.filter(here, lambda n: F.exists(
            prev, lambda a: (a["id"] < n["id"]) & (n["id"] <= a["last"]))))
    return level(len(steps) - 1)


def select_one(nodes: Column, steps: list[dict], el: Column | None = None, index: Column | None = None) -> Column:
    return F.get(select(nodes, steps, el, index), 0)


def text(nodes: Column, el: Column, sep: str = "", strip: bool = False,
         exclude: Column | None = None) -> Column:
    """H5: text of a subtree. ``strip`` strips every piece and drops empty
    ones (``get_text(strip=True)``); script/style bodies and comments are
    left out. ``exclude`` is an array of elements whose subtrees are
    removed first (H11, ``decompose``)."""
    # non-text pieces become null, which array_join skips
    def piece(n):
        keep = n["tag"] == TEXT
        if exclude is not None:
            keep = keep & ~F.exists(exclude, lambda x: (x["id"] < n["id"]) & (n["id"] <= x["last"]))
        return F.when(keep, X.utrim(n["text"]) if strip else n["text"])

    def body(e):
        pieces = F.transform(subtree(nodes, e), piece)
        return F.when(e.isNotNull(), F.array_join(F.filter(pieces, lambda t: t != "") if strip else pieces, sep))
    return let(el, body)


def attr(el: Column, name: str, default: str | None = None) -> Column:
    """H6: attribute with a default."""
    v = el["attrs"][name]
    return v if default is None else F.coalesce(v, F.lit(default))


def parent_of(nodes: Column, el: Column, tag: str) -> Column:
    """H7: nearest enclosing element with the tag."""
    return F.try_element_at(F.filter(nodes, lambda a: (a["tag"] == tag) & (a["id"] < el["id"])
                                     & (el["id"] <= a["last"])), F.lit(-1))


def find_next(nodes: Column, el: Column, **kw) -> Column:
    """H8: first matching element after ``el`` in document order (not
    limited to its subtree)."""
    def body(e):
        after = F.slice(nodes, _index(nodes, e) + 1, F.greatest(F.size(nodes) - _index(nodes, e), F.lit(0)))
        return F.get(F.filter(after, lambda n: match(n, **kw)), 0)
    return let(el, body)


def previous_sibling(nodes: Column, el: Column, **kw) -> Column:
    """H9: nearest earlier sibling that matches."""
    return F.try_element_at(F.filter(nodes, lambda n: (n["parent"] == el["parent"]) & (n["id"] < el["id"])
                                     & match(n, **kw)), F.lit(-1))


def own_text_startswith(nodes: Column, el: Column, prefix: str) -> Column:
    """The element's only text piece starts with ``prefix``."""
    return let(F.filter(subtree(nodes, el), lambda n: n["tag"] == TEXT),
               lambda p: (F.size(p) == 1) & F.get(p, 0)["text"].startswith(prefix))


def between_markers(html: Column | str, start: str, end: str) -> Column:
    """Slice of raw HTML from ``start`` to the end of ``end`` (before
    parsing, so less is parsed)."""
    h = F.col(html) if isinstance(html, str) else html
    i = F.locate(start, h)
    j = F.locate(end, h)
    return F.when((i > 0) & (j >= i), h.substr(i, j + F.lit(len(end)) - i))


def cells(nodes: Column, row: Column) -> Column:
    """``td`` cells of a table row in order."""
    return find_all(nodes, row, tag="td")


def visible_text(nodes: Column, sep: str = " ") -> Column:
    """Whole-page ``get_text(separator=sep, strip=True)``: every text piece,
    stripped, empty ones dropped; script/style bodies and comments are not
    text (they are ``#raw`` / ``#comment`` nodes)."""
    return F.array_join(F.transform(nodes, lambda n: F.when(n["tag"] == TEXT, F.nullif(X.utrim(n["text"]), F.lit("")))),
                        sep)


def has_phrase(nodes: Column, phrase: Column | str) -> Column:
    """X17 test: case-insensitive phrase inside the visible text."""
    p = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.contains(F.lower(visible_text(nodes)), F.lower(p))
