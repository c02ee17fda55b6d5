"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page is cut into blocks of text at block-level tags. Every block gets two
costs from a linear classifier over its ancestors' tags and class words, its
link share, length and punctuation: what it costs to call it boilerplate
(capacity from the source) and to call it content (capacity to the sink).
Blocks that follow each other, and blocks with the same parent element or the
same section, are joined by smoothness edges, so a short line between two
paragraphs stays with them. A maximum flow separates content (source side)
from boilerplate.

One Arrow pass, no shuffle; a page's graph has one node per block.

Edge cases: null or empty html gives the empty text; unclosed elements and
comments end with the page; character references are decoded, white space in
a block becomes one space, blocks are joined by an empty line in page order;
repeated pages are rows of their own.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import OPEN_TAG, Unclosed
from ..session import table
from .common import strings

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose text is never shown as text of the page.
DROPPED = frozenset("script style template noscript iframe svg math canvas object head textarea select option button audio video datalist".split())
_RAW = frozenset("script style textarea title iframe noscript template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Blocks that hold running text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption dd".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open paragraph.
_ENDS_P = BLOCK - {"body", "caption", "head", "html", "legend", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
#: Opening the key ends the nearest open element of the values, up to the scope's edge.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: What can stand in a head; anything else, and text, ends it (</head> may be left out).
_IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Evidence of a tag or of a word in class, id, role or label (positive: content).
TAG_EVIDENCE = {"article": 5.0, "main": 4.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "header": -4.0, "menu": -9.0, "dialog": -9.0, "search": -9.0}
_AGAINST = frozenset("""ad ads adbox adslot adsbygoogle adunit adv advert advertisement adverts advertising alert announcement banner breadcrumb breadcrumbs captcha
 comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus feedback footer footnav form gdpr header legal login masthead
 menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion rail reactions recommended related
 replies reply respond responses search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar tracking trending widget widgets""".split())
_FOR = frozenset("article articlebody body content entry main maincontent post story text".split())
AGAINST, FOR = -9.0, 2.0
#: Names that say what an element has, how it is laid out or filed, not what it is.
_STATES = "open opened closed on off enabled disabled active inactive visible hidden collapsed expanded layout none"
_MODIFIER = re.compile(rf"""(?:has|have|no|not|non|with|without|is|show|shows|hide|hides|enable|disable|layout|template|theme)(?:[-_]|(?=[A-Z]))
 |(?:category|cat|tag|tagged|topic|type|format|status)[-_](?!nav|menu|sidebar|widget|header|footer|search|toolbar)
 |.*(?:[-_](?:{_STATES.replace(" ", "|")})|(?<=[a-z])(?:{_STATES.title().replace(" ", "|")}))$""", re.X)
#: Elements whose text is the page's own, and headings of its first level.
_LANDMARK = frozenset("article main h1".split())
#: Running text: characters of a block, share that may be linked; share of an
#: element's running text up to which other text of the page is a rest.
RUNNING, LINKED, REST = 50, 0.5, 0.1
#: Smoothness: consecutive blocks, blocks with one parent, blocks of one section.
ADJACENT, SIBLING, SECTION = 0.4, 0.8, 0.3


def _names(name: str, value: str) -> set[str]:
    """The words of a class, id, role or label, without those of modifiers."""
    words: set[str] = set()
    for part in value.split() if name in ("class", "id") else (value,):
        if name not in ("class", "id") or not _MODIFIER.match(part):
            words.update(w.lower() for w in _WORDS.findall(part))
    return words


def _evidence(tag: str, attributes: str) -> tuple[float, bool, bool]:
    """(evidence of this element, hidden, held against it by a name)."""
    score = TAG_EVIDENCE.get(tag, 0.0)
    if not attributes or attributes.isspace():
        return score, False, False
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and m[2] is None and m[3] is None and m[4] is None:
            return score, True, False
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return score, True, False
        elif name != "hidden":
            words |= _names(name, value)
    if tag in ("html", "body"):  # page-wide words say nothing about a block
        return score, False, False
    against = words & _AGAINST
    if against == {"header"} and words & _FOR:  # the heading of an article
        against = set()
    if against:
        score += AGAINST
    elif words & _FOR:
        score += FOR
    return score, False, bool(against)


def _other_words_against(attributes: str) -> bool:
    """Does a class or id hold another word against the element than header?"""
    return any(w in _AGAINST and w != "header" for m in _ATTRIBUTE.finditer(attributes) for w in _names(m[1].lower(), m[2] or m[3] or m[4] or ""))


class Block:
    __slots__ = ("text", "parent", "section", "evidence", "linked", "prose", "marks")

    def __init__(self, text: str, parent: int, section: int, evidence: float, linked: int, prose: bool, marks: tuple[int, ...] = ()):
        self.text, self.parent, self.section, self.evidence, self.linked, self.prose, self.marks = text, parent, section, evidence, linked, prose, marks

    @property
    def running(self) -> int:
        """Characters of running text."""
        n = len(self.text)
        return n if n >= RUNNING and self.linked <= LINKED * n else 0


def _clear_names(blocks: list[Block], landmarks: set[int]) -> None:
    """A name, or being a form, says nothing against an element that holds the page's running
    text (an article, main, first heading or three such blocks, and outside
    of it no more than a rest that nothing is held against)."""
    for mark in sorted({k for b in blocks for k in b.marks}):  # outer elements first
        inside = [b for b in blocks if mark in b.marks and b.evidence - AGAINST * len(b.marks) >= 0]
        held = sum(b.running for b in inside)
        if not held or not (mark in landmarks or sum(1 for b in inside if b.running) >= 3):
            continue
        if sum(b.running for b in blocks if mark not in b.marks and b.evidence >= 0) <= REST * held:
            for b in blocks:
                if mark in b.marks:
                    b.evidence -= AGAINST
                    b.marks = tuple(k for k in b.marks if k != mark)


def _tags(page: str) -> Iterator[re.Match]:
    """The tags, comments and declarations of a page, in order; a tag whose
    quote never ends is text, and is not scanned again from each of its parts."""
    open_tags = Unclosed(page)
    at = page.find("<")
    while at >= 0:
        m = None if open_tags.scans and open_tags.known(at) and OPEN_TAG.match(page, at) else _TAG.match(page, at)
        if m:
            yield m
        elif OPEN_TAG.match(page, at) and not open_tags.known(at):
            open_tags.add(at)
        at = page.find("<", m.end() if m else at + 1)


def blocks_of(page: str) -> list[Block]:
    """The visible text blocks of a page with their DOM context."""
    out: list[Block] = []
    # an open element: tag, id, evidence summed over ancestors, dropped, section id, marks of what is held against it (names, being a form)
    stack: list[tuple[str, int, float, bool, int, tuple[int, ...]]] = [("", 0, 0.0, False, 0, ())]
    landmarks: set[int] = set()  # of those ids: with a landmark inside
    pieces: list[str] = []
    linked = ids = links = at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                tag, parent, evidence, _, section, marks = next(e for e in reversed(stack) if e[0] in BLOCK or not e[0])
                out.append(Block(text, parent, section, evidence, min(linked, len(text)), tag in PROSE, marks))
            pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links
        for e in stack[depth:]:
            links -= e[0] == "a"
        del stack[depth:]

    for m in _tags(page):
        if m.start() < at:  # inside raw text that was skipped
            continue
        if stack[-1][0] == "head" and m.start() > at and not page[at:m.start()].isspace():
            close(len(stack) - 1)
        if m.start() > at and not stack[-1][3]:
            piece = page[at:m.start()]
            pieces.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        name = m[2]
        if not name:
            continue
        tag = name.lower()
        if tag in BLOCK:
            flush()
        elif tag == "br" and not stack[-1][3]:
            pieces.append(" ")
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        if stack[-1][0] == "head" and tag not in _IN_HEAD:
            close(len(stack) - 1)
        if tag in _VOID:
            continue
        if tag in _ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
        if tag in _ENDS:
            ended, edge = _ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in ended:
                    close(depth)
                    break
                if stack[depth][0] in edge:
                    break
        ids += 1
        _, _, above, dropped, section, marks = stack[-1]
        score, hidden, against = _evidence(tag, m[3])
        if above > 0 and (tag == "header" or "header" in m[3]) and score in (TAG_EVIDENCE["header"], AGAINST, TAG_EVIDENCE["header"] + AGAINST) and not _other_words_against(m[3]):
            score, against = 0.0, False  # the heading of an article, not of the page
        if against:
            marks = (*marks, 2 * ids)
        if tag == "form":  # some pages are one form
            marks = (*marks, 2 * ids + 1)
        if tag in _LANDMARK and marks:
            landmarks.update(marks)
        links += tag == "a"
        stack.append((tag, ids, above + score, dropped or hidden or tag in DROPPED, ids if score or tag in ("section", "div", "article") else section, marks))
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            if tag in DROPPED or dropped or hidden:
                at = end.start() if end else len(page)
    if stack[-1][0] == "head" and not page[at:].isspace():
        close(len(stack) - 1)
    if at < len(page) and not stack[-1][3]:
        pieces.append(page[at:])
    flush()
    if any(b.marks for b in out):
        _clear_names(out, landmarks)
    return out


def costs(b: Block) -> float:
    """Cost of calling the block boilerplate less that of calling it content."""
    n = len(b.text)
    score = max(-12.0, min(8.0, b.evidence))
    score -= 4.0 * (b.linked / n) if b.linked else 0.0
    score += 1.5 if n >= 120 else 0.7 if n >= 50 else -0.6
    if b.text[-1] in ".!?\"'”’»…:;":
        score += 0.5
    if b.prose:
        score += 0.6
    return score - 0.3


def minimum_cut(net: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of the least cut. net > 0 is
    capacity from the source, net < 0 capacity to the sink; edges count both
    ways. Flow is pushed along all shortest ways at once, layer by layer, so a
    page costs a few passes over its blocks."""
    n = len(net)
    to: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n)]
    for a, b, w in edges:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to += (b, a)
        room += (w, w)
    left = net[:]
    eps = 1e-9
    while True:
        layer = [0 if x > eps else -1 for x in left]
        queue = deque(i for i in range(n) if layer[i] == 0)
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or left[i] < -eps
            for e in arcs[i]:
                if room[e] > eps and layer[to[e]] < 0:
                    layer[to[e]] = layer[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in layer]
        at = [0] * n  # arcs before this one lead nowhere in this round
        for source in (i for i in range(n) if left[i] > eps):
            way: list[int] = []
            i = source
            while left[source] > eps:
                if left[i] < -eps:
                    flow = min(left[source], -left[i], *(room[e] for e in way))
                    left[source] -= flow
                    left[i] += flow
                    for e in way:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    way, i = [], source
                    continue
                while at[i] < len(arcs[i]) and not (room[arcs[i][at[i]]] > eps and layer[to[arcs[i][at[i]]]] == layer[i] + 1):
                    at[i] += 1
                if at[i] < len(arcs[i]):
                    way.append(arcs[i][at[i]])
                    i = to[way[-1]]
                elif way:
                    i = to[way.pop() ^ 1]
                    at[i] += 1
                else:
                    break


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    out = [(i - 1, i, ADJACENT) for i in range(1, len(blocks))]
    for key, weight in (("parent", SIBLING), ("section", SECTION)):
        last: dict[int, int] = {}
        for i, b in enumerate(blocks):
            k = getattr(b, key)
            if k in last:
                out.append((last[k], i, weight))
            last[k] = i
    return out


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text, blocks, blocks kept)."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return "", 0, 0
    kept = minimum_cut([costs(b) for b in blocks], edges_of(blocks))
    texts = [b.text for b, k in zip(blocks, kept) if k]
    return "\n\n".join(texts), len(blocks), len(texts)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_blocks, n_kept of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(p) for p in strings(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], ["page_id", "url", "text", "n_blocks", "n_kept"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_blocks long, n_kept long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: Plain reading of the given pages, whose main text is one article element.
OP1_SQL = r"""
WITH a AS (
  SELECT page_id, url, string_split_regex(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>', ' ', 'g'), '</?(?:p|h1)>') AS parts
  FROM pages
), t AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;?', '''', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks
  FROM a
), j AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM j
"""
