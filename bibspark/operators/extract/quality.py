"""Blocked-page and challenge-page classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import html as H
from .common import with_nodes

# --- Fixed values that must equal the reference (block phrases by source and
# page kind; the URL rule holds for the Scholar search page only) ------------
PHRASES = [
    ("google_scholar", "search", "We're sorry..."),
    ("google_scholar", "citations", "We're sorry..."),
    ("google_scholar", "citations", "That’s an error."),
    ("google_scholar", "versions", "We're sorry..."),
    ("google_scholar", "versions", "Error"),
    ("dblp", "search", "Too Many Requests"),
    ("core_edu", "ranking", "Server Error"),
]
URL_RULE = ("google_scholar", "search")
CHALLENGE_CALL = "grecaptcha.render"
CHALLENGE_FRAME_TITLE = "reCAPTCHA"
SITE_KEY_PATTERN = r'"sitekey":"(.*?)"'
# --- end of fixed values ----------------------------------------------------


def classify(pages: DataFrame, keys: Sequence[str], phrases: Sequence[tuple[str, str, str]] = PHRASES,
             url_col: str = "url", iface_col: str = "iface", kind_col: str = "page_kind") -> DataFrame:
    """X17 + X18 per page, from one parse.

    ``blocked_by``: the phrases of the page's source and kind (and, on the
    Scholar search page, the request URL itself) found case-insensitively in
    the visible text. ``challenge``: the first script that calls
    ``grecaptcha.render`` holds a site key and an iframe titled ``reCAPTCHA``
    exists; ``site_key`` is that key. ``text_len``: length of the visible text.
    """
    keys = list(keys)
    p = with_nodes(pages.select(*dict.fromkeys([*keys, url_col, iface_col, kind_col, "html"])))
    n = F.col("nodes")
    text = F.lower(H.visible_text(n))
    at = lambda i, k: (F.col(iface_col) == i) & (F.col(kind_col) == k)
    # a handful of rules: the candidates of a page are built from its source and kind
    cand = F.array(*[F.when(at(i, k), F.lit(ph)) for i, k, ph in phrases], F.when(at(*URL_RULE), F.col(url_col)))
    found = F.filter(cand, lambda ph: F.coalesce(F.contains(text, F.lower(ph)), F.lit(False)))
    scripts = F.filter(n, lambda s: (s["tag"] == "script"))
    # a script's own string: its single raw-text child
    bodies = F.transform(scripts, lambda s: F.get(F.filter(n, lambda c: (c["parent"] == s["id"])
                                                           & (c["tag"] == H.RAW)), 0)["text"])
    first = F.get(F.filter(bodies, lambda b: F.contains(b, F.lit(CHALLENGE_CALL))), 0)
    key = F.regexp_extract(first, SITE_KEY_PATTERN, 1)
    has_key = F.coalesce(first.rlike(SITE_KEY_PATTERN), F.lit(False))
    frame = F.exists(n, lambda f: (f["tag"] == "iframe") & (f["attrs"]["title"] == CHALLENGE_FRAME_TITLE))
    return p.select(*keys, found.alias("blocked_by"), (F.size(found) > 0).alias("blocked"),
                    (has_key & frame).alias("challenge"), F.when(has_key & frame, key).alias("site_key"),
                    F.length(H.visible_text(n)).alias("text_len"))
