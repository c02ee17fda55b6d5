"""Scalar text rules (F1-F18) as ``Column -> Column`` functions.

Every function here is a composition of built-in Spark expressions, so it
stays inside whole-stage codegen. Java regexes get the ``(?U)`` flag so that
``\\b \\d \\s \\w`` follow Unicode classes like Python 3 ``str`` patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str

# --- Fixed values that must equal the reference -----------------------------
UNKNOWN = "Unknown"
SANITIZE_DROP_PATTERN = r"\(.*?\)|[.,]"
SANITIZE_NUMBER_PATTERN = r"\b\d{1,3}\b|\b\d{5,}\b"
INVALID_NAME_CHARS = '<>:"/\\|?*'
PERSON_NAME_PATTERN = r"^[A-Za-z\s]+$"
JSON_OBJECT_PATTERN = r"\{[^}]+\}"
YEAR_WORD_PATTERN = r"\b(\d{4})\b"
MIN_PUBLICATION_YEAR = 1950
MAX_YEAR_TEXT_LENGTH = 50
ROLE_UNKNOWN = "?"
# Characters Python's str.strip()/split() treat as whitespace.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# Sentinels used when an element is missing (op F17), per record kind.
SENTINELS = {
    "scholar_author": {
        "name": "Name not available",
        "image_url": "Image not available",
        "homepage_url": "Homepage not available",
        "verified": "Email not available",
        "affiliation": "Affiliation not available",
        "interests": "Interests not available",
    },
    "scholar_publication": {
        "publication_id": "Publication ID not available",
        "title": "Title not available",
        "title_link": "Title link not available",
        "pdf_link": "PDF link not available",
        "conference": "Conference not available",
        "pages": "Pages not available",
        "publisher": "Publisher not available",
        "description": "Description not available",
        "related_articles_url": "No related articles link",
        "all_versions_url": "No all versions link",
    },
    "scholar_citation": {
        "title": "No Title",
        "link": "No Link",
        "summary": "No Summary",
        "document_link": "No Document link",
    },
    "scimago_journal": {"link": "N/A", "q_rank": "N/A"},
    "core_conference": {"dblp_link": "N/A"},
}
# --- end of fixed values ----------------------------------------------------


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: ColumnOrName) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def sanitize_text(c: ColumnOrName) -> Column:
    """venue text cleaning; null or empty gives ``Unknown``."""
    c = _c(c)
    step1 = F.regexp_replace(c, "(?U)" + SANITIZE_DROP_PATTERN, "")
    step2 = F.regexp_replace(step1, "(?U)" + SANITIZE_NUMBER_PATTERN, "")
    return F.when(c.isNull() | (c == ""), F.lit(UNKNOWN)).otherwise(utrim(step2))


def conference_acronym(c: ColumnOrName) -> Column:
    """first whitespace-separated word, else ``Unknown``."""
    first = F.regexp_extract(_c(c), r"(?U)\S+", 0)
    return F.coalesce(F.nullif(first, F.lit("")), F.lit(UNKNOWN))


def year_or_unknown(c: ColumnOrName) -> Column:
    """F3 value rule: keep a 4-digit text, else ``Unknown``."""
    c = utrim(c)
    return F.when(c.rlike(r"(?U)^\d{4}$"), c).otherwise(F.lit(UNKNOWN))


def sanitize_string(c: ColumnOrName) -> Column:
    """strip, then drop the characters invalid in names."""
    return F.translate(utrim(c), INVALID_NAME_CHARS, "")


def after_last_eq(c: ColumnOrName) -> Column:
    """text after the last ``=``; null when there is no ``=``."""
    c = _c(c)
    return F.when(c.contains("="), F.substring_index(c, "=", -1))


def extract_id_from(url: ColumnOrName, var_name: str) -> Column:
    """first ``<var>=digits`` anywhere in the URL, else null."""
    return F.nullif(F.regexp_extract(_c(url), f"(?U){var_name}=(\\d+)", 1), F.lit(""))


def url_param(url: ColumnOrName, pattern: str) -> Column:
    """first group of an unanchored pattern, null when absent."""
    url = _c(url)
    return F.when(url.rlike(pattern), F.regexp_extract(url, pattern, 1))


def org_id(url: ColumnOrName) -> Column:
    return url_param(url, r"(?U)org=(\d+)")


def user_id(url: ColumnOrName) -> Column:
    return url_param(url, r"user=([^&]+)")


def user_id_strict(url: ColumnOrName) -> Column:
    return url_param(url, r"user=([a-zA-Z0-9_-]+)")


def citation_for_view(url: ColumnOrName) -> Column:
    return url_param(url, r"citation_for_view=([^&]+)")


def as_ylo(url: ColumnOrName) -> Column:
    """Year between ``as_ylo=`` and the next ``&`` (or the end)."""
    return url_param(url, r"as_ylo=([^&]*)")


def affiliation_split(c: ColumnOrName) -> Column:
    """F8: struct(role, org) from an affiliation line."""
    c = _c(c)
    at = F.split(c, "@", -1)
    comma = F.split(c, ",", -1)
    role = (F.when(F.size(at) == 2, utrim(at.getItem(0)))
            .when(F.size(comma) == 2, utrim(comma.getItem(0)))
            .otherwise(F.lit(ROLE_UNKNOWN)))
    org = (F.when(F.size(at) == 2, utrim(at.getItem(1)))
           .when(F.size(comma) == 2, utrim(comma.getItem(1)))
           .otherwise(c))
    return F.struct(role.alias("role"), org.alias("org"))


def first_year_word(c: ColumnOrName) -> Column:
    """the first stand-alone 4-digit word as an int (null if none)."""
    return F.nullif(F.regexp_extract(_c(c), "(?U)" + YEAR_WORD_PATTERN, 1), F.lit("")).try_cast(T.IntegerType())


def publication_year(c: ColumnOrName, as_of_year: int) -> Column:
    """a value that starts with 4 digits, is shorter than 50 chars and
    lies in [1950, as_of_year] gives that year; anything else gives null."""
    c = _c(c)
    year = F.substring(c, 1, 4).try_cast(T.IntegerType())
    ok = c.rlike(r"(?U)^\d{4}") & (F.length(c) < MAX_YEAR_TEXT_LENGTH) & year.between(MIN_PUBLICATION_YEAR, as_of_year)
    return F.when(ok, year)


def split_trim(c: ColumnOrName, sep: str = ",") -> Column:
    """split on a separator and strip every piece."""
    return F.transform(F.split(_c(c), sep, -1), lambda x: utrim(x))


def is_person_name(c: ColumnOrName) -> Column:
    """exactly one space character and only ASCII letters/whitespace."""
    c = _c(c)
    return (F.size(F.split(c, " ", -1)) == 2) & c.rlike("(?U)" + PERSON_NAME_PATTERN)


def json_objects(c: ColumnOrName) -> Column:
    """every ``{...}`` span without a closing brace inside."""
    return F.regexp_extract_all(_c(c), F.lit(JSON_OBJECT_PATTERN), 0)


def names_from_json(objects: ColumnOrName) -> Column:
    """parse each object as ``map<string,string>``; keep the values that
    pass F12; objects that are not valid JSON are skipped."""
    parsed = F.transform(_c(objects), lambda o: F.from_json(
        o, T.MapType(T.StringType(), T.StringType()), {"allowSingleQuotes": "false"}))
    values = F.flatten(F.transform(F.filter(parsed, lambda m: m.isNotNull()), lambda m: F.map_values(m)))
    return F.filter(values, lambda v: v.isNotNull() & is_person_name(v))


def root_names(text: ColumnOrName) -> Column:
    """S11 on one text: names found in JSON-like objects, reversed."""
    return F.reverse(names_from_json(json_objects(text)))


def parse_json_doc(c: ColumnOrName, schema: T.DataType) -> Column:
    """JSON text to a typed value; malformed input fails the job."""
    return F.from_json(_c(c), schema, {"mode": "FAILFAST"})


def message_to_json(message_type: ColumnOrName, message_id: ColumnOrName,
                    content: ColumnOrName, timestamp: ColumnOrName) -> Column:
    """F16: message envelope as JSON text."""
    return F.to_json(F.struct(_c(message_type).alias("message_type"), _c(message_id).alias("message_id"),
                              _c(content).alias("content"), _c(timestamp).alias("timestamp")))


def message_from_json(c: ColumnOrName) -> Column:
    schema = "message_type STRING, message_id STRING, content STRING, timestamp STRING"
    return F.from_json(_c(c), schema)


def page_id(year: ColumnOrName, page: ColumnOrName) -> Column:
    """``year_page`` identifier."""
    return F.concat_ws("_", _c(year).cast("string"), _c(page).cast("string"))


def next_page(page: ColumnOrName) -> Column:
    """next page number as text."""
    return (_c(page).try_cast(T.IntegerType()) + 1).cast("string")


def split_seed_list(c: ColumnOrName) -> Column:
    """Split a config string on ``,`` (no trim); ``;`` is an error."""
    c = _c(c)
    return F.when(c.contains(";"), F.raise_error(F.lit("Input string contains a semicolon"))) \
        .otherwise(F.split(c, ",", -1))
