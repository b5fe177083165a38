"""Text expressions. All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
STOPWORDS = (
    "a", "an", "the", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by",
    "from", "as", "is", "was", "are", "were", "been", "be", "has", "have", "had",
    "this", "that", "these", "those", "its", "their", "new", "after", "over", "into",
    "says", "said", "will", "indian", "india", "defence", "military",
)

# First matching state wins.
EPISTEMIC = (
    ("RETRACTED", r"retract(?:s|ed|ing|ion)|walks?\s+back|erroneous\s+report|withdrawn"),
    ("DISPUTED", r"deni(?:es|ed)|refut(?:es|ed)|disput(?:es|ed|ing)|false\s+claim|clarif(?:ies|ied)\s+fake"),
    ("SUPERSEDED", r"supersed(?:es|ed|ing)|replac(?:es|ed|ing)|revis(?:es|ed)|updat(?:es|ed)\s+earlier\s+order"),
    ("CONTESTED", r"unconfirmed|conflicting\s+reports|differing\s+claims|unverified|claimed|speculat(?:ion|ed)"),
)


def has_word(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` occurs between ASCII word boundaries, in any case. Most texts do not have it at all, which is found out sooner without the boundaries."""
    return F.coalesce(text.rlike(f"(?i)(?:{pattern})") & text.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"), F.lit(False))


def tokens(text: Column) -> Column:
    """The distinct topical tokens of a text; null has none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def epistemic_state(text: Column) -> Column:
    state = F.lit("CONFIRMED")
    for name, pattern in reversed(EPISTEMIC):
        state = F.when(has_word(text, pattern), name).otherwise(state)
    return state


# Parameters that only track where a click came from.
TRACKING = (
    "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source",
    "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term",
)


def canonical_url(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """Lower-case scheme and host, no fragment and default port, no tracking keys, sorted parameters, single slashes, no trailing slash
    (an empty path is ``/``). Null for addresses that are not of the web."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    head = F.lower(F.regexp_replace(F.regexp_extract(plain, r"^([A-Za-z]+://[^/?]*)", 1), r":(80|443)$", ""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(plain, r"^[A-Za-z]+://[^/?]*([^?]*)", 1), r"/{2,}", "/"), r"/$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*tracking)))
    whole = F.concat(head, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.lower(plain).rlike("^https?://"), whole)


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags go, white space collapses."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?s)<[^>]*>", " "), r"\s+", " ")
    return F.trim(plain)


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def utf16_units(text: Column) -> Column:
    """The UTF-16 units of a text as numbers."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "utf-16be")), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))


def fnv1a(units: Column, start: int = 0x811C9DC5) -> Column:
    """FNV-1a with 32 bits over an array of numbers, as a number."""
    mask = F.lit(0xFFFFFFFF)
    return F.aggregate(units, F.lit(start).cast("long"), lambda s, c: (s.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(mask))


def stable_hash(text: Column) -> Column:
    """FNV-1a with 32 bits over the UTF-16 units of the trimmed lower-case text, as 8 hex digits."""
    return F.lpad(F.lower(F.hex(fnv1a(utf16_units(F.lower(F.trim(text)))))), 8, "0")


def page_article(html: Column) -> tuple[Column, Column]:
    """(title, snippet) of a page: its text is the title, a stop and the body; the first sentence, at most 200 characters, is the title, the first 500 characters are the snippet."""
    from storyloom.functions.cleaning import named_entities

    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    whole = F.concat(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(". "), body)
    plain = F.trim(F.regexp_replace(named_entities(whole), r"\s+", " "))
    return F.substring(F.trim(F.regexp_extract(plain, r"^([^.!?]*)", 1)), 1, 200).alias("title"), F.substring(plain, 1, 500).alias("snippet")
