"""Cleaning of titles, snippets, tags and addresses, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities that are decoded, in this order; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = (
    ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&ndash;", "-"), ("&mdash;", "—"), ("&hellip;", "…"),
    ("&lsquo;", "'"), ("&rsquo;", "'"), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&trade;", "™"), ("&copy;", "©"), ("&reg;", "®"), ("&bull;", "•"),
    ("&middot;", "·"), ("&euro;", "€"), ("&pound;", "£"), ("&yen;", "¥"), ("&amp;", "&"),
)

# Tags that say nothing about the topic.
NOISE_TAGS = (
    "news", "india", "indian", "defence", "defense", "security", "update", "updates", "topnews", "breakingnews", "national", "international", "general", "latest",
    "article", "articles", "pressrelease", "pressreleases", "world", "asia", "southasia", "mod", "ministryofdefence", "editorial", "opinion", "report", "reports",
    "alert", "alerts", "brief", "briefing", "analysis", "exclusive", "indianews", "latestnews", "idrwteam", "idrw", "andhrapradesh", "space", "trending",
    "operational", "strategic", "acquisition", "modernization", "systems", "arc", "delivery",
)

# Acronyms that are written in capitals.
ACRONYMS = (
    "tasl", "lac", "loc", "drdo", "hal", "iaf", "mod", "dac", "ccs", "amca", "qrsam",
    "bmd", "uav", "ucav", "eos", "ins", "bvr", "mbrl", "atgm", "lracm", "erads",
)

# Notices of other publishers around a text.
NOTICE_BEFORE = (
    r"(?i)^This\s+article\s+was\s+(?:originally\s+)?published\s+(?:on|in|at)\s+[^.\n]+(?:\.[a-z]{2,6})?\.?\s*",
    r"(?i)^(?:Originally\s+published\s+(?:on|in|at)|First\s+published\s+(?:on|in|at)|Cross-posted\s+from|Source:\s*)\s*[^.\n]+(?:\.[a-z]{2,6})?\.?\s*",
    r"(?i)^Published\s+first\s+on\s+[^.\n]+(?:\.[a-z]{2,6})?\.?\s*",
    r"(?i)^Also\s+read:\s*",
)
NOTICE_AFTER = (
    r"(?i)\s*(?:The\s+post\s+[\s\S]*?\s+appeared\s+first\s+on[\s\S]*|Read\s+(?:the\s+)?full\s+article\s+(?:on|at)\s+.*|Read\s+more(?:\s+at|\s+on|\s*:)?.*|Continue\s+reading(?:\s+on|\s+at)?.*"
    r"|Click\s+here\s+to\s+read\s+more.*|Full\s+article\s+at\s+.*|Also\s+read\s*:.*|Follow\s+us\s+on\s+.*|Photo\s+credit\s*:.*|Image\s+courtesy\s*:.*)\s*$",
    r"(?i)\s*\[\s*\+\d+\s*chars\s*\]\s*$",
    r"(?i)\s*\[\s*(?:\.\.\.|…|&#8230;)\s*\]\s*$",
)

# Words that a cut text must not end in.
DANGLING = (
    "and|or|the|a|an|in|on|at|to|for|of|with|by|from|as|is|was|are|were|be|been|that|this|these|those|which|who|whom|whose|if|then|else|when|where|why|how|not|but|so|yet"
    "|into|onto|upon|about|above|below|between|under|over|their|its|his|her|my|our|your"
)


def replaced(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, rule: F.replace(t, F.lit(rule[0]), F.lit(rule[1])), rules, text)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, in which ``value`` is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numeric_entities(text: Column) -> Column:
    """Decimal and hexadecimal character references; those of control characters and of no character go."""

    def char(part: Column) -> Column:
        digits = F.regexp_extract(part, "^(x[0-9a-fA-F]{1,8}|[0-9]{1,9});", 1)
        code = F.when(digits.startswith("x"), F.conv(F.substring(digits, 2, 8), 16, 10)).otherwise(digits).try_cast("long")
        some = code.between(32, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # a byte order mark comes first, or one that is referred to would be taken for it
        of = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")
        return F.when(digits == "", F.concat(F.lit("&#"), part)).otherwise(F.concat(F.when(some, of).otherwise(""), F.substring(part, F.length(digits) + 2, F.length(part))))

    return bound(F.split(text, "&#", -1), lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), char), "")))


def _without_cdata(text: Column) -> Column:
    return F.when(text.contains("<!["), F.regexp_replace(text, r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1")).otherwise(text)


def decode_entities(text: Column) -> Column:
    """Named and numeric entities as characters; CDATA marks go."""
    return bound(bound(text, _without_cdata), lambda t: F.trim(F.when(t.contains("&"), replaced(F.when(t.contains("&#"), _numeric_entities(t)).otherwise(t), ENTITIES)).otherwise(t)))


def named_entities(text: Column) -> Column:
    """As ``decode_entities``, but numeric entities stay."""
    return F.trim(replaced(F.regexp_replace(text, r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1"), ENTITIES))


def plain_text(html: Column) -> Column:
    """Text without markup: scripts, styles, drawings and frames go with what they hold, other tags alone."""

    def bare(h: Column) -> Column:
        body = F.regexp_replace(h, r"(?is)<(script|style|svg|iframe)[^>]*>.*?</\1>", "")
        return F.when(h.contains("<"), F.regexp_replace(body, r"(?s)<[^>]*>?", "")).otherwise(h)

    return decode_entities(bound(html, bare))


def strip_notices(text: Column) -> Column:
    for pattern in (*NOTICE_BEFORE, *NOTICE_AFTER):
        text = F.trim(F.regexp_replace(text, pattern, ""))
    return F.coalesce(text, F.lit(""))


def cut(text: Column, most: int = 280, least: int = 120) -> Column:
    """``text`` on one line, of at most ``most`` characters: up to the last sentence end from ``least`` on, else up to a word that may end it, with dots."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    ended = clean.rlike(r"[.!?][\"'”’)]*$") | clean.endswith("...") | clean.endswith("…")
    # the last sentence end at least ``least`` and at most ``most`` characters from the start
    head = F.regexp_extract(clean, r"^(.{%d,%d}[.!?][\"'”’)]*)(?:\s|$)" % (max(0, least - 1), most - 1), 1)
    head = F.when(F.length(head) <= most, head).otherwise("")
    dangles = clean.rlike(rf"(?i)\s(?:{DANGLING})$")
    piece = F.substring(clean, 1, most)
    word = F.when(F.length(piece) - F.length(F.substring_index(piece, " ", -1)) - 1 >= 30, F.regexp_replace(piece, r" [^ ]*$", "")).otherwise(piece)
    word = F.regexp_replace(word, rf"(?i)(?:\s+(?:{DANGLING}))+\s*$", "")
    word = F.trim(F.regexp_replace(word, r"[,;:\s\-—–]+$", ""))
    dots = F.when(word.endswith("...") | word.endswith("…"), word).when(word.endswith("."), F.concat(F.expr("''"), F.regexp_replace(word, r"\.$", ""), F.lit("..."))).otherwise(F.concat(word, F.lit("...")))
    return (
        F.when(clean == "", "").when((F.length(clean) <= most) & ended, clean).when(head != "", F.trim(head)).when((F.length(clean) <= most) & ~dangles, clean).otherwise(dots)
    )


def source_name(name: Column) -> Column:
    """A publisher's short name: known ones by alias, others without what stands in brackets or after a dash at the end."""
    clean = F.trim(F.coalesce(name, F.lit("")))
    short = F.trim(F.regexp_replace(F.regexp_replace(clean, r"\s*\([^)]*\)\s*$", ""), r"\s*[-—–]\s+[A-Za-z0-9 &.,]+$", ""))
    # Publishers that are known by another name.
    known = (("Press Information Bureau", "PIB"), ("ADG PI", "Indian Army"), ("SpokespersonNavy", "Indian Navy"), ("Asian News International", "ANI"))
    found = F.when(short == "", clean).otherwise(short)
    for start, alias in reversed(known):
        found = F.when(F.lower(clean).startswith(start.lower()), alias).otherwise(found)
    return found


def headline(text: Column) -> Column:
    """A headline on one line without stops at its end, unless it ends in initials."""
    clean = F.trim(F.regexp_replace(named_entities(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return F.when(clean.rlike(r"(?i)\b(?:[A-Z]\.){2,}$"), clean).otherwise(F.trim(F.regexp_replace(clean, r"[\s.;:]+$", "")))


# --- tags and slugs


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def node_id(label: Column) -> Column:
    found = slug(F.trim(F.coalesce(label, F.lit(""))))
    return F.concat(F.lit("node_"), F.when(found == "", "unknown").otherwise(found))


def _bare(tag: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(tag, F.lit(""))), r"^#+", ""), r"(?i)^th[_-]", ""))


def is_noise_tag(tag: Column, noise: tuple[str, ...] = NOISE_TAGS) -> Column:
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(tag, F.lit("")), r"^#", "")), r"[\s\-_]+", "")
    return bound(plain, lambda p: (F.length(p) <= 1) | p.isin(*noise))


def clean_tag(tag: Column) -> Column:
    """A tag without marks; if it is all in small letters, each part gets a capital and acronyms are written in capitals."""
    return bound(_bare(tag), _written)


def _written(bare: Column) -> Column:
    parts = F.transform(
        F.split(F.regexp_replace(bare, r"([-_ ])", "\u0001$1\u0001"), "\u0001"),
        lambda p: F.when(p.rlike(r"^[-_ ]*$"), p)
        .when(F.lower(p).isin(*ACRONYMS), F.upper(p))
        .when(p.rlike(r"(?i)^mk[0-9]+[a-z]?$"), F.concat(F.lit("Mk"), F.upper(F.substring(p, 3, 100))))
        .otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))),
    )
    return F.when(bare.rlike("[A-Z]"), bare).otherwise(F.array_join(parts, ""))


def tag_slug(tag: Column) -> Column:
    """``th_`` and the tag in small letters, split where capitals or digits begin; empty for an empty tag."""
    split = F.regexp_replace(F.regexp_replace(_bare(tag), r"([a-z])([A-Z])", "$1-$2"), r"([A-Z]+)([A-Z][a-z])", "$1-$2")
    found = slug(F.regexp_replace(split, r"\b(?![mM][kK]\d)([a-zA-Z]{2,})(\d{2,})\b", "$1-$2"))
    return F.when(found == "", "").otherwise(F.concat(F.lit("th_"), found))


def _split_numbers(bare: Column) -> Column:
    return F.regexp_replace(bare, r"\b(?![mM][kK]\d)([a-zA-Z]{2,})(\d{2,})\b", "$1-$2")


def canonical_tag(tag: Column) -> Column:
    return F.when(is_noise_tag(tag), "").otherwise(clean_tag(_split_numbers(_bare(tag))))


def tag_names(tags: Column) -> Column:
    """The canonical tag of each of ``tags``, or the clean one where that is empty; null for null. Each step is taken once for all tags, as steps inside steps are worked out again and again."""
    bare = F.transform(tags, lambda t: F.struct(is_noise_tag(t).alias("noise"), F.when(t.isNotNull(), _bare(t)).alias("bare")))
    split = F.transform(bare, lambda x: F.struct(x["bare"].alias("bare"), F.when(~x["noise"], _bare(_split_numbers(x["bare"]))).alias("split")))
    # what is written of a text is empty if the text is
    return F.transform(F.transform(split, lambda x: F.when(F.length(x["split"]) > 0, x["split"]).otherwise(x["bare"])), _written)


# --- variants of names

# Acronyms with what they stand for, and words one of which must be near an ambiguous one.
EXPANSIONS = {
    "LAC": ("Line of Actual Control",), "LOC": ("Line of Control",), "DAC": ("Defence Acquisition Council", "Defense Acquisition Council"),
    "HAL": ("Hindustan Aeronautics",), "INS": ("Indian Naval Ship",),
}
ANCHORS = {
    "LAC": ("China", "PLA", "border", "patrol", "Ladakh", "Arunachal", "standoff", "Line of Actual Control", "buffer zone"),
    "INS": ("Navy", "warship", "frigate", "destroyer", "submarine", "port", "maritime", "naval"),
    "DAC": ("procurement", "Rajnath", "MoD", "clearance", "order", "capital acquisition", "tender"),
    "HAL": ("aviation", "aircraft", "helicopter", "aeronautics", "Tejas", "Prachand", "Rudra", "fighter", "aerospace"),
    "LOC": ("Pakistan", "ceasefire", "border", "Line of Control", "Kashmir", "Jammu", "infiltration", "cross-border"),
}


def escaped(pattern: Column) -> Column:
    """``pattern`` as a regular expression that matches it alone."""
    return F.regexp_replace(pattern, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def name_pattern(name: Column) -> Column:
    """A regular expression for a name and its variants: with spaces for hyphens and before capitals, expansions of acronyms, acronyms split off."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^#+", ""), r"(?i)^th[_-]", ""))
    spaced = F.regexp_replace(F.regexp_replace(bare, r"([a-z])([A-Z])", "$1 $2"), r"[_-]+", " ")
    more = F.array().cast("array<string>")
    for acronym, names in EXPANSIONS.items():
        more = F.when(F.upper(bare) == acronym, F.array(*map(F.lit, names))).otherwise(more)
    split = F.when(bare.rlike("(?i)^(HAL|INS|DAC|LAC|LOC)."), F.array(F.regexp_replace(bare, "(?i)^(HAL|INS|DAC|LAC|LOC)", "$1 "))).otherwise(F.array().cast("array<string>"))
    variants = F.array_distinct(F.concat(F.array(bare), more, F.when(spaced != bare, F.array(spaced)).otherwise(F.array().cast("array<string>")), split))
    return F.concat(F.lit("(?i)(?<![a-zA-Z0-9_-])(?:"), F.array_join(F.transform(variants, escaped), "|"), F.lit(")(?![a-zA-Z0-9_-])"))


def occurrences(text: Column, name: Column) -> Column:
    """How often a name or a variant of it stands in a text as whole words."""
    return F.when(F.length(F.coalesce(name, F.lit(""))) == 0, 0).otherwise(F.coalesce(F.regexp_count(text, name_pattern(name)), F.lit(0)))


def anchored(text: Column, name: Column) -> Column:
    """Whether a name stands in a text and, if it is an ambiguous acronym, one of its anchors does, too."""
    near = F.lit(True)
    for acronym, words in ANCHORS.items():
        found = text.rlike("(?i)(?<![a-zA-Z0-9_-])(?:" + "|".join(words) + ")(?![a-zA-Z0-9_-])")
        near = F.when(F.upper(name) == acronym, found).otherwise(near)
    return F.coalesce((occurrences(text, name) > 0) & near, F.lit(False))


# --- addresses


def host(url: Column) -> Column:
    """The lower-case host of a web address, without user and port; null for other addresses."""
    found = F.lower(F.regexp_extract(F.trim(url), r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.when(found != "", found)


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


# Endings of hosts that are not on the open net.
LOCAL_SUFFIXES = (".localhost", ".local", ".internal", ".lan", ".localdomain", ".home.arpa")


def _reserved_ipv4(ip: Column) -> Column:
    """Whether a dotted address is private, reserved or malformed."""
    a, b, c, d = (F.get(F.split(ip, r"\."), k).try_cast("int") for k in range(4))
    # Reserved ranges.
    reserved = (
        (a == 0) | (a == 10) | (a == 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113)) | (a >= 224)
    )
    return reserved | (F.greatest(a, b, c, d) > 255)


def is_safe_url(url: Column) -> Column:
    """Whether an address is of the web and its host is neither local, numeric nor in a reserved range."""
    h = host(url)
    local = (h == "localhost") | h.rlike("(" + "|".join(s.replace(".", r"\.") for s in LOCAL_SUFFIXES) + ")$")
    numeric = h.rlike(r"^(0x[0-9a-f]+|\d+)$")
    v4 = h.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$") & _reserved_ipv4(h)
    inner = F.regexp_replace(h, r"^\[|\]$", "")
    mapped = F.regexp_extract(inner, r"^::ffff:(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    v6 = h.startswith("[") & (
        inner.isin("::1", "::", "0:0:0:0:0:0:0:1", "0:0:0:0:0:0:0:0") | inner.rlike("^(fe[89ab]|fc|fd|ff)") | ((mapped != "") & _reserved_ipv4(F.when(mapped != "", mapped).otherwise("8.8.8.8")))
    )
    return F.coalesce(h.isNotNull() & ~local & ~numeric & ~F.coalesce(v4, F.lit(False)) & ~v6, F.lit(False))
