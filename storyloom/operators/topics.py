"""Topics: mentions of aliases in texts with their places and roles, implications, assignment, redirects and governance."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from storyloom.sources.batches import slices

#: Aliases that one registry may hold: it is sent to every worker, so it must stay small.
MOST_ALIASES = 200_000
# Marks that count as hyphens, confidences, and patterns of what stands around a mention.
HYPHENS = "[.‐‑‒–—−]"
DIRECT, IMPLIED = 0.95, 0.9
PLACE_TYPES = {"location": "location", "operational_theatre": "location", "facility": "facility", "platform": "platform", "programme": "programme"}
PLACE = re.compile(r"\b(in|at|from|near)\s*$")
TARGET = re.compile(r"\b(attacks?|targeted|against|hits?)\s*$")
OPERATOR = re.compile(r"\b(operat(?:es?|ing)|deploy(?:s|ed|ment)?|aircraft|personnel)\b")
INCIDENTAL = re.compile(r"\b(histor(?:y|ical)|previously|former(?:ly)?|background)\b", re.I)
# Each of them holds one of these, which is found out sooner.
INCIDENTAL_STARTS = ("histor", "previously", "former", "background")
CLAUSE_END = re.compile(r"[.!?:]")
BEFORE, AFTER, ROLE_BEFORE, ROLE_AFTER = 70, 85, 36, 40
EVENTS = {"military": r"\b(military|army|air|navy|border|force|attack|personnel)\b", "diplomatic": r"\b(talk|meeting|negotiat|diplom)\b"}
CANDIDATE = r"\b(?:[A-Z][\p{L}\p{N}'-]+\s+){1,4}(?:Air Base|Airbase|Base|Facility|Airport|Exercise|Operation)\b"


def normal(text: str) -> str:
    """Compatibility forms without marks in small letters, hyphens and white space as single spaces."""
    plain = text.lower() if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M")).lower()
    return re.sub(r"[_\s-]+", " ", re.sub(HYPHENS, "-", plain)).strip()


def searchable(text: str) -> tuple[str, Sequence[int]]:
    """``text`` in compatibility forms and small letters, and for each character of it the place in ``text`` that it comes from."""
    if text.isascii():
        return text.lower().replace(".", "-"), range(len(text))
    chars, places = [], []
    for at, c in enumerate(text):
        plain = re.sub(HYPHENS, "-", unicodedata.normalize("NFKD", c).lower())
        chars.append(plain)
        places += [at] * len(plain)
    return "".join(chars), places


def alias_pattern(alias: str) -> regex.Pattern:
    """Matches an alias as whole words: marks may follow letters, hyphens and spaces are alike, short acronyms may have stops between letters."""
    letter = lambda c: regex.escape(c) + (r"\p{M}*" if c.isascii() and c.isalpha() else "")
    parts = normal(alias).split(" ")
    if len(parts) == 1 and re.fullmatch(r"[A-Za-z]{2,4}", alias):
        body = "[.-]?".join(letter(c) for c in alias.lower())
    else:
        body = r"[\s.‐‑‒–—−-]+".join("".join(map(letter, p)) for p in parts)
    return regex.compile(rf"(?<![\p{{L}}\p{{N}}]){body}(?![\p{{L}}\p{{N}}])", regex.I)


def role(kind: str, text: str, start: int) -> str:
    """What a mention at ``start`` does: its topic's own role, or what the words around it say."""
    if kind in PLACE_TYPES:
        return PLACE_TYPES[kind]
    before, after = text[max(0, start - ROLE_BEFORE) : start].lower(), text[start : start + ROLE_AFTER].lower()
    if PLACE.search(before):
        return "location"
    if TARGET.search(before):
        return "target"
    if OPERATOR.search(after):
        return "operator"
    return "context" if kind == "bilateral_relationship" else "actor"


def incidental(text: str, start: int) -> bool:
    """Whether the words before a mention, or those after it up to the end of the clause, say that it is background only."""
    end = CLAUSE_END.search(text, start, start + AFTER)
    around = text[max(0, start - BEFORE) : end.start() if end else start + AFTER]
    if around.isascii():
        plain = around.lower()
        if not any(w in plain for w in INCIDENTAL_STARTS):
            return False
    return bool(INCIDENTAL.search(around))


RUN = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")
ASCII_RUN = re.compile("[A-Za-z0-9]+")
PLAIN_RUN = regex.compile(r"[\p{L}\p{N}]+")
GAP = re.compile(rf"[\s{HYPHENS[1:-1]}-]+")
ACRONYM = re.compile("[A-Za-z]{2,4}")
compiled = lru_cache(4096)(alias_pattern)


def trie_arrays(rows: list[tuple]) -> dict:
    """Aliases (topic, alias, topic_type, terms) as a trie over their normal words, in flat arrays that are sent as they are.

    ``words`` are all words in one string, ``edge_key`` holds parent * len(words) + word in order and ``edge_to`` the child; ``end_of`` names the aliases of ``end_node``. Short acronyms are children of the root
    of their own; aliases without letters and digits are ``loose``. Building takes one pass over the aliases; no pattern is compiled.
    """
    words: dict[str, int] = {}
    edges: dict[tuple[int, int], int] = {}
    ends: list[tuple[int, int]] = []
    short: list[tuple[str, int]] = []
    loose, exact = [], np.zeros(len(rows), bool)
    for k, (_, alias, _, _) in enumerate(rows):
        plain = normal(alias)
        runs = PLAIN_RUN.findall(plain)
        exact[k] = " ".join(runs) == plain
        if ACRONYM.fullmatch(alias):
            short.append((alias.lower(), k))
        elif not runs:
            loose.append(k)
        else:
            node = 0
            for run in runs:
                node = edges.setdefault((node, words.setdefault(run, len(words))), len(edges) + 1)
            ends.append((node, k))
    keys = np.array([a * max(1, len(words)) + w for a, w in edges], np.int64)
    order = np.argsort(keys)
    ends.sort()
    return {
        "words": "\n".join(words), "edge_key": keys[order], "edge_to": np.array(list(edges.values()), np.int32)[order], "end_node": np.array([n for n, _ in ends], np.int32), "end_of": np.array([k for _, k in ends], np.int32),
        "short": short, "loose": loose, "exact": exact, "rows": [(t, a, kind, None if terms is None else [normal(x) for x in terms]) for t, a, kind, terms in rows],
    }


class AliasTrie:
    """The trie of ``trie_arrays``, walked from each word of a text: a text is tried against no alias that its words do not spell."""

    def __init__(self, arrays: dict):
        self.rows, self.exact, self.loose = arrays["rows"], arrays["exact"], arrays["loose"]
        words = arrays["words"].split("\n") if arrays["words"] else []
        self.words, self.many = {w: k for k, w in enumerate(words)}, max(1, len(words))
        self.edges = dict(zip(arrays["edge_key"].tolist(), arrays["edge_to"].tolist()))
        self.ends: dict[int, list[int]] = {}
        for node, k in zip(arrays["end_node"].tolist(), arrays["end_of"].tolist()):
            self.ends.setdefault(node, []).append(k)
        self.short: dict[str, list[int]] = {}
        for word, k in arrays["short"]:
            self.short.setdefault(word, []).append(k)
        # what a word must be for an alias to begin with it: the start of an acronym, or a word behind the root
        self.prefixes = {word[:n] for word in self.short for n in range(1, len(word) + 1)}
        self.first = self.prefixes | {w for w, k in self.words.items() if k in self.edges}

    def places(self, body: str) -> Iterator[tuple[int, int, int]]:
        """(alias, first, last) of what may be an alias in ``body``, by place; an alias never overlaps itself."""
        ascii_only = body.isascii()
        runs = [m.span() for m in (ASCII_RUN if ascii_only else RUN).finditer(body)]
        said = [body[a:b] if ascii_only else regex.sub(r"\p{M}+", "", body[a:b]) for a, b in runs]
        until: dict[int, int] = {}
        checked: set[int] = set()
        for i in [i for i, w in enumerate(said) if w in self.first]:
            first = runs[i][0]
            found, word, j = [], said[i], i
            while word in self.prefixes:
                found += [(k, runs[j][1]) for k in self.short.get(word, ())]
                j += 1
                if j == len(runs) or body[runs[j - 1][1] : runs[j][0]] not in (".", "-"):
                    break
                word += said[j]
            node, j, plain = 0, i, True
            while j < len(runs) and (number := self.words.get(said[j])) is not None:
                node = self.edges.get(node * self.many + number)
                if node is None:
                    break
                plain = plain and (j == i or bool(GAP.fullmatch(body, runs[j - 1][1], runs[j][0])))
                for k in self.ends.get(node, ()):
                    if not self.exact[k]:
                        checked.add(k)
                    elif plain:
                        found.append((k, runs[j][1]))
                j += 1
            for k, end in found:
                if first >= until.get(k, 0):
                    until[k] = end
                    yield k, first, end
        # aliases with marks of their own are looked for as they are, once their words are there
        for k in [*checked, *self.loose]:
            for m in compiled(self.rows[k][1]).finditer(body):
                yield k, m.start(), m.end()

    def mentions(self, text: str) -> list[tuple]:
        (body, places), plain, found = searchable(text), None, {}
        for k, first, last in self.places(body):
            topic, _, kind, terms = self.rows[k]
            if terms is not None:
                plain = normal(text) if plain is None else plain
                if not any(t in plain for t in terms):
                    continue
            start, end = places[first], places[last - 1] + 1
            if not incidental(text, start):
                found.setdefault((topic, start, end), (topic, role(kind, text, start), DIRECT, start, end, "exact"))
        return sorted(found.values(), key=lambda f: (f[0], f[3]))


MENTION = "topic string, role string, confidence double, start int, end int, kind string"


def mentions(texts: DataFrame, aliases: DataFrame, column: str = "text", every: bool = False) -> DataFrame:
    """The other columns of ``texts``, then topic, role, confidence, start, end and kind of each mention in ``column``.

    ``aliases``: topic, alias, topic_type, terms (an alias counts only in texts that hold one of its terms; null: always), rejected. Places count characters. Background
    mentions are left out, and so are null texts; with ``every``, a text without mentions has one row, of nulls. The registry goes to every worker and may have ``MOST_ALIASES`` rows at most; more is an error, never a cut.
    """
    rows = aliases.where("NOT coalesce(rejected, false)").select("topic", "alias", "topic_type", "terms").limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    shared = texts.sparkSession.sparkContext.broadcast(trie_arrays(sorted((tuple(r) for r in rows), key=str)))
    rest = [c for c in texts.columns if c != column]
    types = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string())
    nothing = [(None,) * len(types)] if every else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = AliasTrie(shared.value)
        for batch in (part for whole in batches for part in slices(whole, column)):
            at, out = [], []
            for k, text in enumerate(batch.column(column).to_pylist()):
                for found in (registry.mentions(text) if text else []) or nothing:
                    at.append(k)
                    out.append(found)
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([f[k] for f in out], t) for k, t in enumerate(types)]], [*rest, *[x.split()[0] for x in MENTION.split(", ")]])

    schema = T.StructType([*[texts.schema[c] for c in rest], *T.StructType.fromDDL(MENTION).fields])
    return texts.select(*rest, column).mapInArrow(run, schema)


def told(text: Column) -> Column:
    """The names of the kinds of events that a text tells of."""
    low = F.lower(text)
    # a pattern is tried only on texts that hold one of its words anywhere
    holds = lambda pattern: reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in pattern[3:-3].split("|")])
    return F.array_compact(F.array(*[F.when(F.when(holds(pattern), low.rlike(pattern)), F.lit(name)) for name, pattern in EVENTS.items()]))


def implied(texts: DataFrame, aliases: DataFrame, rules: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Mentions that follow from direct ones, as context: of topics that rules (source, implied, actors, events) imply and that the text does not mention itself.

    All ``actors`` must be mentioned, and one of ``events`` (military, diplomatic) must be told of if there are any. Implications do not imply further ones.
    The first mention of the source is the evidence. ``rules`` is joined by source. Each text is read once: what it tells of goes with its mentions (``mentions``), and all of a key meets in one shuffle.
    """
    found = mentions(texts.select(key, told(F.col(column)).alias("_told"), column), aliases, column, every=True)
    dealt = found.where(F.col("topic").isNotNull() | (F.size("_told") > 0)).select(key, "topic", "start", "end", "_told").repartition(key)
    kinds = {name: F.bool_or(F.array_contains("_told", name)) for name in EVENTS}
    first = dealt.groupBy(key, "topic").agg(F.min(F.struct("start", "end")).alias("_at"), *[kinds[name].alias(f"_{name}") for name in EVENTS])
    listed = F.collect_list(F.when(F.col("topic").isNotNull(), F.struct("topic", "_at"))).alias("_all")
    each = first.groupBy(key).agg(listed, *[F.bool_or(f"_{name}").alias(f"_{name}") for name in EVENTS]).where(F.col(key).isNotNull())
    each = each.withColumn("_topics", F.transform("_all", lambda x: x["topic"])).select("*", F.explode("_all").alias("_x"))
    said = F.lit(False)
    for name in EVENTS:
        said = said | (F.array_contains("events", name) & F.col(f"_{name}"))
    allowed = ~F.array_contains("_topics", F.col("implied")) & F.forall("actors", lambda a: F.array_contains("_topics", a)) & ((F.size("events") == 0) | said)
    one = each.join(rules, F.col("_x.topic") == F.col("source")).where(F.coalesce(allowed, F.lit(False)))
    one = one.groupBy(key, "implied").agg(F.min_by("_x._at", F.struct("source", "_x._at")).alias("_at"))
    return one.select(key, F.col("implied").alias("topic"), F.lit("context").alias("role"), F.lit(IMPLIED).alias("confidence"), "_at.start", "_at.end", F.lit("implication").alias("kind"))


def best_mentions(found: DataFrame, keys: list[str]) -> DataFrame:
    """For each of ``keys`` and topic the mention of largest confidence, the first of equal ones, and ``mentions``, the number of all."""
    best = F.struct(F.col("confidence"), (-F.col("start")).alias("s"), (-F.col("end")).alias("e"))
    return found.groupBy(*keys, "topic").agg(F.max_by(F.struct("role", "confidence", "start", "end", "kind"), best).alias("m"), F.count("*").alias("mentions")).select(*keys, "topic", "m.*", "mentions")


def candidates(texts: DataFrame, column: str) -> DataFrame:
    """The other columns and each capitalised name of a base, facility, exercise or operation in ``column``."""
    rest = [c for c in texts.columns if c != column]
    return texts.select(*rest, F.explode(F.regexp_extract_all(column, F.lit(CANDIDATE), F.lit(0))).alias("name"))


def resolved(wanted: DataFrame, topics: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds the topic that a term names: by id, else by hashtag, else by alias, the least id of equals; null if there is none.

    ``wanted`` has ``term``; topics have id and hashtag, aliases topic and alias. Three lookups by equality instead of one with OR.
    """
    looks = topics.select(F.lower("id").alias("term"), F.lit(0).alias("rank"), F.col("id").alias("topic"))
    looks = looks.union(topics.select(F.lower("hashtag"), F.lit(1), "id")).union(aliases.select(F.lower("alias"), F.lit(2), "topic"))
    best = looks.where("term IS NOT NULL").groupBy("term").agg(F.min_by("topic", F.struct("rank", "topic")).alias("topic")).withColumnRenamed("term", "_term")
    return wanted.join(best, F.lower("term") == F.col("_term"), "left").drop("_term")


def reusable(now: DataFrame, former: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``reuse``: whether a former run has the same ``keys`` (content, registry, classifier, policy)."""
    known = former.select(*keys).distinct().withColumn("_known", F.lit(True))
    return now.join(known, keys, "left").withColumn("reuse", F.coalesce("_known", F.lit(False))).drop("_known")


def reconciled_assignments(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The next version of assignments: locked rows stay as they are, wanted ones replace others, and unlocked ones that are not wanted go.

    Both have ``keys`` (unique), role and confidence; ``current`` also has locked.
    """
    a, b = current.alias("a"), wanted.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer").where("coalesce(a.locked, false) OR b.role IS NOT NULL")
    locked = F.coalesce("a.locked", F.lit(False))
    pick = lambda c: F.when(locked, F.col(f"a.{c}")).otherwise(F.coalesce(f"b.{c}", f"a.{c}")).alias(c)
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], pick("role"), pick("confidence"), locked.alias("locked"))


def claimed(versions: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions (id, topic, expected, at) with ``accepted``: of those that expect a topic's version, the first one in time wins; the next one must expect the version after it.

    So the accepted actions of a topic expect version, version + 1, and so on: one candidate for each expected version, as far as they follow each other.
    """
    first = actions.groupBy("topic", "expected").agg(F.min(F.struct("at", "id")).alias("best"))
    ordered = Window.partitionBy("topic").orderBy("expected")
    chain = first.join(versions, "topic").where(F.col("expected") >= F.col("version"))
    chain = chain.withColumn("step", F.row_number().over(ordered) - 1).where(F.col("expected") == F.col("version") + F.col("step"))
    late = F.max("best").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    chain = chain.withColumn("late", late).withColumn("bad", F.coalesce(F.col("best") < F.col("late"), F.lit(False)).cast("int"))
    good = chain.withColumn("bad", F.max("bad").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).where("bad = 0").select(F.col("best.id").alias("id"), F.lit(True).alias("accepted"))
    return actions.join(good, "id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def context_terms(rule: str | None) -> list[str] | None:
    """The required terms of a context rule in JSON; an unreadable rule has none, so its alias never counts."""
    try:
        found = json.loads(rule or "{}").get("requiredTerms")
        return [str(x) for x in found] if isinstance(found, list) else []
    except (ValueError, AttributeError):
        return []
