"""Dictionaries of patterns, of any size, against texts.

A pattern that stands between word boundaries begins where a word of the text begins. So the literal texts with which its matches can start give keys, the beginnings of
words, and an index from keys to patterns. Texts and patterns meet on keys by a join, and only pairs that meet are tried. Patterns whose matches may start with
anything have no key and are tried on every text; ``keyless`` tells which.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import cleaning
from storyloom.functions.text import has_word
from storyloom.sources.shared import Scratch

try:  # the module's name since Python 3.11
    from re import _constants as parts
    from re import _parser as parser
except ImportError:
    import sre_constants as parts
    import sre_parse as parser

#: Lengths of keys. The longest that a literal has is taken, so that a key is as rare as it can be.
LENGTHS = (1, 2, 4, 6, 8, 12)
#: A pattern with more beginnings than this has no key.
MOST_BEGINNINGS = 64
#: A dictionary of at most so many patterns is tried on every text at once, without keys.
FEW = 8
#: Patterns whose matches have at most so many words are tried on the words around their key, others on whole texts.
MOST_SPAN = 8
#: A table of at most so many rows may be sent to workers; of words beside the keys, so many at most are tested before texts meet patterns.
MOST_SENT, MOST_TESTS = 100_000, 256
#: What may stand before and after a match.
BOUNDED = r"(?i)(?<![A-Za-z0-9_])(?:%s)(?![A-Za-z0-9_])"


class _NoKey(ValueError):
    pass


#: Beginnings up to which separators are gone past; more of them end there, so that optional hyphens do not double them for ever.
MOST_PAST = 8


def _separates(items) -> bool:
    """Whether ``items`` is one character that ends a word, of white space or named marks."""
    if len(items) != 1:
        return False
    op, value = items[0]
    kinds = value if op is parts.IN else [(op, value)]
    mark = lambda c: chr(c).isascii() and not (chr(c).isalnum() or chr(c) == "_")
    return all((kind is parts.LITERAL and mark(c)) or (kind is parts.CATEGORY and c is parts.CATEGORY_SPACE) for kind, c in kinds)


def _walk(items, done: set[str], going: set[str], past: bool = False) -> set[str]:
    """The beginnings after ``items``: finished ones are put in ``done``, those that go on are returned. With ``past``, separators stand as one space and words go on behind them."""
    for op, value in items:
        if len(done) + len(going) > MOST_BEGINNINGS:
            raise _NoKey
        if not going:
            return going
        if past and len(going) <= MOST_PAST:
            if _separates([(op, value)]):
                going = {x + " " for x in going}
                continue
            if op in (parts.MAX_REPEAT, parts.MIN_REPEAT) and _separates(list(value[2])):
                going = {x + " " for x in going} | (going if value[0] == 0 else set())
                continue
        if op is parts.LITERAL:
            going = {x + chr(value) for x in going}
        elif op is parts.AT or op is parts.ASSERT or op is parts.ASSERT_NOT:
            continue
        elif op is parts.BRANCH:
            going = set().union(*[_walk(branch, done, set(going), past) for branch in value[1]])
        elif op is parts.SUBPATTERN:
            going = _walk(value[-1], done, going, past)
        elif op in (parts.MAX_REPEAT, parts.MIN_REPEAT) and value[0] == 0 and value[1] == 1:
            going = going | _walk(value[2], done, set(going), past)
        elif op in (parts.MAX_REPEAT, parts.MIN_REPEAT):
            once = _walk(value[2], done, set(going), past)
            # after the first time, anything of the repeated kind may follow
            done |= once
            going = set(going) if value[0] == 0 else set()
        elif op is parts.IN and all(kind is parts.LITERAL for kind, _ in value) and len(value) <= 4:
            going = {x + chr(c) for x in going for _, c in value}
        elif op is parts.IN and all((kind is parts.LITERAL and not (chr(c).isalnum() or chr(c) == "_")) or c is parts.CATEGORY_SPACE for kind, c in value):
            done |= {x + " " for x in going}  # a word ends here, whatever mark ends it
            return set()
        else:
            done |= going
            return set()
    return going


def beginnings(pattern: str) -> list[str] | None:
    """Beginnings of words, of LENGTHS characters, and whole words with a space after them, one of which every match of ``pattern`` starts with; None if there are none such."""
    try:
        done: set[str] = set()
        done |= _walk(parser.parse(pattern, re.I | re.A), done, {""})
    except (re.error, _NoKey, RecursionError):
        return None
    keys = set()
    for text in done:
        word = re.match(r"[a-z0-9_]*", text.lower())[0]
        if not word:
            return None
        keys.add(f"{word} " if text[len(word) :].isascii() and len(text) > len(word) else word[: max(n for n in LENGTHS if n <= len(word))])
    # a key makes those that go on from it needless
    return sorted(k for k in keys if not any(k != x and k.startswith(x) for x in keys)) or None


def alternatives(pattern: str) -> list[str]:
    """The patterns between the outermost bars of ``pattern``, one of which matches where it does; the pattern alone if groups, flags or quotes may reach over a bar."""
    if re.search(r"\\[1-9kQ]|\(\?(?!:)|\[\^?\]|\[[^\]]*\[", pattern):
        return [pattern]
    found, depth, start, inside, shut = [], 0, 0, False, []
    for m in re.finditer(r"\\.|[\[\]()|]", pattern, re.S):
        c = m[0]
        if inside or c == "[":
            inside = c != "]"
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            shut += [m.end()] * (depth == 0)
        elif c == "|" and depth == 0:
            found.append(pattern[start : m.start()])
            start = m.end()
        if depth < 0:
            return [pattern]
    if depth or inside:
        return [pattern]
    if pattern.startswith("(?:") and shut[:1] == [len(pattern)]:
        return alternatives(pattern[3:-1])
    return list(dict.fromkeys([*found, pattern[start:]]))


def _parsed(pattern: str):
    """``pattern`` taken apart; None if that cannot be done."""
    try:
        return parser.parse(pattern, re.I | re.A)
    except (re.error, RecursionError):
        return None


def _placed(tree) -> list[list[tuple[int, str]]] | None:
    """For each way in which a match may start, (place, key) of all its words that are known, counted from the match's first; None if one way has none."""
    try:
        done: set[str] = set()
        going = _walk(tree, done, {""}, past=True)
    except (_NoKey, RecursionError):
        return None
    found = set()
    for text in [*(x + " " for x in going), *done]:
        plain = re.match(r"[\x00-\x7F]*", text)[0]
        if not re.match(r"[A-Za-z0-9_]", plain):
            return None
        words = re.findall(r"([a-z0-9_]+)([^a-z0-9_]?)", plain.lower())
        found.add(tuple((k, f"{w} " if end else w[: max(n for n in LENGTHS if n <= len(w))]) for k, (w, end) in enumerate(words)))
    return [list(x) for x in sorted(found)] or None


def choices(pattern: str) -> list[list[str]] | None:
    """For each way in which a match of ``pattern`` may start, the keys of all its words that are known, each of which every such match has; None if one way has none.

    A word is known whole if a separator or the end of the pattern follows, where a match must end as a word does.
    """
    tree = _parsed(pattern)
    ways = None if tree is None else _placed(tree)
    return None if ways is None else [list(x) for x in sorted({tuple(sorted({k for _, k in way})) for way in ways})]


def alternatives_of(dictionary: DataFrame, *more: str) -> DataFrame:
    """(position, pattern, ``more``): a row for each of the ``alternatives`` of a pattern of ``dictionary`` (position, pattern, ``more``); a null pattern has one."""
    kinds = ", ".join(f"`{c}` {dictionary.schema[c].dataType.simpleString()}" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [[None] if p is None else alternatives(p) for p in batch.column("pattern").to_pylist()]
            at = pa.array([k for k, x in enumerate(each) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("position").take(at), pa.array([p for x in each for p in x], pa.string()), *[batch.column(c).take(at) for c in more]], ["position", "pattern", *more])

    return dictionary.select(F.col("position").cast("long").alias("position"), "pattern", *more).mapInArrow(run, "position long, pattern string" + ", " * bool(more) + kinds)


def rarest(patterns: DataFrame) -> DataFrame:
    """(pattern, span, place, key, other, often) of ``patterns`` (pattern), which are unlike: for each way in which a match may start the place and key of the word that the fewest patterns have, and the place and key of that which the most have, if it
    has two, else null. A pattern without a key has one row without; ``span`` is ``most_words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pattern in batch.column("pattern").to_pylist():
                tree = None if pattern is None else _parsed(pattern)
                span, ways = (None, None) if tree is None else (_most_words(tree), _placed(tree))
                rows.extend([(pattern, span, 0, None, None)] if ways is None else [(pattern, span, n, place, k) for n, way in enumerate(ways) for place, k in way])
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["pattern", "span", "way", "place", "key"])

    # a number of parts that is asked for stays: patterns are short, and taking them apart is slow
    every = patterns.repartition(2 * patterns.sparkSession.sparkContext.defaultParallelism, "pattern").mapInArrow(run, "pattern string, span int, way int, place int, key string")
    every = Scratch(patterns.sparkSession).written(every, "pattern-words")
    often = every.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    each = every.join(often.hint("merge"), "key", "left").groupBy("pattern", "span", "way").agg(F.min(F.struct("n", "key", "place")).alias("few"), F.max(F.struct("n", "key", "place")).alias("many"))
    two = F.col("few.place") != F.col("many.place")
    return each.select("pattern", "span", F.col("few.place").alias("place"), F.col("few.key").alias("key"), F.when(two, F.col("many.place")).alias("other"), F.when(two, F.col("many.key")).alias("often")).distinct()


def keyed(dictionary: DataFrame) -> DataFrame:
    """(position, key) of ``dictionary`` (position, pattern): a row for each key of a pattern, one with a null key if it or one of its alternatives has none. Of the keys that a start of a match has, that counts which the fewest alternatives have."""
    ways = alternatives_of(dictionary)
    found = rarest(ways.select("pattern").distinct())
    return ways.join(found, ways["pattern"].eqNullSafe(found["pattern"])).select("position", "key").distinct()


def keyless(dictionary: DataFrame) -> DataFrame:
    """The positions of the patterns that every text is tried against."""
    return keyed(dictionary).where("key IS NULL").select("position").distinct()


def _key_of(word: Column, length: int) -> Column:
    """The key of ``length`` of a word, 0 for the word with a space after it; null if it is too short."""
    return F.concat(word, F.lit(" ")) if length == 0 else F.when(F.length(word) >= length, F.substring(word, 1, length))


def word_keys(text: Column) -> Column:
    """The beginnings of LENGTHS characters of the words of a text, and the words with a space after them, each once."""
    words = F.array_distinct(F.filter(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), "[^a-z0-9_]+"), lambda w: w != ""))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(F.concat(w, F.lit(" ")), *[F.when(F.length(w) >= n, F.substring(w, 1, n)) for n in LENGTHS]))))


def most_words(pattern: str) -> int | None:
    """How many words of a text a match of ``pattern`` spans at most; None if that has no bound, or if the pattern looks beyond its match."""
    tree = _parsed(pattern)
    return None if tree is None else _most_words(tree)


def _most_words(tree) -> int | None:
    def breaks(items) -> int:
        """Times that a match may leave a word."""
        n = 0
        for op, value in items:
            if op is parts.LITERAL:
                n += not (chr(value).isascii() and (chr(value).isalnum() or value == ord("_")))
            elif op is parts.IN:
                n += not all((kind is parts.LITERAL and chr(c).isascii() and (chr(c).isalnum() or chr(c) == "_")) or (kind is parts.RANGE and c[1] < 128 and all(chr(x).isalnum() or chr(x) == "_" for x in range(c[0], c[1] + 1))) or (kind is parts.CATEGORY and c in (parts.CATEGORY_DIGIT, parts.CATEGORY_WORD)) for kind, c in value)
            elif op is parts.ANY or op is parts.NOT_LITERAL:
                n += 1
            elif op is parts.BRANCH:
                n += max(breaks(branch) for branch in value[1])
            elif op is parts.SUBPATTERN and not (value[1] or value[2]):
                n += breaks(value[-1])
            elif op in (parts.MAX_REPEAT, parts.MIN_REPEAT):
                once = breaks(value[2])
                # separators one after the other are one break
                n += 0 if not once else 1 if _separates(list(value[2])) else once * value[1] if value[1] <= MOST_SPAN else MOST_SPAN
            else:
                raise _NoKey
        return n

    try:
        n = 1 + breaks(tree)
    except (_NoKey, RecursionError):
        return None
    return n if n <= MOST_SPAN else None


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _windows(text: Column, before: int, after: int, tests: list[tuple[int, int, list[str]]] | None) -> Column:
    """(word, around) of words of a text: ``around`` has the word, in small letters in ``word``, with ``before`` words before it and ``after`` words after it, separators as they are, up to the end of a further word, each such once.

    With ``tests`` only words count that have for one (offset, length, keys) of them one of ``keys`` at ``offset`` from them.
    """
    pieces = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+[^A-Za-z0-9_]*)"), 1)
    head = lambda x: F.regexp_extract(x, "^[A-Za-z0-9_]+", 0)
    # arrays of one entry are bound for the inner functions, which would work them out anew for each word
    bound = F.transform(F.array(pieces), lambda p: F.struct(p.alias("p"), F.transform(p, lambda x: _lower(head(x))).alias("w")))

    def of(x):
        counts = lambda i: F.exists(F.array(*[_key_of(F.get(x["w"], i + at), n).isin(keys) for at, n, keys in tests]), lambda t: t)
        places = F.transform(x["w"], lambda _, i: i)
        around = lambda i: F.concat(F.array_join(F.slice(x["p"], F.greatest(i + 1 - before, F.lit(1)), F.least(i, F.lit(before)) + 1 + after), ""), head(F.coalesce(F.get(x["p"], i + after + 1), F.lit(""))))
        return F.array_distinct(F.transform(places if tests is None else F.filter(places, counts), lambda i: F.struct(F.get(x["w"], i).alias("word"), around(i).alias("around"))))

    return F.transform(bound, of)[0]


def few_of(dictionary: DataFrame, *more: str) -> list | None:
    """The rows (position, pattern, ...) of a dictionary of ``FEW`` patterns at most; None of a larger one."""
    few = dictionary.where("pattern IS NOT NULL").select(F.col("position").cast("long").alias("position"), "pattern", *more).limit(FEW + 1).collect()
    return few if len(few) <= FEW else None


def found_patterns(texts: DataFrame, key: str, column: str, dictionary: DataFrame, *more: str) -> DataFrame:
    """(key, position, ``more``): the patterns of ``dictionary`` (position, pattern, ``more``) that occur in ``column`` between word boundaries, in any case.

    Patterns are those of Java and are valid; positions and keys are unlike. Null texts and null patterns match nothing. The dictionary may have any size: it is joined, not sent to workers; one of ``FEW`` patterns at most becomes
    tests on each row, so that texts are neither taken apart nor shuffled. Of larger ones each alternative is looked for once, however many patterns have it: those within a word in the words that there are, those of a few words in the words around
    their key, others in whole texts.
    """
    few = few_of(dictionary, *more)
    if few is not None:
        kinds = ", ".join(f"`{c}`: {dictionary.schema[c].dataType.simpleString()}" for c in more)
        kind = f"struct<position: bigint{', ' * bool(more)}{kinds}>"
        tests = [F.when(has_word(F.col(column), r["pattern"]), F.struct(*[F.lit(r[c]).alias(c) for c in ("position", *more)]).cast(kind)) for r in few] or [F.lit(None).cast(kind)]
        return texts.where(F.col(column).isNotNull()).select(key, F.explode(F.array_compact(F.array(*tests))).alias("x")).select(key, "x.*")
    scratch = Scratch(texts.sparkSession)
    ways = scratch.written(alternatives_of(dictionary, *more).where("pattern IS NOT NULL"), "pattern-ways")
    known = scratch.written(rarest(ways.select("pattern").distinct()).withColumn("bounded", F.format_string(BOUNDED, "pattern")), "pattern-keys")
    bodies = texts.select(F.col(key).alias("_id"), F.col(column).alias("_text")).where("_text IS NOT NULL")
    # files are smaller than their rows in memory, so tables that are not small must not be taken for such
    whole = lambda df: df if df.count() <= MOST_SENT else df.hint("merge")
    ways = whole(ways)
    length = lambda k: F.when(F.col(k).endswith(" "), 0).otherwise(F.length(k))
    kind = F.when(F.col("key").isNull(), "none").when(F.col("span").isNull(), "wide").when(F.col("span") == 1, "word").when(F.col("often").isNotNull(), "two").otherwise("one")
    known = known.withColumn("kind", kind).withColumn("length", length("key"))
    facts = known.groupBy("kind", "length").agg(F.max("place").alias("before"), F.max(F.col("span") - 1 - F.col("place")).alias("after")).collect()
    lengths = lambda k: sorted({r["length"] for r in facts if r["kind"] == k})
    keys = lambda word, ns: F.explode(F.array_compact(F.array(*[_key_of(word, n) for n in ns])))
    kinds = {r["kind"] for r in facts}
    found = [texts.select(F.col(key).alias("_id")).where("false").join(ways.where("false"))]
    if "word" in kinds:
        words = bodies.select("_id", F.explode(F.array_distinct(F.filter(F.split(_lower(F.col("_text")), "[^a-z0-9_]+"), lambda w: w != ""))).alias("_word"))
        near = whole(known.where("kind = 'word'").select("key", "pattern", "bounded"))
        of_word = words.select("_word").distinct().select("_word", keys(F.col("_word"), lengths("word")).alias("key")).join(near, "key").where(F.expr("_word rlike bounded")).select("_word", "pattern").distinct()
        of_word = scratch.written(of_word.join(ways, "pattern").drop("pattern"), "pattern-hits")
        found.append(words.join(whole(of_word), "_word").drop("_word"))
    hits = []
    for some in sorted(kinds & {"one", "two"}):
        near = known.where(F.col("kind") == some)
        tests = None
        if some == "two":
            often = near.select((F.col("other") - F.col("place")).alias("at"), length("often").alias("n"), "often").distinct().limit(MOST_TESTS + 1).collect()
            if len(often) <= MOST_TESTS:
                tests = [(at, n, sorted(r["often"] for r in often if (r["at"], r["n"]) == (at, n))) for at, n in sorted({(r["at"], r["n"]) for r in often})]
        before, after = (max(r[c] for r in facts if r["kind"] == some) for c in ("before", "after"))
        around = bodies.select("_id", F.explode(_windows(F.col("_text"), before, after, tests)).alias("x")).select("_id", "x.around", keys(F.col("x.word"), lengths(some)).alias("key"))
        hits.append(around.join(whole(near.select("key", "bounded", "pattern")), "key").where(F.expr("around rlike bounded")).select("_id", "pattern"))
    matches = F.expr("_text rlike bounded")
    if "wide" in kinds:
        words = bodies.select("_id", F.explode(word_keys(F.col("_text"))).alias("key")).where("key IS NOT NULL")
        pairs = words.join(whole(known.where("kind = 'wide'").select("key", "bounded", "pattern")), "key").select("_id", "bounded", "pattern").distinct()
        hits.append(pairs.join(bodies, "_id").where(matches).select("_id", "pattern"))
    if "none" in kinds:
        # every text against the few patterns without a key: their own rows, not the dictionary's
        rest = known.where("kind = 'none'").select("bounded", "pattern")
        hits.append(bodies.withColumn("_all", F.lit(0)).join(rest.withColumn("_all", F.lit(0)), "_all").where(matches).select("_id", "pattern"))
    found.extend(h.distinct().join(ways, "pattern").drop("pattern") for h in hits)
    # what is found of a text stands together, so that it can be grouped by text as it is
    return reduce(DataFrame.unionByName, [f.select("_id", "position", *more) for f in found]).repartition("_id").distinct().withColumnRenamed("_id", key)


def entities_of(texts: DataFrame, key: str, column: str, dictionary: DataFrame) -> DataFrame:
    """(key, entities, categories) of the texts that name something: names in the order of ``dictionary`` (position, name, pattern, categories), each once, and their categories.

    What a text names is bounded by the text.
    """
    found = found_patterns(texts, key, column, dictionary).join(dictionary.select(F.col("position").cast("long").alias("position"), "name", "categories"), "position")
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "name", "categories"))).alias("x"))
    return rows.select(key, F.array_distinct(F.transform("x", lambda e: e["name"])).alias("entities"), F.array_distinct(F.flatten(F.transform("x", lambda e: e["categories"]))).alias("categories"))


def fallback_categories(text: Column) -> Column:
    """The category of a text that names nothing: the first kind of force that it speaks of, procurement in a defence context, else strategic."""
    body = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(body, w))
    # Words of each category.
    defence = has("defence", "defense", "military", "mod", "armed forces", "drdo", "weapon", "missile", "ammunition")
    buys = has("procurement", "deal", "crore", "order", "contract", "acquisition", "tender")
    kind = F.when(has("army", "troop", "soldier"), "army").when(has("navy", "ship", "submarine", "maritime"), "navy").when(has("air force", "iaf", "aircraft", "jet"), "airforce")
    return F.array(kind.when(defence & buys, "procurement").otherwise("strategic"))


def classified(texts: DataFrame, key: str, column: str, dictionary: DataFrame, overlay: str = "ssb") -> DataFrame:
    """(key, entities, categories) of all texts: categories of what they name, the fallback for the others, and one that all have on top."""
    found = texts.select(key, column).join(entities_of(texts, key, column, dictionary), key, "left")
    none = F.coalesce(F.size("categories"), F.lit(0)) <= 0
    kinds = F.when(none, fallback_categories(F.col(column))).otherwise(F.col("categories"))
    return found.select(key, F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.array_union(kinds, F.array(F.lit(overlay))).alias("categories"))


# --- names as patterns


def programme_terms(names: Column) -> Column:
    """The spellings of names that count: as they are, what stands in brackets, without brackets, and the parts between slashes; three characters or more."""
    bare = lambda c: F.trim(F.regexp_replace(c, r"\([^)]+\)", ""))
    inner = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\(([^)]+)\)"), 1), lambda s: F.trim(s))
    each = lambda c: F.concat(F.array(c, bare(c)), inner(c), F.when(F.contains(c, F.lit("/")), F.transform(F.split(c, "/"), bare)).otherwise(F.array().cast("array<string>")))
    full = F.filter(names, lambda c: c.isNotNull() & (c != ""))
    return F.array_distinct(F.filter(F.flatten(F.transform(full, each)), lambda t: F.length(t) > 2))


def term_pattern(term: Column) -> Column:
    """A term as a pattern: any white space for white space; a hyphen, white space or nothing for a hyphen."""
    return F.regexp_replace(F.regexp_replace(cleaning.escaped(term), r"\s+", r"\\s+"), "-", r"[-\\s]?")


def programme_pattern(names: Column) -> Column:
    """A pattern for a programme by its names and aliases; null if no spelling counts."""
    terms = programme_terms(names)
    return F.when(F.size(terms) > 0, F.array_join(F.transform(terms, term_pattern), "|"))


# Numerals at the end of a name that are written in two ways.
NUMERALS = (("ii", "2"), ("iii", "3"), ("iv", "4"), ("v", "5"))


def entity_pattern(name: Column) -> Column:
    """A pattern for an entity's name of 3 to 60 characters that begins with a letter: a Roman numeral after a hyphen may be a digit, and the hyphen may be missing. Null for other names."""
    clean = F.trim(F.coalesce(name, F.lit("")))
    found = cleaning.escaped(clean)
    for roman, digit in NUMERALS:
        found = F.regexp_replace(found, rf"(?i)-{roman}(?![A-Za-z0-9_])", f"-?(?:{roman}|{digit})(?![A-Za-z0-9_])")
    return F.when(F.length(clean).between(3, 60) & clean.rlike("^[A-Za-z]"), found)
