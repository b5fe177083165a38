"""Entities in texts: dictionary joins, salience, metrics, graph categories and relations, patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import cleaning, scoring
from storyloom.functions.text import has_word
from storyloom.sources.shared import Scratch

#: A dictionary of at most so many patterns becomes one column expression; larger ones are joined by their words.
FEW = 64


def tagged(texts: DataFrame, column: str, dictionary: list[tuple[str, str]]) -> DataFrame:
    """Adds ``entities``: the names whose pattern (a regular expression) occurs in ``column`` between word boundaries, in the order of a small dictionary."""
    if len(dictionary) > FEW:
        raise ValueError(f"a dictionary of more than {FEW} patterns is joined by ``mentions_of_names``")
    found = [F.when(has_word(F.col(column), pattern), name) for name, pattern in dictionary]
    return texts.withColumn("entities", F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast("array<string>"))


def mentions_of_names(texts: DataFrame, key: str, column: str, names: DataFrame, name: str = "name") -> DataFrame:
    """(key, name) of names that occur in texts as whole words, with hyphens, slashes and spaces alike, in any case.

    A dictionary of any size: names and texts meet on the word of the name that the fewest names have, then the whole name is looked for. Each text names a pair once.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    plain = names.select(name, words(F.col(name)).alias("_w")).dropDuplicates([name]).select(name, F.array_join("_w", " ").alias("_name"), F.explode(F.array_distinct("_w")).alias("_word"))
    often = plain.groupBy("_word").agg(F.count("*").alias("_n"))
    rarest = plain.join(often, "_word").groupBy(name, "_name").agg(F.min(F.struct("_n", "_word")).alias("_r")).select(name, "_name", F.col("_r._word").alias("_word"))
    # written, so that the size of the names is known and a small dictionary is sent to the texts
    parts = Scratch(names.sparkSession).written(rarest, "names")
    bodies = texts.select(key, words(F.col(column)).alias("_w"))
    bodies = bodies.select(key, F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias("_body"), F.explode(F.array_distinct("_w")).alias("_word"))
    found = bodies.join(parts, "_word").where(F.contains("_body", F.concat(F.lit(" "), "_name", F.lit(" "))))
    return found.select(key, name).distinct()


def inverted(mentions: DataFrame, key: str, name: str = "name") -> DataFrame:
    """(slug, items): for each name's slug the ids of the texts that name it, in order."""
    return mentions.groupBy(cleaning.slug(F.col(name)).alias("slug")).agg(F.array_sort(F.collect_set(key)).alias("items"))


def candidate_entities(mentions: DataFrame, default: str = "tech", least: int = 3, sources: int = 2) -> DataFrame:
    """Of each slug: mentions, sources, first and last time, the first category that is not the default, and whether it is promoted.

    ``mentions``: slug, name, category, domain, seen, promoted (once promoted, a slug stays so). Names must have 3 to 60 characters and begin with a letter.
    """
    valid = mentions.where(F.length("name").between(3, 60) & F.col("name").rlike("^[A-Za-z]"))
    special = F.when(F.col("category") != default, F.struct("seen", "category"))
    found = valid.groupBy("slug").agg(
        F.count("*").alias("mentions"), F.countDistinct("domain").alias("sources"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"),
        F.coalesce(F.min(special)["category"], F.lit(default)).alias("category"), F.bool_or("promoted").alias("was"),
    )
    return found.withColumn("promoted", F.coalesce("was", F.lit(False)) | ((F.col("mentions") >= least) & (F.col("sources") >= sources))).drop("was")


def salience(headline: Column, body: Column, name: Column) -> Column:
    """How much a text is about a name: 0.5 for the headline, 0.3 for the first sentence, up to 0.2 for frequency and being the subject; 0 without its anchors."""
    whole = F.trim(F.concat_ws(" ", headline, body))
    lead = F.coalesce(F.get(F.filter(F.transform(F.split(body, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != ""), 0), F.lit(""))
    n = cleaning.occurrences(whole, name)
    often = F.when(n >= 3, 0.10).when(n == 2, 0.07).when(n >= 1, 0.04).otherwise(0.0)
    opens = lambda t: cleaning.occurrences(F.array_join(F.slice(F.split(F.trim(t), r"\s+"), 1, 3), " "), name) > 0
    rest = F.least(F.lit(0.20), scoring.rounded(often + F.when(opens(headline) | opens(lead), 0.10).otherwise(0.0), 2))
    score = F.when(cleaning.occurrences(headline, name) > 0, 0.5).otherwise(0.0) + F.when(cleaning.occurrences(lead, name) > 0, 0.3).otherwise(0.0) + rest
    return F.when(cleaning.anchored(whole, name), scoring.rounded(F.least(F.lit(1.0), score), 2)).otherwise(0.0)


# The forms in which facts are told.
AMOUNT = r"([\d,]+(?:\.\d+)?)"
BUDGET = rf"(?i)(?:\b(?:rs\.?|inr)\s*{AMOUNT}\s*cr(?:ore)?s?\b)|(?:\b₹\s*{AMOUNT}\s*(?:cr(?:ore)?s?)?\b)|(?:\b{AMOUNT}\s*cr(?:ore)?s?\b)"
THINGS = r"(?i)\b(\d+)\s+(?:[a-zA-Z0-9_-]+\s+){0,4}(units|aircraft|fighter jets?|jets?|helicopters?|submarines?|tanks?|regiments?|batteries|systems?|missiles?|launchers?|engines?|radars?|guns?|vessels?|corvettes?|frigates?)\b"
YEAR, LATER = "202[5-9]|203[0-9]|2040", "202[6-9]|203[0-9]|2040"
BY_YEAR = rf"(?i)(?:by|in|target(?:ed)? for|delivery by|completion by)\s*({YEAR})(?:[-–]({LATER}))?"
YEARS = rf"\b({YEAR})[-–]({LATER})\b"
SHARES = (r"(?i)(\d{1,3})%\s*(?:indigenous|ic\b|local content)", r"(?i)(?:indigenous content of|ic of)\s*(\d{1,3})%")
MILESTONE_BUDGET = rf"(?i)(?:₹|rs\.?|inr)?\s*{AMOUNT}\s*(?:cr|crore|crores)\b"
MILESTONE_SHARE = r"(?i)(\d{1,3})%\s*(?:indigenous|iddm|indigenisation|local content)\b"
MILESTONE_TIME = r"(?i)\b(?:by|in|from|target(?:ed)?(?:\s+(?:for|in|by))?|delivery:?|scheduled\s+(?:for|to\s+commence\s+by|by)?)\s*([A-Za-z]+\s+\d{4}|\d{4}-\d{2,4}|FY\s*\d{2,4}|\d{4})\b"
TELLING = r"(?i)deal|approv|sanction|sign|induct|trial|clears|procure"


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def _some(text: Column) -> Column:
    return cleaning.bound(text, lambda t: F.when(t != "", t))


def _percent(text: Column, *patterns: str) -> Column:
    """The first share by ``patterns``, up to 100; they are tried on texts with a percent sign alone."""
    found = F.when(text.contains("%"), F.coalesce(*[_some(F.regexp_extract(text, p, 1)) for p in patterns])).try_cast("int")
    return cleaning.bound(found, lambda share: F.when(share <= 100, share))


def metrics(text: Column) -> dict[str, Column]:
    """Facts of a text: budget in crore, quantity, year or years of delivery and share of local content; null for what it does not say.

    Of amounts the first counts, in rupees with or without crore, or in crore alone; a range of years stands as it is told. A pattern is looked for once in a text; its groups come out of what it matched.
    """

    def budget(t: Column) -> Column:
        told = F.lower(t).contains("cr") | t.contains("₹")
        amount = _number(F.when(told, F.coalesce(*[_some(F.regexp_extract(t, BUDGET, k)) for k in (1, 2, 3)])))
        return cleaning.bound(amount, lambda x: F.when(x > 0, x))

    def first(t: Column, pattern: str, use) -> Column:
        return cleaning.bound(F.regexp_extract(t, pattern, 0), lambda m: F.when(m != "", use(m)))

    def quantity(t: Column) -> Column:
        return first(t, THINGS, lambda m: F.concat_ws(" ", F.regexp_extract(m, THINGS, 1), F.lower(F.regexp_extract(m, THINGS, 2))))

    def timeline(t: Column) -> Column:
        span = lambda pattern: first(t, pattern, lambda m: F.concat_ws("-", F.regexp_extract(m, pattern, 1), _some(F.regexp_extract(m, pattern, 2))))
        return F.when(t.contains("20"), F.coalesce(span(BY_YEAR), span(YEARS)))

    found = {"budget": budget, "quantity": quantity, "timeline": timeline, "share": lambda t: _percent(t, *SHARES)}
    return {name: cleaning.bound(text, fact) for name, fact in found.items()}


def milestone_facts(text: Column) -> dict[str, Column]:
    """Facts of a milestone: budget in crore, when (a month and year, a year with another, a financial year, or a year) and the share of local content."""
    found = {
        "budget": lambda t: _number(F.when(F.lower(t).contains("cr"), _some(F.regexp_extract(t, MILESTONE_BUDGET, 1)))), "timeline": lambda t: _some(F.trim(F.regexp_extract(t, MILESTONE_TIME, 1))), "share": lambda t: _percent(t, MILESTONE_SHARE),
    }
    return {name: cleaning.bound(text, fact) for name, fact in found.items()}


def telling_sentence(title: Column, snippet: Column) -> Column:
    """The first sentence that tells of a step, else the first one, of more than 20 characters; the whole text if there is none."""
    combined = F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(snippet, F.lit(""))))
    sentences = F.filter(F.transform(F.split(combined, r"(?<=[.?!])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 20)
    return F.coalesce(F.get(F.filter(sentences, lambda s: s.rlike(TELLING)), F.lit(0)), F.get(sentences, F.lit(0)), combined)


def verbatim_quote(title: Column, snippet: Column, source: Column) -> Column:
    """The telling sentence in quotation marks with its source, on one line, cut at 240 characters as snippets are."""
    return F.concat(F.lit('"'), cleaning.cut(F.regexp_replace(telling_sentence(title, snippet), r"[\r\n\t]+", " "), 240), F.lit('" — '), source)


def mining_confidence(official: Column, budget: Column, quantity: Column, timeline: Column, named: Column, related: Column) -> Column:
    """Confidence of mined facts from 0.15 to 1."""
    add = lambda test, n: F.when(test, n).otherwise(0.0)
    total = 0.15 + add(official, 0.25) + add(budget.isNotNull(), 0.25) + add(quantity.isNotNull() | timeline.isNotNull(), 0.20) + add(named, 0.15) + add(related, 0.10)
    return F.least(F.lit(1.0), scoring.rounded(total, 2))


def milestone_status(text: Column) -> Column:
    """The stage that a text tells of; the first of the cascade counts."""

    def stage(low: Column) -> Column:
        has = lambda *words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
        return (
            F.when(has("induct", "commission"), "induction").when(has("trial", "flight test"), "trials").when(has("ccs approval", "dac approval", "sanction"), "sanctioned")
            .when(has("deliver", "rollout"), "production").when(has("delay"), "delayed").otherwise("general")
        )

    return cleaning.bound(F.lower(text), stage)


# What a node is, by words of its name, in this order.
CATEGORIES = (
    ("platform", "tank|gun|missile|radar|fighter|aircraft|uav|drone|frigate|destroyer|submarine|carrier|corvette"),
    ("facility", "island|range|base|command|yard|port|fort|itr"),
    ("location", "valley|sector|border|glacier|lac|loc|ladakh|delhi|kashmir|arunachal"),
    ("threat", "threat|incursion|infiltration|clash|attack|skirmish|anomal"),
    ("organization", "drdo|hal|bel|bdl|mdl|l&t|tata|adani|mod|army|navy|air force|iaf"),
    ("program", "project|program|mission|amca"),
)
# Relations by what a text tells of, the kinds of both ends, and whether the ends change places.
DEPLOYS = r"deploy(?:s|ed|ing|ment)?|station(?:s|ed|ing)?|position(?:s|ed|ing)?|moved\s+to"
TESTS = r"flight\s+tests?|test-?fires?|test-?firing|trials?|tested|sea\s+trials?|validat(?:es|ed)"
COUNTERS = r"intercept(?:s|ed|ing)?|shoot(?:s)?\s+down|counter(?:s|ing)?|neutrali[sz](?:es|ed|ing)?|track(?:s|ed|ing)?"
BUYS = r"procure(?:s|d|ment)?|order(?:s|ed)?|deal|contract|aon|dac|acquire(?:s|d)?"


def node_category(label: Column, known: tuple[tuple[str, str], ...] = ()) -> Column:
    """What a node is: by ``known`` (pattern, category) first, then by ``CATEGORIES``, else a platform."""
    found = F.lit("platform")
    for category, pattern in reversed(CATEGORIES):
        found = F.when(F.lower(label).rlike(pattern), category).otherwise(found)
    for pattern, category in reversed(known):
        found = F.when(has_word(label, pattern), category).otherwise(found)
    return found


def told_of(text: Column) -> Column:
    """What a text tells of, for ``relation``: deploying, testing, countering and buying. It is found out once for each text, not for each pair of names."""
    return F.struct(*[has_word(text, pattern).alias(name) for name, pattern in (("deploys", DEPLOYS), ("tests", TESTS), ("counters", COUNTERS), ("buys", BUYS))])


def relation(told: Column, a: Column, b: Column) -> Column:
    """The predicate between nodes of the categories ``a`` and ``b`` in a text of ``told`` (``told_of``), with ``<`` in front if it leads from b to a; null if there is none."""
    place = ("location", "facility")
    rules = [
        (told["deploys"] & (a == "platform") & b.isin(*place), "DEPLOYED_TO"), (told["deploys"] & (b == "platform") & a.isin(*place), "<DEPLOYED_TO"),
        (told["tests"] & (a == "platform") & b.isin(*place), "TESTED_AT"), (told["tests"] & (b == "platform") & a.isin(*place), "<TESTED_AT"),
        (told["counters"] & (a == "platform") & (b == "threat"), "TARGETS"), (told["counters"] & (b == "platform") & (a == "threat"), "<TARGETS"),
        (told["buys"] & (a == "organization") & (b == "platform"), "PROCURES"), (told["buys"] & (b == "organization") & (a == "platform"), "<PROCURES"),
        ((b == "platform") & (a == "program"), "<CONNECTED_TO"), ((a != b) | (a == "platform"), "CONNECTED_TO"),
    ]
    found = F.lit(None).cast("string")
    for test, name in reversed(rules):
        found = F.when(test, name).otherwise(found)
    return found


def patterns(sightings: DataFrame, hours: int = 72, least: int = 3) -> DataFrame:
    """For each place and motif the first window of ``hours`` that holds ``least`` or more clusters: start, clusters, domains, confidence and a title.

    ``sightings``: cluster, place, motif, domain, ts. All motifs of a place together are one more motif, ``CONVERGENCE``. The windows come from running sums (``threads.dense_windows``); only
    the first window of each place and motif is read again. A span of ``hours`` that has ``least`` clusters has a window, so sums run over what is not behind the first such span.
    """
    from storyloom.operators.threads import confidence, dense_windows

    # written, since it is read three times and its joins need not be made anew
    scratch, wide = Scratch(sightings.sparkSession), hours * 3600
    sightings = scratch.written(sightings.select("cluster", "place", "motif", "domain", "ts"), "sightings")
    every = sightings.withColumn("motif", F.explode(F.array("motif", F.lit("CONVERGENCE")))).withColumn("anchor", F.concat_ws("::", "place", "motif"))
    every = every.withColumn("span", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / wide))
    # different bits come from different clusters: a span has at least as many as it has bits
    bits = F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(cluster), 64) as int))"))
    spans = every.where("cluster IS NOT NULL AND span IS NOT NULL").groupBy("anchor", "span").agg(bits.alias("bits")).where(F.bit_count("bits") >= least)
    dense = scratch.written(spans.groupBy("anchor").agg(F.min("span").alias("dense")), "dense-spans")
    early = every.join(dense, "anchor", "left").where("dense IS NULL OR span <= dense + 1")
    first = scratch.written(dense_windows(early, "anchor", "ts", "cluster", hours, least), "first-windows")
    inside = every.join(first.select("anchor", "start_at"), "anchor")
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("start_at").cast("timestamp"))
    found = inside.where(gap.between(0, hours * 3600)).groupBy("place", "motif", "start_at").agg(F.countDistinct("cluster").alias("clusters"), F.countDistinct("domain").alias("domains"))
    name = F.when(F.col("motif") == "CONVERGENCE", F.concat("place", F.lit(" Tactical & Strategic Convergence"))).otherwise(F.concat_ws(" ", "place", "motif", F.lit("Convergence")))
    return found.select("place", "motif", "start_at", "clusters", "domains", scoring.rounded(confidence(F.col("clusters"), F.col("domains")), 2).alias("confidence"), name.alias("title"))


def matched_threads(clusters: DataFrame, threads: DataFrame, least: float = 0.35) -> DataFrame:
    """(cluster, thread, score, branch) of the threads that a cluster goes on: 1 for the same entity, 0.9 for names that share half of their words, else what fingerprints share from 0.4 on.

    ``clusters``: cluster, entity, words (of the entity), tokens; ``threads``: thread, entity, words, tokens (its fingerprint). One cluster may have several rows, one for each entity. Pairs
    meet on entities, words or tokens that they share; clusters with the same of these are one kind, and only kinds meet threads. The best match is branch 1, others follow by score and thread.
    """
    kind = F.unhex(F.md5(F.to_json(F.struct("entity", "words", "tokens")))).alias("kind")
    # of each cluster goes its kind alone, dealt once for all that follows
    dealt = clusters.select("cluster", kind).repartition("cluster")
    kinds = clusters.select(kind, "entity", "words", "tokens").dropDuplicates(["kind"])

    def overlap(column: str, floor: float, score):
        a = kinds.select("kind", F.size(column).alias("na"), F.explode(F.array_distinct(column)).alias("w"))
        b = threads.select("thread", F.size(column).alias("nb"), F.explode(F.array_distinct(column)).alias("w"))
        shared = a.join(b, "w").groupBy("kind", "thread", "na", "nb").agg(F.count("*").alias("i"))
        likeness = F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))
        return shared.where(likeness >= floor).select("kind", "thread", (likeness if score is None else F.lit(score)).alias("score"))

    same = kinds.select("kind", "entity").join(threads.select("thread", "entity"), "entity").select("kind", "thread", F.lit(1.0).alias("score"))
    pairs = same.union(overlap("words", 0.5, 0.9)).union(overlap("tokens", 0.4, None)).groupBy("kind", "thread").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    # written, so that its size is known and few pairs are sent to the clusters
    pairs = Scratch(clusters.sparkSession).written(pairs, "thread-pairs")
    best = dealt.join(pairs, "kind").groupBy("cluster", "thread").agg(F.max("score").alias("score"))
    order = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "thread")
    return best.withColumn("branch", F.row_number().over(order).cast("long"))
