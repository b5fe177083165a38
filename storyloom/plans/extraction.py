"""Queries that take graphs and facts out of texts, and gates of feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions import cleaning
from storyloom.functions.text import EPISTEMIC
from storyloom.operators import entities, extraction, gates, search
from storyloom.plans.entities import CATEGORY, WORD_TESTS
from storyloom.plans.registry import REPORTS, bounded, query
from storyloom.sources.tables import read, read_reports

TARGETS = (("Air Base", r"air\s+base"), ("Red Sector", "red"), ("Counter Drone", "trials|widget"), ("Navy", "orders"))
KINDS = ("tank", "valley", "attack", "navy", "mission", "India")


def one_of_each_id(reports: DataFrame, *more: str) -> DataFrame:
    """Lines may repeat their numbers; of reports with one id the least counts."""
    return reports.groupBy("id").agg(F.min(F.struct("title", "snippet", "published", "domain", "part", "nation", *more)).alias("r")).select("id", "r.*")


def stories(spark, sf_dir) -> DataFrame:
    """Reports as stories: a part with a word that tells its kind, a nation, a general name, and tags."""
    n = F.col("id") % len(KINDS)
    kind = F.get(F.array(*map(F.lit, KINDS)), n.cast("int"))
    denied = F.when(F.col("id") % 11 == 0, F.lit(" It denied reports.")).when(F.col("id") % 13 == 0, F.lit(" An unconfirmed deal.")).otherwise("")
    # times of different kinds at both ends: the order is not that of time
    return one_of_each_id(read_reports(spark, sf_dir)).select(
        F.col("id").alias("story"), (-F.col("id")).alias("at"), "published", "title", F.concat("snippet", denied).alias("snippet"), F.lit("").alias("headline"), F.concat(F.lit("http://"), "domain").alias("url"),
        F.array(F.concat("part", F.lit(" "), kind), F.col("nation"), F.lit("The  Army"), kind, F.lit("")).alias("entities"), F.array(F.concat(F.lit("#"), F.upper("nation")), F.concat(F.lit("#Fort-"), F.col("nation"))).alias("tags"),
    )


def targets(spark) -> DataFrame:
    return spark.createDataFrame([(k, n, p) for k, (n, p) in enumerate(TARGETS)], "position long, name string, pattern string")


STATES = "CASE " + " ".join(f"WHEN regexp_matches(text, '{bounded(p)}') THEN '{n}'" for n, p in EPISTEMIC) + " ELSE 'CONFIRMED' END"
RELATION = (
    "CASE " + " ".join(f"WHEN {WORD_TESTS[w]} AND {one} THEN '{n}' WHEN {WORD_TESTS[w]} AND {two} THEN '<{n}'" for w, n, one, two in (
        ("d", "DEPLOYED_TO", "x = 'platform' AND y IN ('location', 'facility')", "y = 'platform' AND x IN ('location', 'facility')"),
        ("t", "TESTED_AT", "x = 'platform' AND y IN ('location', 'facility')", "y = 'platform' AND x IN ('location', 'facility')"),
        ("c", "TARGETS", "x = 'platform' AND y = 'threat'", "y = 'platform' AND x = 'threat'"), ("b", "PROCURES", "x = 'organization' AND y = 'platform'", "y = 'organization' AND x = 'platform'"),
    )) + " WHEN y = 'platform' AND x = 'program' THEN '<CONNECTED_TO' WHEN x <> y OR x = 'platform' THEN 'CONNECTED_TO' END"
)
STOPS = "(" + ", ".join(f"'{x}'" for x in extraction.STOP_NODES) + ")"
STOPS_THE = "(" + ", ".join(f"'{x}'" for x in extraction.STOP_WITH_ARTICLE) + ")"
GRAPH = (
    f"{REPORTS.replace('reports AS', 'every AS')}, reports AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY title, snippet, published, domain, part, nation) = 1), s AS (SELECT id AS story, -id AS seq, published, concat(' ', snippet, CASE WHEN id % 11 = 0 THEN ' It denied reports.' WHEN id % 13 = 0 THEN ' An unconfirmed deal.' ELSE '' END, ' ', title) AS text, concat('http://', domain) AS url, nation, part, ({list(KINDS)})[id % 6 + 1] AS kind FROM reports), "
    "e AS (SELECT story, 0 AS g, 0 AS k, concat(part, ' ', kind) AS name FROM s UNION ALL SELECT story, 0, 1, nation FROM s UNION ALL SELECT story, 0, 2, 'The  Army' FROM s UNION ALL SELECT story, 0, 3, kind FROM s "
    + " ".join(f"UNION ALL SELECT story, 1, {k}, '{n}' FROM s WHERE regexp_matches(text, '{bounded(p)}')" for k, (n, p) in enumerate(TARGETS))
    # the nation is an entity in capitals already, so only the second tag adds a name; letters and digits of a tag are split
    + " UNION ALL SELECT story, 2, 1, concat('Fort-', nation) FROM s), "
    "c AS (SELECT story, lower(name) AS key, min((g, k)) AS rank, arg_max(name, (g, k)) AS name FROM e GROUP BY 1, 2), "
    f"v AS (SELECT story, rank, name, concat('node_', trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')) AS node, {CATEGORY.format('name')} AS kind FROM c WHERE lower(name) NOT IN {STOPS} AND regexp_replace(regexp_replace(lower(name), '^the\\s+', ''), '\\s+', ' ', 'g') NOT IN {STOPS_THE}), "
    f"p AS (SELECT a.story, s.seq, s.published, s.url, {STATES} AS state, a.node AS na, b.node AS nb, a.rank AS ra, b.rank AS rb, {RELATION.replace('body', 'text')} AS r FROM (SELECT *, kind AS x FROM v) a JOIN (SELECT *, kind AS y FROM v) b ON a.story = b.story AND a.rank < b.rank JOIN s ON s.story = a.story), "
    "o AS (SELECT CASE WHEN r[1] = '<' THEN nb ELSE na END AS source, replace(r, '<', '') AS predicate, CASE WHEN r[1] = '<' THEN na ELSE nb END AS target, * FROM p WHERE r IS NOT NULL), "
    "edges AS (SELECT source, predicate, target, count(*) AS weight, arg_max(state, (seq, story, ra, rb)) AS state, arg_min(story, (seq, story, ra, rb)) AS story, arg_min(url, (seq, story, ra, rb)) AS url, arg_min(published, (seq, story, ra, rb)) AS first_observed, max(published) AS last_observed FROM o WHERE source <> target GROUP BY 1, 2, 3)"
)


@query("graph_out_of_stories", f"WITH {GRAPH} SELECT source, predicate, target, weight, state, story, url, first_observed, last_observed FROM edges")
def graph_out_of_stories(spark, sf_dir):
    """All edges out of all pairs of names of reports, with state by the last report that tells of one."""
    found = stories(spark, sf_dir)
    return extraction.edges(found, extraction.candidates(found, targets(spark))).drop("context")


@query(
    "nodes_out_of_stories",
    f"WITH {GRAPH}, m AS (SELECT node, arg_min(name, (seq, v.story, rank)) AS label, count(*) AS mentions, arg_min(published, (seq, v.story, rank)) AS first_seen, max(published) AS last_seen FROM v JOIN s ON s.story = v.story GROUP BY 1), d AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1) "
    f"SELECT node, label, {CATEGORY.format('label')} AS category, mentions, first_seen, last_seen, coalesce(degree, 0) AS degree FROM m LEFT JOIN d USING (node)",
)
def nodes_out_of_stories(spark, sf_dir):
    """All nodes with mentions and degrees; general names are suppressed."""
    return extraction.nodes_with_degrees(stories(spark, sf_dir), targets(spark))


@query("suppressed_names", f"WITH {GRAPH} SELECT name, count(*) AS n FROM c WHERE NOT EXISTS (FROM v WHERE v.story = c.story AND v.name = c.name) GROUP BY 1")
def suppressed_names(spark, sf_dir):
    """How often each general name was left out."""
    return extraction.candidates(stories(spark, sf_dir), targets(spark)).where("stop").groupBy("name").agg(F.count("*").alias("n"))


# --- gates

GATES = gates.Gates("scum|vermin", "copyright|rights", "password|token|key", "with|pour", "der|los", "und|de", ("s1",), ("s0", "s3"))
NAMES = (("ration", "ra[a-z]*"), ("number", "[0-9]{2,}"))


@query(
    "relevance_gates",
    "WITH d AS (SELECT doc_id, concat(split_part(text, chr(10), 1), ' ', text) AS t, concat('s', CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 5) AS tier, CASE WHEN doc_id % 20 = 0 THEN 's1' ELSE 's2' END AS feed FROM documents), "
    + "m AS (SELECT doc_id, tier = 's1' OR feed = 's1' AS social, tier IN ('s0', 's3') AS passes, " + ", ".join(f"regexp_matches(t, '{bounded(p)}') AS {n}" for n, p in (("black", GATES.blacklist), ("cer", GATES.ceremonial), ("act", GATES.action), ("kw", GATES.keywords), ("alone", GATES.alone), ("corr", GATES.corroboration))) + ", "
    + " OR ".join(f"regexp_matches(t, '{bounded(p)}')" for _, p in NAMES) + " AS named FROM d), g AS (SELECT doc_id, CASE WHEN black THEN 'blacklist' WHEN social AND cer THEN 'ceremonial' WHEN social AND act THEN 'action' WHEN social AND named THEN 'social_entity' WHEN social THEN 'no_action' WHEN named THEN 'entity' WHEN kw THEN 'keyword' WHEN alone AND corr THEN 'corroborated' WHEN passes THEN 'tier' ELSE 'nothing' END AS gate FROM m) "
    "SELECT doc_id, gate, gate NOT IN ('blacklist', 'ceremonial', 'no_action', 'nothing') AS relevant FROM g",
)
def relevance_gates(spark, sf_dir):
    """All documents through the gates in their order: six of every feed, and those of social posts."""
    tier = F.concat(F.lit("s"), (F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 5).cast("string"))
    items = read(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("snippet"), tier.alias("tier"), F.when(F.col("doc_id") % 20 == 0, "s1").otherwise("s2").alias("feed_tier"))
    names = spark.createDataFrame([(k, p) for k, (_, p) in enumerate(NAMES)], "position long, pattern string")
    return gates.gated(items, "doc_id", GATES, names)


LOW = "regexp_replace(lower(tag), '[\\s\\-_#]+', '', 'g')"


@query(
    "domain_tags",
    "WITH t AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN concat('#', p_name) WHEN 1 THEN concat('#', ['LAC', 'Su', 'Radar', 'News', 'mod'][p_partkey % 5 + 1], p_partkey % 100) WHEN 2 THEN concat('#th_', split_part(p_name, ' ', 2)) WHEN 3 THEN ['#India', '#', 'x', '#Cuas-Net', 'c-uas'][p_partkey % 5 + 1] ELSE p_brand END AS tag FROM part) "
    f"SELECT tag, length({LOW}) > 1 AND {LOW} NOT IN (" + ", ".join(f"'{x}'" for x in cleaning.NOISE_TAGS) + f") AND (regexp_matches(regexp_replace({LOW}, '^th', ''), '^({gates.ACRONYM_TAGS})\\d*[a-z]?$') OR regexp_matches(regexp_replace({LOW}, '^th', ''), '^({gates.STRATEGIC_TAGS})') OR regexp_matches(tag, '(?i)(^|[^A-Za-z0-9])(widgets?)([^A-Za-z0-9_]|$)')) AS in_domain FROM t",
)
def domain_tags(spark, sf_dir):
    """Tags made of parts: acronyms with numbers, strategic beginnings, noise, and names of a dictionary."""
    k = F.col("p_partkey")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (k % 5).cast("int"))
    tag = F.when(k % 6 == 0, F.concat(F.lit("#"), "p_name")).when(k % 6 == 1, F.concat(F.lit("#"), pick(["LAC", "Su", "Radar", "News", "mod"]), (k % 100).cast("string"))).when(k % 6 == 2, F.concat(F.lit("#th_"), F.split_part("p_name", F.lit(" "), F.lit(2))))
    tag = tag.when(k % 6 == 3, pick(["#India", "#", "x", "#Cuas-Net", "c-uas"])).otherwise(F.col("p_brand"))
    names = spark.createDataFrame([(0, "widgets?")], "position long, pattern string")
    return gates.domain_tags(read(spark, sf_dir, "part").select(tag.alias("tag")), "tag", names)


# --- facts

TOLD = (
    "CASE doc_id % 9 WHEN 0 THEN concat(' Rs. 1,', lpad((doc_id % 1000)::VARCHAR, 3, '0'), '.5 crore, 12 new fighter jets by 2027-29.') WHEN 1 THEN concat(' INR ', doc_id % 500, 'cr for 3 batteries; 2031–2035 plan') WHEN 2 THEN concat(' A fund of ', doc_id % 700, ' Crores, ic of ', doc_id % 130, '% in March 2026') "
    "WHEN 3 THEN concat(' 7 large guns, delivery by 2040, ', doc_id % 130, '% IC only') WHEN 4 THEN ' targeted for FY26 and 60% iddm' WHEN 5 THEN concat(' x₹', doc_id % 90, ' and 0 crore') WHEN 6 THEN ' scheduled to commence by 2026-27, 55% local content' ELSE '' END"
)


@query(
    "document_facts",
    f"WITH d AS (SELECT doc_id, concat(text, {TOLD}) AS t FROM documents), f AS (SELECT *, TRY_CAST(replace(coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{entities.BUDGET}', {k}), '')" for k in (1, 2, 3)) + "), ',', '') AS DOUBLE) AS b, "
    f"TRY_CAST(coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in entities.SHARES) + ") AS INT) AS s, " + f"TRY_CAST(nullif(regexp_extract(t, '{entities.MILESTONE_SHARE}', 1), '') AS INT) AS ms FROM d), "
    + "y AS (SELECT *, " + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN concat_ws('-', regexp_extract(t, '{p}', 1), nullif(regexp_extract(t, '{p}', 2), '')) END AS {n}" for n, p in (("by_year", entities.BY_YEAR), ("years", entities.YEARS))) + " FROM f) "
    f"SELECT doc_id, CASE WHEN b > 0 THEN b END AS budget, CASE WHEN regexp_matches(t, '{entities.THINGS}') THEN concat(regexp_extract(t, '{entities.THINGS}', 1), ' ', lower(regexp_extract(t, '{entities.THINGS}', 2))) END AS quantity, coalesce(by_year, years) AS timeline, CASE WHEN s <= 100 THEN s END AS share, "
    f"TRY_CAST(replace(nullif(regexp_extract(t, '{entities.MILESTONE_BUDGET}', 1), ''), ',', '') AS DOUBLE) AS milestone_budget, nullif(trim(regexp_extract(t, '{entities.MILESTONE_TIME}', 1)), '') AS milestone_timeline, CASE WHEN ms <= 100 THEN ms END AS milestone_share FROM y",
)
def document_facts(spark, sf_dir):
    """Facts of whole documents with sentences after them that tell of amounts, quantities, years, ranges, financial years, months and shares in all their forms."""
    k = F.col("doc_id")
    n = lambda m: (k % m).cast("string")
    told = [
        F.concat(F.lit(" Rs. 1,"), F.lpad(n(1000), 3, "0"), F.lit(".5 crore, 12 new fighter jets by 2027-29.")), F.concat(F.lit(" INR "), n(500), F.lit("cr for 3 batteries; 2031–2035 plan")), F.concat(F.lit(" A fund of "), n(700), F.lit(" Crores, ic of "), n(130), F.lit("% in March 2026")),
        F.concat(F.lit(" 7 large guns, delivery by 2040, "), n(130), F.lit("% IC only")), F.lit(" targeted for FY26 and 60% iddm"), F.concat(F.lit(" x₹"), n(90), F.lit(" and 0 crore")), F.lit(" scheduled to commence by 2026-27, 55% local content"),
    ]
    tail = F.lit("")
    for case, text in reversed(list(enumerate(told))):
        tail = F.when(k % 9 == case, text).otherwise(tail)
    text = F.concat("text", tail)
    of = {f"milestone_{name}": c for name, c in entities.milestone_facts(F.col("t")).items()}
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("t")).select("doc_id", *[c.alias(name) for name, c in (entities.metrics(F.col("t")) | of).items()])


@query(
    "verbatim_quotes",
    "WITH s AS (SELECT doc_id, source, list_filter(list_transform(string_split_regex(regexp_replace(trim(concat(split_part(text, chr(10), 1), '. ', text)), '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: length(x) > 20) AS q, trim(concat(split_part(text, chr(10), 1), '. ', text)) AS whole FROM documents), "
    "p AS (SELECT *, coalesce(list_filter(q, lambda x: regexp_matches(x, '(?i)deal|approv|sanction|sign|induct|trial|clears|procure'))[1], q[1], whole) AS sentence FROM s) SELECT doc_id, sentence AS told FROM p",
)
def verbatim_quotes(spark, sf_dir):
    """The sentence of each document that a quote is made of: of the quote what stands between its marks, before it is cut."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text")
    return docs.select("doc_id", entities.telling_sentence(F.col("title"), F.col("text")).alias("told"))


# --- search in stories

SEARCHES = (("widget", None), ("src3", "NATION_1"), ("BRAND#1", None), ("25% ind", None), ("", "NATION_2"), ("formerly of nation_2", "NATION_2"), ("no such text", None))


@query(
    "story_search",
    f"WITH {REPORTS}, x AS (SELECT cluster, arg_min({{'title': title, 'domain': domain, 'snippet': snippet, 'program': program, 'tier': tier}}, (published, title, snippet, domain, program, tier, part, nation)) AS p, list_distinct(list(part)) AS entities, list_distinct(list(nation)) AS categories, list(concat(title, ' | ', domain)) AS related, bool_or(tier = 4 AND part LIKE 'red%') AS ignored FROM reports GROUP BY 1), "
    "q AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t.lower()}', {'NULL' if c is None else repr(c)})" for k, (t, c) in enumerate(SEARCHES)) + ") AS v(q, t, c)) "
    "SELECT q, cluster FROM x, q WHERE NOT ignored AND (c IS NULL OR list_contains(categories, c)) AND (contains(lower(p.title), t) OR contains(lower(p.domain), t) OR contains(lower(p.snippet), t) OR (p.tier < 2 AND contains(lower(p.program), t)) OR len(list_filter(entities, lambda e: contains(lower(e), t))) > 0 OR len(list_filter(related, lambda e: contains(lower(e), t))) > 0)",
)
def story_search(spark, sf_dir):
    """Seven searches over clusters that are not ignored: in headline, title, source, snippet, entities, what a brief says (reason, points, platform; some have none), and titles and sources of other coverage."""
    order = F.struct("published", "title", "snippet", "domain", "program", "tier", "part", "nation")
    found = read_reports(spark, sf_dir).groupBy("cluster").agg(
        F.min_by(F.struct("title", "domain", "snippet", "program", "tier"), order).alias("p"), F.collect_set("part").alias("entities"), F.collect_set("nation").alias("categories"), F.collect_list(F.struct("title", "domain")).alias("related"),
        F.bool_or((F.col("tier") == 4) & F.col("part").startswith("red")).alias("ignored"),
    )
    briefed = F.col("p.tier") < 2
    texts = [F.upper("p.title"), F.col("p.title"), F.col("p.domain"), F.col("p.snippet"), F.when(briefed, F.col("p.program")), F.lit(None).cast("string")]
    lists = [F.col("entities"), F.when(briefed, F.array("p.program")), F.transform("related", lambda r: F.concat_ws(" | ", r["title"], r["domain"]))]
    # all searches in one pass over the clusters
    found = found.withColumn("deleted", F.lit(None).cast("boolean"))
    tests = [F.when(search.is_eligible(category, text, ["ignored", "deleted"], texts, lists), F.lit(k)) for k, (text, category) in enumerate(SEARCHES)]
    return found.select(F.explode(F.array_compact(F.array(*tests))).alias("q"), "cluster")
