"""Queries of scores, order, similarity and clusters of stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import ranking, stories
from storyloom.plans.registry import ARTICLES, REPORTS, TOKENS, bounded, query
from storyloom.sources.tables import articles, read, read_reports

NOW = 7000
# Clusters of five documents: the first is the primary source.
WEIGHT = "CASE tier WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6 WHEN 2 THEN 0.85 WHEN 3 THEN 0.7 ELSE 0.5 END"
ONE = f"least(100.0::DOUBLE, {WEIGHT} * 100.0 * m)"
CLUSTERS = (
    f"{ARTICLES}, s AS (SELECT id // 5 AS cluster, id % 5 AS k, id, title, tier, published_min AS pub, 0.9::DOUBLE + (id % 3) * 0.1 AS m, ({NOW} - published_min) / 60.0 AS age FROM articles), "
    f"c AS (SELECT cluster, count(*) AS n, max(pub) AS updated, max(CASE WHEN k = 0 THEN {ONE} END) AS first_w, list({ONE} ORDER BY id) FILTER (k > 0) AS rest, "
    f"coalesce(list_reduce(list_prepend(0.0::DOUBLE, list(({WEIGHT} / greatest(0.5, age)::DOUBLE)::DOUBLE ORDER BY id) FILTER (age >= 0 AND age <= 6)), lambda a, b: a + b), 0.0) AS speed, "
    "lower(concat(max(CASE WHEN k = 0 THEN title END), ' entity', cluster % 9)) AS body, bool_or(k = 0 AND tier = 0) AS official, bool_or(tier = 2) AS social, count(*) FILTER (tier IN (0, 2)) AS t1, count(*) FILTER (tier = 3) AS t2 FROM s GROUP BY 1), "
    "p AS (SELECT *, floor(CASE WHEN n = 1 THEN first_w ELSE first_w * 0.6 + list_reduce(list_prepend(0.0::DOUBLE, rest), lambda a, b: a + b) / (n - 1) * 0.4 END + 0.5) AS authority, CASE n WHEN 1 THEN 25 WHEN 2 THEN 50 WHEN 3 THEN 70 WHEN 4 THEN 85 ELSE least(100, 85 + (n - 4) * 5) END AS source_count, "
    f"floor(100.0::DOUBLE / (1.0 + pow(greatest(0.0, ({NOW} - updated) / 60.0)::DOUBLE / 4.0, 1.6)) * 10 + 0.5) / 10 AS recency, CASE cluster % 4 WHEN 0 THEN 0 WHEN 1 THEN 15 WHEN 2 THEN 50 ELSE 100 END AS brief, "
    "least(100, (CASE cluster % 3 WHEN 0 THEN 25 WHEN 1 THEN 20 ELSE 15 END) + least(40, 15 * (" + " + ".join(f"contains(body, '{w}')::INT" for w in ranking.STRATEGIC_WORDS) + "))) AS strategic, "
    "CASE WHEN speed >= 4.5 THEN 100 WHEN speed >= 3.0 THEN 75 WHEN speed >= 1.5 THEN 50 ELSE 20 END AS velocity, CASE WHEN cluster % 4 >= 2 THEN 100 WHEN cluster % 4 = 1 THEN 50 ELSE 0 END AS discussion FROM c), "
    "q AS (SELECT *, official::INT * 20 + social::INT * 15 + " + f"(regexp_matches(body, '{bounded(ranking.CLEARANCE)}') OR (regexp_matches(body, '{bounded(ranking.PURCHASE)}') AND regexp_matches(body, '{bounded(ranking.PURCHASED)}')))::INT * 15 + "
    "(" + " OR ".join(f"contains(body, '{w}')" for w in ranking.BORDER_WORDS) + ")::INT * 15 + (velocity >= 50 AND (t1 >= 1 OR t2 >= 2))::INT * 15 + (cluster % 11 = 0)::INT * 25 - (cluster % 7 = 0)::INT * 20 AS bonus FROM p), "
    "r AS (SELECT *, greatest(0.0::DOUBLE, floor((authority * 0.25::DOUBLE + source_count * 0.2::DOUBLE + recency * 0.15::DOUBLE + brief * 0.15::DOUBLE + strategic * 0.1::DOUBLE + velocity * 0.1::DOUBLE + discussion * 0.05::DOUBLE + bonus) * 10.0 + 0.5) / 10.0) AS score FROM q)"
)


def clusters(spark, sf_dir):
    """Five neighbouring documents are one cluster; what documents do not have follows from the cluster's number."""
    found = articles(read(spark, sf_dir, "documents"))
    source = F.struct("id", "tier", "published_min", (F.lit(0.9) + (F.col("id") % 3) * 0.1).alias("multiplier"), "title")
    c = F.col("cluster")
    grouped = found.groupBy(F.floor(F.col("id") / 5).alias("cluster")).agg(F.array_sort(F.collect_list(source)).alias("all"), F.max("published_min").alias("updated_min"))
    return grouped.select(
        "cluster", "updated_min", F.col("all")[0].alias("primary"), F.slice("all", 2, 4).alias("related"), F.col("all")[0]["title"].alias("headline"), F.array(F.concat(F.lit("entity"), (c % 9).cast("string"))).alias("entities"),
        F.array(F.when(c % 3 == 0, "strategic").when(c % 3 == 1, "procurement").otherwise("tech")).alias("categories"), (c % 4).alias("discussions"), F.when(c % 4 == 3, 2).when(c % 4 == 1, 1).otherwise(0).alias("points"),
        F.when(c % 4 == 3, 2).otherwise(0).alias("questions"), F.when(c % 4 >= 2, "It matters a lot").alias("why"), (c % 4 >= 2).alias("takeaway"), (c % 11 == 0).alias("promoted"), (c % 7 == 0).alias("ignored"),
    )


PARTS = ["authority", "source_count", "recency", "brief", "strategic", "velocity", "discussion", "bonus"]


@query("score_breakdown", f"WITH {CLUSTERS} SELECT cluster, {', '.join(f'CAST({p} AS DOUBLE) AS {p}' for p in PARTS)}, score FROM r")
def score_breakdown(spark, sf_dir):
    found = ranking.scored(clusters(spark, sf_dir), F.lit(NOW))
    return found.select("cluster", *[F.col(p).cast("double").alias(p) for p in PARTS], "score")


@query(
    "lead_story",
    f"WITH {CLUSTERS}, o AS (SELECT cluster, score, row_number() OVER (ORDER BY score DESC, updated DESC, cluster) AS position FROM r) "
    "SELECT cluster, score, position, position = (SELECT min(position) FROM o WHERE cluster % 7 <> 0) AS is_lead, cluster % 7 <> 0 AND score >= 75 AS autopilot FROM o",
)
def lead_story(spark, sf_dir):
    """All clusters in order of score, then the newest first; the lead and those that may go out unreviewed are marked."""
    found = ranking.scored(clusters(spark, sf_dir), F.lit(NOW)).select("cluster", "score", "ignored", F.struct((-F.col("updated_min")).alias("a"), "cluster").alias("tie"))
    ranked = ranking.with_lead(stories.ranked(found, "score", "tie"))
    pilot = ranking.autopilot(found).select(F.col("cluster").alias("c"))
    joined = ranked.join(pilot, F.col("cluster") == F.col("c"), "left")
    return joined.select("cluster", "score", "position", "is_lead", F.col("c").isNotNull().alias("autopilot"))


@query("authority_classes", "SELECT DISTINCT source, CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 5 WHEN 0 THEN 'official' WHEN 2 THEN 'social' WHEN 3 THEN 'trusted' ELSE 'standard' END AS authority FROM documents")
def authority_classes(spark, sf_dir):
    tier = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 5
    return read(spark, sf_dir, "documents").select("source", ranking.authority_class(tier).alias("authority")).distinct()


@query(
    "action_signatures",
    f"WITH {REPORTS} SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(title, '{bounded(p)}') THEN '{n}' END" for n, p in stories.ACTIONS) + ") AS actions FROM reports",
)
def action_signatures(spark, sf_dir):
    return read_reports(spark, sf_dir).select("id", F.array_join(stories.actions(F.col("title")), ",").alias("actions"))


# A dictionary of entities for documents: word starts, of which one is an agency.
ENTITIES = (("Thorre", "th[a-z]{3,}", False), ("Renand", "re[a-z]{3,}", False), ("Agency", "in[a-z]{3,}", True))
DAY_MIN = 2880


@query(
    "story_similarity",
    f"WITH {ARTICLES}, t AS (SELECT id, published_min AS pub, split_part(lower(url), '?', 1) AS u, {TOKENS % 'title'} AS t, "
    + ", ".join(f"regexp_matches(title, '{bounded(p)}') AS e{k}" for k, (_, p, _) in enumerate(ENTITIES)) + ", " + ", ".join(f"regexp_matches(title, '{bounded(p)}') AS a{k}" for k, (_, p) in enumerate(stories.ACTIONS))
    + " FROM articles), p AS (SELECT a.id AS a, b.id AS b, a.u = b.u AS same, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS x, len(b.t) AS y, "
    + "(" + " OR ".join(f"(a.e{k} AND b.e{k})" for k, e in enumerate(ENTITIES) if not e[2]) + ") AS platform, (" + " OR ".join(f"(a.e{k} AND b.e{k})" for k in range(len(ENTITIES))) + ") AS entity, "
    + "(" + " OR ".join(f"(a.a{k} AND b.a{k})" for k in range(len(stories.ACTIONS))) + f") AS action FROM t a JOIN t b ON a.id < b.id AND (a.u = b.u OR b.pub - a.pub <= {DAY_MIN})), "
    "j AS (SELECT *, CASE WHEN i = 0 THEN 0.0 ELSE i / (x + y - i) END AS jaccard FROM p) SELECT a, b FROM j WHERE same OR jaccard >= CASE WHEN platform AND action THEN 0.05 WHEN platform THEN 0.14 WHEN entity THEN 0.24 ELSE 0.32 END",
)
def story_similarity(spark, sf_dir):
    """Pairs of articles that tell one story: the same address, or titles alike enough for what entities and actions they share."""
    found = articles(read(spark, sf_dir, "documents"))
    entities = F.filter(F.array(*[F.when(text.has_word(F.col("title"), p), F.struct(F.lit(n).alias("name"), F.lit(agency).alias("agency"))) for n, p, agency in ENTITIES]), lambda e: e.isNotNull())
    marked = found.select("id", "title", "published_min", "url", entities.alias("entities"), stories.actions(F.col("title")).alias("actions"))
    return stories.same_story(marked).select("a", "b")


@query(
    "cluster_documents",
    f"WITH {REPORTS} SELECT cluster, arg_max(id, (tier <> 2, CASE tier WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.85 WHEN 3 THEN 0.7 ELSE 0.5 END, published, -id)) AS primary_id, count(*) AS sources, "
    "string_agg(DISTINCT part, ',' ORDER BY part) AS tags, max(published) AS updated_at, count(*) FILTER (tier = 2) AS discussions, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM reports GROUP BY 1",
)
def cluster_documents(spark, sf_dir):
    found = stories.cluster_documents(read_reports(spark, sf_dir), "cluster", ranking.tier_weight(F.col("tier")), F.col("tier") == ranking.SOCIAL)
    members = F.array_join(F.transform(F.array_sort(F.transform("members", lambda m: m["id"])), lambda i: i.cast("string")), ",")
    return found.select("cluster", F.col("primary.id").alias("primary_id"), F.size("members").cast("long").alias("sources"), F.array_join("tags", ",").alias("tags"), "updated_at", F.size("discussions").cast("long").alias("discussions"), members.alias("members"))
