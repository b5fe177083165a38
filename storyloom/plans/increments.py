"""Queries over runs that add up: candidates, supplier links, identities with lineage; and checks of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import cleaning, scoring
from storyloom.operators import continuity, distinct, ingest
from storyloom.plans.registry import REPORTS, query
from storyloom.sources.shared import Scratch
from storyloom.sources.tables import read, read_reports

RUNS = 3


@query(
    "candidates_over_runs",
    f"WITH {REPORTS} SELECT replace(part, ' ', '-') AS slug, count(*) AS mentions, count(DISTINCT domain) AS sources, min(published) AS first_seen, max(published) AS last_seen, "
    "coalesce(arg_min(CASE WHEN tier = 0 THEN 'air' ELSE 'sea' END, (published, CASE WHEN tier = 0 THEN 'air' ELSE 'sea' END)) FILTER (tier < 2), 'tech') AS category, count(*) >= 3 AND count(DISTINCT domain) >= 2 AS promoted FROM reports GROUP BY 1",
)
def candidates_over_runs(spark, sf_dir):
    """Candidates after three runs, each merged into the table of the one before; they are those of one run over all reports."""
    found = read_reports(spark, sf_dir).select(
        "id", cleaning.slug(F.col("part")).alias("slug"), F.col("part").alias("name"), F.when(F.col("tier") == 0, "air").when(F.col("tier") == 1, "sea").otherwise("tech").alias("category"), "domain", F.col("published").alias("seen"),
    )
    scratch, table = Scratch(spark), None
    for k in range(RUNS):
        table = scratch.written(distinct.merged_candidates(table, distinct.candidate_batch(found.where(F.col("id") % RUNS == k))), "candidates")
    scratch.close(table)
    return distinct.candidate_table(table)


@query(
    "supplier_links_over_runs",
    f"WITH {REPORTS} SELECT supplier, program, count(*) AS mentions, count(DISTINCT domain) AS sources, floor(least(1.0::DOUBLE, 0.3::DOUBLE + 0.15::DOUBLE * count(*) + 0.1::DOUBLE * count(DISTINCT domain)) * 10000.0 + 0.5) / 10000.0 AS confidence FROM reports GROUP BY 1, 2",
)
def supplier_links_over_runs(spark, sf_dir):
    """Links of suppliers and programmes with the confidence that their mentions and distinct sources give, after three runs."""
    reports, scratch, table = read_reports(spark, sf_dir), Scratch(spark), None
    keys = ["supplier", "program"]
    for k in range(RUNS):
        part = reports.where(F.col("id") % RUNS == k)
        batch = part.groupBy(*keys).agg(F.count("*").alias("mentions")).join(distinct.distinct_states(part, keys, "domain"), keys)
        if table is not None:
            o, n = table.alias("o"), batch.alias("n")
            j = o.join(n, keys, "full_outer")
            values = F.when(F.col("n.mentions").isNull(), F.col("o.values")).otherwise(distinct.merged_values(F.col("o.values"), F.col("n.values"), F.col("o.mentions").isNull()))
            batch = j.select(*keys, (F.coalesce("o.mentions", F.lit(0)) + F.coalesce("n.mentions", F.lit(0))).alias("mentions"), values.alias("values"), distinct.merged_sketches(F.col("o.sketch"), F.col("n.sketch")).alias("sketch"))
        table = scratch.written(batch, "links")
    scratch.close(table)
    count = distinct.distinct_count(F.col("values"), F.col("sketch"))
    return table.select(*keys, "mentions", count.alias("sources"), scoring.link_confidence(F.col("mentions"), count).alias("confidence"))


CLAIMS = (
    "WITH RECURSIVE c AS (SELECT o_custkey AS cluster, min(o_orderkey) AS ord, concat('f', o_custkey % 60) AS fp FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY ord) AS k FROM c), "
    # every third order was in a former cluster; former clusters have fingerprints, the greatest of one counts
    "a AS (SELECT k, cluster, concat('p', o_orderkey % 97) AS prior, min(o_orderkey) AS pos FROM k JOIN orders ON o_custkey = cluster WHERE o_orderkey % 3 = 0 AND o_custkey % 4 <> 0 GROUP BY 1, 2, 3), "
    "f AS (SELECT concat('f', o_orderkey % 97 % 50) AS fp, max(concat('p', o_orderkey % 97)) AS prior FROM orders GROUP BY 1), "
    "w AS (SELECT * FROM a UNION ALL SELECT k, cluster, prior, 0 FROM k JOIN f USING (fp) WHERE cluster NOT IN (SELECT cluster FROM a)), l AS (SELECT k.k, k.cluster, coalesce(list(prior ORDER BY pos, prior) FILTER (prior IS NOT NULL), []) AS wants FROM k LEFT JOIN w USING (k, cluster) GROUP BY 1, 2), "
    "r AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS cluster, NULL::VARCHAR AS id, []::VARCHAR[] AS before, []::VARCHAR[] AS claimed, []::VARCHAR[] AS wants UNION ALL SELECT l.k, l.cluster, list_filter(l.wants, lambda x: NOT list_contains(claimed, x))[1], claimed, list_concat(claimed, list_filter(l.wants, lambda x: NOT list_contains(claimed, x))[1:1]), l.wants FROM r JOIN l ON l.k = r.k + 1), "
    "i AS (SELECT cluster, coalesce(id, concat('new_', cluster)) AS id, before, wants FROM r WHERE k > 0), n AS (SELECT x AS predecessor, id AS successor, CASE WHEN list_contains(before, x) THEN 'split' ELSE 'merge' END AS change FROM (SELECT *, unnest(wants) AS x FROM i) WHERE x <> id) "
)


def claims(spark, sf_dir):
    """Customers as clusters of orders: some are known by orders, some by fingerprints alone, some by nothing."""
    orders = read(spark, sf_dir, "orders")
    clusters = orders.groupBy(F.col("o_custkey").alias("cluster")).agg(F.min("o_orderkey").alias("ord")).withColumn("fingerprint", F.concat(F.lit("f"), (F.col("cluster") % 60).cast("string")))
    members = orders.where("o_custkey % 4 <> 0").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("article"), F.col("o_orderkey").alias("pos"))
    k = F.col("o_orderkey") % 97
    prior = orders.select(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("article"), F.concat(F.lit("p"), k.cast("string")).alias("prior_id"), F.concat(F.lit("f"), (k % 50).cast("string")).alias("fingerprint"))
    return ingest.reused_ids(clusters, members, prior)


@query("cluster_claims", CLAIMS + "SELECT cluster, id FROM i")
def cluster_claims(spark, sf_dir):
    """The id of each cluster: a former one of its articles, else one of its fingerprint, else a new one."""
    return claims(spark, sf_dir)[0]


@query("cluster_lineage", CLAIMS + "SELECT predecessor, successor, change, count(*) AS n FROM n GROUP BY 1, 2, 3")
def cluster_lineage(spark, sf_dir):
    """What became of former ids that a cluster did not take: merged into it, or split from an earlier one's."""
    return claims(spark, sf_dir)[1].groupBy("predecessor", "successor", "change").agg(F.count("*").alias("n"))


@query(
    "lineage_applied",
    CLAIMS + ", d AS (SELECT DISTINCT predecessor, successor FROM n), t AS (SELECT DISTINCT concat('p', o_orderkey % 97) AS cluster, o_orderpriority AS topic, o_orderkey % 97 % 5 = 0 AS locked FROM orders), x AS (SELECT successor AS cluster, topic FROM t JOIN d ON t.cluster = predecessor WHERE locked GROUP BY 1, 2), "
    "y AS (SELECT cluster, topic, locked FROM t ANTI JOIN x USING (cluster, topic) UNION ALL SELECT cluster, topic, true FROM x) SELECT cluster, topic, locked, EXISTS (FROM n WHERE change = 'merge' AND predecessor = cluster) AS merged FROM y",
)
def lineage_applied(spark, sf_dir):
    """Topics of former clusters after a run: locked ones go on to successors, and clusters that were merged into another one are marked."""
    k = F.col("o_orderkey") % 97
    table = read(spark, sf_dir, "orders").select(F.concat(F.lit("p"), k.cast("string")).alias("cluster"), F.col("o_orderpriority").alias("topic"), F.lit("actor").alias("role"), (k % 5 == 0).alias("locked")).distinct()
    lineage = claims(spark, sf_dir)[1]
    found = ingest.locks_to_successors(table, lineage.select("predecessor", "successor").distinct())
    merged = lineage.where("change = 'merge'").select(F.col("predecessor").alias("cluster")).distinct().withColumn("merged", F.lit(True))
    return found.join(merged, "cluster", "left").select("cluster", "topic", "locked", F.coalesce("merged", F.lit(False)).alias("merged"))


# --- names and ids

NOISE = "[" + ", ".join(f"'{w}'" for w in cleaning.NOISE_TAGS) + "]"
GENERIC = "[" + ", ".join(f"'{w}'" for w in continuity.GENERIC_NOUNS) + "]"


@query(
    "canonical_names",
    "WITH l AS (SELECT l_orderkey, list(p_name ORDER BY l_linenumber, p_partkey) AS names, list(CASE WHEN p_size % 3 = 0 THEN upper(p_name) WHEN p_size % 3 = 1 THEN 'News' ELSE concat(' ', p_brand) END ORDER BY l_linenumber, p_partkey) AS programs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), "
    f"a AS (SELECT l_orderkey, list_filter(list_transform(list_concat(programs, ['#army-base'], names), lambda x: CASE WHEN x[1] = '#' THEN 'Army-Base' ELSE trim(x) END), lambda x: NOT list_contains({NOISE}, regexp_replace(lower(x), '[\\s\\-_]+', '', 'g'))) AS n FROM l), "
    "b AS (SELECT l_orderkey, list_filter(n, lambda x, i: list_position(list_transform(n, lambda y: lower(y)), lower(x)) = i) AS n FROM a) SELECT l_orderkey, array_to_string(n, '|') AS names, array_to_string(list_sort(list_distinct(flatten(list_transform(n, lambda x: list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), "
    f"lambda w: length(w) >= 2 AND NOT list_contains({NOISE}, w) AND NOT list_contains({GENERIC}, w)))))), ' ') AS words FROM b",
)
def canonical_names(spark, sf_dir):
    """The names of orders as stories, each spelling once, programmes first, and their distinctive words."""
    item = F.struct("l_linenumber", "p_partkey", "p_name", "p_size", "p_brand")
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    items = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    programs = F.transform("x", lambda e: F.when(e["p_size"] % 3 == 0, F.upper(e["p_name"])).when(e["p_size"] % 3 == 1, "News").otherwise(F.concat(F.lit(" "), e["p_brand"])))
    names = continuity.canonical_entities(programs, F.lit("#army-base"), F.transform("x", lambda e: e["p_name"]))
    found = items.select("l_orderkey", names.alias("n"))
    words = F.array_sort(F.filter(F.array_distinct(F.flatten(F.transform("n", continuity.parts))), continuity.distinctive))
    return found.select("l_orderkey", F.array_join("n", "|").alias("names"), F.array_join(words, " ").alias("words"))


@query(
    "valid_rows",
    "SELECT event_id, json_valid(p) AS valid_json, regexp_full_match(t, '[a-z0-9][a-z0-9-]*') AS valid_id, lower(trim(t)) AS plain FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN substr(props, 1, length(props) - 1) WHEN 1 THEN '' ELSE props END AS p, CASE event_id % 3 WHEN 0 THEN concat(' ', upper(event_type), '-1 ') WHEN 1 THEN concat('-', event_type) ELSE concat(event_type, '-2') END AS t FROM events)",
)
def valid_rows(spark, sf_dir):
    """Checks of rows: JSON that parses, ids of small letters, digits and hyphens, names without spaces around."""
    k = F.col("event_id")
    props = F.when(k % 4 == 0, F.expr("substr(props, 1, length(props) - 1)")).when(k % 4 == 1, "").otherwise(F.col("props"))
    name = F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit("-1 "))).when(k % 3 == 1, F.concat(F.lit("-"), "event_type")).otherwise(F.concat("event_type", F.lit("-2")))
    return read(spark, sf_dir, "events").select("event_id", F.try_parse_json(props).isNotNull().alias("valid_json"), name.rlike("^[a-z0-9][a-z0-9-]*$").alias("valid_id"), F.lower(F.trim(name)).alias("plain"))


@query(
    "source_independence",
    "WITH s AS (SELECT o_orderkey AS cluster, l_suppkey % 7 AS domain, l_suppkey % 5 AS tier, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3) "
    "SELECT cluster, count(DISTINCT domain) AS domains, count(DISTINCT domain) FILTER (tier IN (0, 2)) AS trusted_domains, sum(n)::BIGINT AS sources, count(DISTINCT domain) >= 2 AS independent FROM s GROUP BY 1",
)
def source_independence(spark, sf_dir):
    """How many different publishers, and trusted ones, stand behind each cluster."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("cluster"), (F.col("l_suppkey") % 7).alias("domain"), (F.col("l_suppkey") % 5).alias("tier"))
    trusted = F.when(F.col("tier").isin(0, 2), F.col("domain"))
    found = lines.groupBy("cluster").agg(F.countDistinct("domain").alias("domains"), F.countDistinct(trusted).alias("trusted_domains"), F.count("*").alias("sources"))
    return found.withColumn("independent", F.col("domains") >= 2)
