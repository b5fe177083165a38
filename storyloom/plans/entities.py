"""Queries of entities, suppliers, programmes, the graph's nodes and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import cleaning, scoring, text
from storyloom.operators import entities, folds, graph, rows
from storyloom.plans.registry import EDGES, REPORTS, bounded, query, r4
from storyloom.sources.tables import articles, edges, read, read_reports

DICTIONARY = (("Trials", "trials?"), ("Contract", "contract|orders"), ("Base", "air\\s+base"), ("Widget", "widgets?"))


@query("dictionary_tags", f"WITH {REPORTS} SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(title, '{bounded(p)}') THEN '{n}' END" for n, p in DICTIONARY) + ") AS entities FROM reports")
def dictionary_tags(spark, sf_dir):
    return entities.tagged(read_reports(spark, sf_dir), "title", list(DICTIONARY)).select("id", F.array_join("entities", ",").alias("entities"))


@query("program_mentions", f"WITH {REPORTS} SELECT DISTINCT id, part AS name FROM reports")
def program_mentions(spark, sf_dir):
    """Reports and the parts that they name: all names of the dictionary against all titles."""
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return entities.mentions_of_names(read_reports(spark, sf_dir), "id", "title", names)


@query("supplier_mentions", f"WITH {REPORTS} SELECT lower(replace(supplier, '#', '-')) AS slug, count(DISTINCT id) AS stories, min(id) AS first_id FROM reports GROUP BY 1")
def supplier_mentions(spark, sf_dir):
    """The stories of each supplier, by an inverted list."""
    names = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    found = entities.inverted(entities.mentions_of_names(read_reports(spark, sf_dir), "id", "snippet", names), "id")
    return found.select("slug", F.size("items").cast("long").alias("stories"), F.col("items")[0].alias("first_id"))


@query(
    "entity_candidates",
    f"WITH {REPORTS} SELECT replace(part, ' ', '-') AS slug, count(*) AS mentions, count(DISTINCT domain) AS sources, min(published) AS first_seen, max(published) AS last_seen, "
    "coalesce(arg_min(CASE WHEN tier = 0 THEN 'air' ELSE 'sea' END, (published, CASE WHEN tier = 0 THEN 'air' ELSE 'sea' END)) FILTER (tier < 2), 'tech') AS category, coalesce(bool_or(part LIKE 'red%'), false) OR (count(*) >= 3 AND count(DISTINCT domain) >= 2) AS promoted FROM reports GROUP BY 1",
)
def entity_candidates(spark, sf_dir):
    found = read_reports(spark, sf_dir).select(
        cleaning.slug(F.col("part")).alias("slug"), F.col("part").alias("name"), F.when(F.col("tier") == 0, "air").when(F.col("tier") == 1, "sea").otherwise("tech").alias("category"), "domain", F.col("published").alias("seen"), F.col("part").startswith("red").alias("promoted"),
    )
    return entities.candidate_entities(found)


@query(
    "supplier_candidates",
    f"WITH {REPORTS}, n AS (SELECT supplier, program, count(*) AS m, count(DISTINCT domain) AS s, min(published) AS first_seen FROM reports WHERE tier <> 4 GROUP BY 1, 2), o AS (SELECT supplier, program, count(*) AS m FROM reports WHERE tier = 1 GROUP BY 1, 2) "
    "SELECT supplier, program, CASE WHEN coalesce(o.m % 3 = 0, false) THEN o.m ELSE n.m + coalesce(o.m, 0) END AS mentions, CASE WHEN coalesce(o.m % 3 = 0, false) THEN 'approved' ELSE 'pending' END AS status, "
    "CASE WHEN coalesce(o.m % 3 = 0, false) THEN 0.5 ELSE floor(least(1.0::DOUBLE, 0.3::DOUBLE + 0.15::DOUBLE * (n.m + coalesce(o.m, 0)) + 0.1::DOUBLE * s) * 10000.0 + 0.5) / 10000.0 END AS confidence FROM n FULL JOIN o USING (supplier, program)",
)
def supplier_candidates(spark, sf_dir):
    """New sightings are added to candidates; reviewed ones stay as they are."""
    reports = read_reports(spark, sf_dir)
    new = reports.where("tier <> 4").groupBy("supplier", "program").agg(F.count("*").alias("m"), F.countDistinct("domain").alias("s"))
    old = reports.where("tier = 1").groupBy("supplier", "program").agg(F.count("*").alias("old"))
    both = new.join(old, ["supplier", "program"], "full_outer")
    reviewed = F.coalesce(F.col("old") % 3 == 0, F.lit(False))
    mentions = F.col("m") + F.coalesce("old", F.lit(0))
    return both.select(
        "supplier", "program", F.when(reviewed, F.col("old")).otherwise(mentions).alias("mentions"), F.when(reviewed, "approved").otherwise("pending").alias("status"), F.when(reviewed, 0.5).otherwise(scoring.link_confidence(mentions, F.col("s"))).alias("confidence"),
    )


@query(
    "entity_salience",
    "SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.57 WHEN 2 THEN 0.34 ELSE 0.0 END AS DOUBLE) AS salience FROM orders",
)
def entity_salience(spark, sf_dir):
    """Texts with a name everywhere, in the headline, in the lead, beside no anchor, and not at all."""
    k = F.col("o_orderkey") % 5
    head = F.when(k == 0, "HAL wins order").when(k == 1, "Big order for HAL").when(k == 3, "HAL wins").otherwise("An order")
    body = F.when(k == 0, "HAL builds aircraft. HAL is big.").when(k == 1, "The firm builds aircraft. Some say HAL.").when(k == 2, "An aircraft of HAL flies. It is new.").when(k == 3, "HAL is a name.").otherwise("Some aircraft.")
    return read(spark, sf_dir, "orders").select("o_orderkey", entities.salience(head, body, F.lit("HAL")).alias("salience"))


FACTS = (
    f"{REPORTS}, f AS (SELECT *, concat(title, ' ', snippet) AS body, id % 8 AS line FROM reports), g AS (SELECT *, CASE WHEN line % 4 = 2 THEN CAST(nullif(regexp_extract(title, 'Rs (\\d+) crore', 1), '') AS DOUBLE) END AS budget, "
    "CASE WHEN line % 4 = 0 THEN concat(regexp_extract(title, 'orders (\\d+) units', 1), ' units') END AS quantity, nullif(regexp_extract(snippet, 'Delivery by (202[5-9]|203[0-9]|2040)', 1), '') AS timeline, "
    "TRY_CAST(regexp_extract(snippet, '(\\d+)% indigenous', 1) AS INT) AS share, CASE WHEN line % 4 = 2 THEN 'induction' WHEN line % 4 IN (1, 3) THEN 'trials' ELSE 'production' END AS status FROM f)"
)


@query(
    "report_metrics",
    f"WITH {FACTS} SELECT id, budget, quantity, timeline, share, floor(least(1.0, 0.15::DOUBLE + (tier = 0)::INT * 0.25::DOUBLE + (budget IS NOT NULL)::INT * 0.25::DOUBLE + (quantity IS NOT NULL OR timeline IS NOT NULL)::INT * 0.2::DOUBLE + 0.15::DOUBLE + (tier = 3)::INT * 0.1::DOUBLE) * 100 + 0.5) / 100 AS confidence, coalesce(budget > 25000, false) AS high_value FROM g",
)
def report_metrics(spark, sf_dir):
    facts = entities.metrics(F.concat_ws(" ", "title", "snippet"))
    found = read_reports(spark, sf_dir).withColumns(facts)
    confidence = entities.mining_confidence(F.col("tier") == 0, F.col("budget"), F.col("quantity"), F.col("timeline"), F.contains(F.lower("title"), F.lower("part")), F.col("tier") == 3)
    return found.select("id", *facts, confidence.alias("confidence"), F.coalesce(F.col("budget") > 25000, F.lit(False)).alias("high_value"))


@query("report_milestones", f"WITH {FACTS} SELECT id, part AS entity, status, budget, nullif(trim(regexp_extract(body, '{entities.MILESTONE_TIME}', 1)), '') AS timeline, share, tier = 0 AS official FROM g")
def report_milestones(spark, sf_dir):
    return milestones(spark, sf_dir).select("id", "entity", "status", "budget", "timeline", "share", "official")


def milestones(spark, sf_dir):
    body = F.concat_ws(" ", "title", "snippet")
    found = read_reports(spark, sf_dir).withColumns(entities.milestone_facts(body))
    day = F.datediff("published", F.lit("1970-01-01").cast("date"))
    return found.select(
        "id", F.col("part").alias("entity"), "nation", day.alias("day"), "title", F.when(F.col("id") % 3 == 0, F.concat(F.lit("u"), (F.col("id") % 500).cast("string"))).otherwise("").alias("url"), (F.col("tier") == 0).alias("official"), "tier",
        "budget", "timeline", F.col("share").cast("double").alias("share_d"), "share", entities.milestone_status(body).alias("status"),
    )


@query("milestone_dedupe")
def milestone_dedupe(spark, sf_dir):
    """Milestones of each part in each nation, repeats merged. The fold has no SQL; tests hold it against a plain version."""
    found = milestones(spark, sf_dir).withColumn("key", F.concat_ws("|", "entity", "nation")).drop("share").withColumnRenamed("share_d", "share")
    return folds.milestones_merged(found, "key")


LABELS = "CASE p_partkey % 7 WHEN 0 THEN concat(p_name, ' radar') WHEN 1 THEN concat('Fort ', p_name) WHEN 2 THEN concat(p_name, ' valley') WHEN 3 THEN concat('attack of ', p_name) WHEN 4 THEN concat(p_name, ' navy') WHEN 5 THEN concat('mission ', p_name) ELSE p_name END"
CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{p}') THEN '{c}'" for c, p in entities.CATEGORIES) + " ELSE 'platform' END"


def labels(spark, sf_dir):
    k = F.col("p_partkey") % 7
    name = F.col("p_name")
    label = (
        F.when(k == 0, F.concat(name, F.lit(" radar"))).when(k == 1, F.concat(F.lit("Fort "), name)).when(k == 2, F.concat(name, F.lit(" valley"))).when(k == 3, F.concat(F.lit("attack of "), name))
        .when(k == 4, F.concat(name, F.lit(" navy"))).when(k == 5, F.concat(F.lit("mission "), name)).otherwise(name)
    )
    return read(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


@query("node_categories", f"SELECT p_partkey, concat('node_', replace(lower({LABELS}), ' ', '-')) AS node, {CATEGORY.format(LABELS)} AS category FROM part")
def node_categories(spark, sf_dir):
    return labels(spark, sf_dir).select("p_partkey", cleaning.node_id(F.col("label")).alias("node"), entities.node_category(F.col("label")).alias("category"))


WORD_TESTS = {k: f"regexp_matches(body, '{bounded(p)}')" for k, p in (("d", entities.DEPLOYS), ("t", entities.TESTS), ("c", entities.COUNTERS), ("b", entities.BUYS))}


@query(
    "edge_predicates",
    f"WITH l AS (SELECT p_partkey, {LABELS} AS label FROM part), n AS (SELECT p_partkey, label, {CATEGORY.format('label')} AS cat FROM l), p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.cat AS x, b.cat AS y, CASE a.p_partkey % 5 WHEN 0 THEN 'it is stationed there' WHEN 1 THEN 'sea trials begin' WHEN 2 THEN 'it tracks them' WHEN 3 THEN 'a deal' ELSE 'nothing' END AS body FROM n a JOIN n b ON b.p_partkey BETWEEN a.p_partkey + 1 AND a.p_partkey + 6) "
    f"SELECT a, b, CASE WHEN {WORD_TESTS['d']} AND x = 'platform' AND y IN ('location', 'facility') THEN 'DEPLOYED_TO' WHEN {WORD_TESTS['d']} AND y = 'platform' AND x IN ('location', 'facility') THEN '<DEPLOYED_TO' "
    f"WHEN {WORD_TESTS['t']} AND x = 'platform' AND y IN ('location', 'facility') THEN 'TESTED_AT' WHEN {WORD_TESTS['t']} AND y = 'platform' AND x IN ('location', 'facility') THEN '<TESTED_AT' "
    f"WHEN {WORD_TESTS['c']} AND x = 'platform' AND y = 'threat' THEN 'TARGETS' WHEN {WORD_TESTS['c']} AND y = 'platform' AND x = 'threat' THEN '<TARGETS' WHEN {WORD_TESTS['b']} AND x = 'organization' AND y = 'platform' THEN 'PROCURES' WHEN {WORD_TESTS['b']} AND y = 'organization' AND x = 'platform' THEN '<PROCURES' "
    "WHEN y = 'platform' AND x = 'program' THEN '<CONNECTED_TO' WHEN x <> y OR x = 'platform' THEN 'CONNECTED_TO' END AS predicate FROM p",
)
def edge_predicates(spark, sf_dir):
    """Relations between each part and the six after it."""
    nodes = labels(spark, sf_dir).select("p_partkey", entities.node_category(F.col("label")).alias("category"))
    k = F.col("a") % 5
    body = F.when(k == 0, "it is stationed there").when(k == 1, "sea trials begin").when(k == 2, "it tracks them").when(k == 3, "a deal").otherwise("nothing")
    a = nodes.select(F.col("p_partkey").alias("a"), F.col("category").alias("x"), F.explode(F.sequence(F.col("p_partkey") + 1, F.col("p_partkey") + 6)).alias("b"))
    pairs = a.join(nodes.toDF("b", "y"), "b")
    return pairs.select("a", "b", entities.relation(entities.told_of(body), F.col("x"), F.col("y")).alias("predicate"))


@query(
    "pattern_candidates",
    f"WITH {REPORTS}, s AS (SELECT nation AS place, motif, cluster, domain, published AS pub FROM (SELECT *, part AS motif FROM reports UNION ALL SELECT *, 'CONVERGENCE' FROM reports)), "
    "w AS (SELECT a.place, a.motif, a.pub, count(DISTINCT b.cluster) AS n FROM (SELECT DISTINCT place, motif, pub FROM s) a JOIN s b ON a.place = b.place AND a.motif = b.motif AND b.pub BETWEEN a.pub AND a.pub + INTERVAL 72 HOUR GROUP BY 1, 2, 3 HAVING count(DISTINCT b.cluster) >= 3), "
    "f AS (SELECT place, motif, min(pub) AS start_at FROM w GROUP BY 1, 2), g AS (SELECT s.place, s.motif, start_at, count(DISTINCT cluster) AS clusters, count(DISTINCT domain) AS domains FROM s JOIN f ON s.place = f.place AND s.motif = f.motif AND s.pub BETWEEN start_at AND start_at + INTERVAL 72 HOUR GROUP BY 1, 2, 3) "
    "SELECT *, floor(least(0.95::DOUBLE, 0.55::DOUBLE + least(0.25::DOUBLE, (clusters - 2) * 0.08::DOUBLE) + CASE WHEN domains >= 2 THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END) * 100 + 0.5) / 100 AS confidence, CASE WHEN motif = 'CONVERGENCE' THEN concat(place, ' Tactical & Strategic Convergence') ELSE concat_ws(' ', place, motif, 'Convergence') END AS title FROM g",
)
def pattern_candidates(spark, sf_dir):
    found = read_reports(spark, sf_dir).select("cluster", F.col("nation").alias("place"), F.col("part").alias("motif"), "domain", F.col("published").alias("ts"))
    return entities.patterns(found)


@query(
    "thread_matches",
    f"WITH {REPORTS}, c AS (SELECT DISTINCT id AS cluster, part AS entity FROM reports), t AS (SELECT p_name AS thread, p_name AS entity FROM part WHERE p_size < 10 GROUP BY 1), e AS (SELECT DISTINCT entity FROM c), "
    "w AS (SELECT entity, string_split(entity, ' ') AS x FROM e), p AS (SELECT a.entity, t.thread, CASE WHEN a.entity = t.entity THEN 1.0 WHEN len(list_intersect(a.x, string_split(t.entity, ' '))) / (len(a.x) + 2 - len(list_intersect(a.x, string_split(t.entity, ' ')))) >= 0.5 THEN 0.9 ELSE 0.0 END AS score FROM w a, t) "
    "SELECT cluster, thread, max(score)::DOUBLE AS score, row_number() OVER (PARTITION BY cluster ORDER BY max(score) DESC, thread) AS branch FROM c JOIN p USING (entity) WHERE score >= 0.35 GROUP BY 1, 2",
)
def thread_matches(spark, sf_dir):
    """Reports and the threads of parts that they go on."""
    words = F.split("entity", " ")
    clusters = read_reports(spark, sf_dir).select(F.col("id").alias("cluster"), F.col("part").alias("entity")).withColumn("words", words).withColumn("tokens", F.array(F.col("entity")))
    threads = read(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_name").alias("thread"), F.col("p_name").alias("entity")).distinct().withColumn("words", words).withColumn("tokens", F.array(F.lit("-")))
    return entities.matched_threads(clusters, threads)


@query("thread_titles", "SELECT p_partkey, concat(upper(p_name[1]), substr(split_part(p_name, ' ', 1), 2), ' ', upper(split_part(p_name, ' ', 2)[1]), substr(split_part(p_name, ' ', 2), 2), ' ', CASE p_type WHEN 'PROMO' THEN 'Acquisition & Delivery Arc' WHEN 'SMALL' THEN 'Operational & Strategic Arc' WHEN 'LARGE' THEN 'Technology & Systems Arc' ELSE 'Intelligence & Strategic Arc' END) AS title FROM part")
def thread_titles(spark, sf_dir):
    category = F.when(F.col("p_type") == "PROMO", "tenders").when(F.col("p_type") == "SMALL", "navy").when(F.col("p_type") == "LARGE", "space").otherwise("other")
    # What kind of arc a thread of a category is.
    arc = F.when(category.isin("procurement", "tenders"), "Acquisition & Delivery Arc").when(category.isin("airforce", "army", "navy", "strategic"), "Operational & Strategic Arc").when(category.isin("tech", "space"), "Technology & Systems Arc")
    return read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", cleaning.clean_tag(F.col("p_name")), F.coalesce(arc, F.lit("Intelligence & Strategic Arc"))).alias("title"))


# --- suppliers, programmes and sources


@query("program_filter", "SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'LARGE') AND p_size <= 30 AND (p_brand = 'Brand#3' OR p_brand LIKE '%1%') AND p_retailprice >= 950 AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ri')")
def program_filter(spark, sf_dir):
    """Programmes of two domains up to a stage, of a branch or a joint one, from a share on, with a text in one of their fields."""
    found = rows.matching(read(spark, sf_dir, "part"), p_type=["SMALL", "LARGE"], p_mfgr=None)
    return found.where((F.col("p_size") <= 30) & ((F.col("p_brand") == "Brand#3") | F.contains("p_brand", F.lit("1"))) & (F.col("p_retailprice") >= 950) & F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("ri"))).select("p_partkey")


@query(
    "supplier_filter",
    "SELECT s_suppkey FROM supplier SEMI JOIN (SELECT l_suppkey AS s_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('PROMO', 'SMALL') GROUP BY 1) x USING (s_suppkey) SEMI JOIN (SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem WHERE l_tax > 0.07) y USING (s_suppkey) WHERE s_nationkey % 5 < 3 AND s_acctbal > 0 AND contains(lower(s_name), '1')",
)
def supplier_filter(spark, sf_dir):
    """Suppliers of a tier and corridor with any of some capabilities, any certificate and a text in their name."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey", "l_tax")
    able = lines.join(read(spark, sf_dir, "part").where(F.col("p_type").isin("PROMO", "SMALL")), F.col("l_partkey") == F.col("p_partkey")).select("s_suppkey")
    found = read(spark, sf_dir, "supplier").where((F.col("s_nationkey") % 5 < 3) & (F.col("s_acctbal") > 0) & F.contains(F.lower("s_name"), F.lit("1")))
    return found.join(able, "s_suppkey", "left_semi").join(lines.where("l_tax > 0.07").select("s_suppkey"), "s_suppkey", "left_semi").select("s_suppkey")


@query(
    "feed_search",
    f"WITH {REPORTS} SELECT cluster FROM reports GROUP BY cluster HAVING NOT bool_or(tier = 4) AND bool_or(program = 'Brand#3') AND bool_or(contains(lower(concat_ws(' ', title, snippet, supplier)), 'widget'))",
)
def feed_search(spark, sf_dir):
    """Clusters that are not ignored, of a category, with a text in a field of one of their nested sources."""
    item = F.struct("title", "snippet", "supplier", "tier", "program")
    found = read_reports(spark, sf_dir).groupBy("cluster").agg(F.collect_list(item).alias("items"))
    hit = F.exists("items", lambda i: F.contains(F.lower(F.concat_ws(" ", i["title"], i["snippet"], i["supplier"])), F.lit("widget")))
    return found.where(~F.exists("items", lambda i: i["tier"] == 4) & F.exists("items", lambda i: i["program"] == "Brand#3") & hit).select("cluster")


@query("domestic_sources", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS domestic FROM orders")
def domestic_sources(spark, sf_dir):
    """Sources by domain, by its ending, by their name, or unknown."""
    k = F.col("o_orderkey") % 6
    domain = F.when(k == 0, "example.in").when(k == 1, "news.example.in").when(k == 3, "example.com").when(k == 4, "example.in.net")
    name = F.when(k == 2, "Wire of India").when(k == 4, "Wire").when(k == 3, "Global Wire")
    of_name = F.coalesce(F.lower(name).contains("india"), F.lit(False))
    known = F.when(domain.isNull() & name.isNull(), True).when(of_name, True).otherwise(F.coalesce((domain == "example.in") | domain.endswith(".in"), F.lit(False)))
    return read(spark, sf_dir, "orders").select("o_orderkey", known.alias("domestic"))


@query("program_suppliers", "SELECT p_brand, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers, count(DISTINCT l_suppkey) AS n, count(DISTINCT p_partkey) FILTER (p_size > 25) AS planned, count(DISTINCT p_partkey) AS units FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def program_suppliers(spark, sf_dir):
    """The reverse index from programmes to suppliers, with units and planned ones."""
    found = read(spark, sf_dir, "part").join(read(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return found.groupBy("p_brand").agg(
        F.nullif(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ","), F.lit("")).alias("suppliers"), F.countDistinct("l_suppkey").alias("n"),
        F.countDistinct(F.when(F.col("p_size") > 25, F.col("p_partkey"))).alias("planned"), F.countDistinct("p_partkey").alias("units"),
    )


@query("program_coverage", "SELECT (SELECT count(DISTINCT p_brand) FROM part) AS programs, (SELECT count(DISTINCT p_brand) FROM part JOIN lineitem ON l_partkey = p_partkey) AS linked, (SELECT count(*) FROM supplier ANTI JOIN lineitem ON l_suppkey = s_suppkey) AS idle_suppliers")
def program_coverage(spark, sf_dir):
    part, lines = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    every = part.agg(F.countDistinct("p_brand").alias("programs"))
    linked = part.join(lines, F.col("l_partkey") == F.col("p_partkey"), "left_semi").agg(F.countDistinct("p_brand").alias("linked"))
    idle = read(spark, sf_dir, "supplier").join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").agg(F.count("*").alias("idle_suppliers"))
    return every.join(linked, F.lit(True)).join(idle, F.lit(True))


@query(
    "graph_node_details",
    f"WITH {EDGES}, i AS (SELECT src, dst, weight, CASE WHEN src = 's3' THEN dst ELSE src END AS other FROM edges WHERE src = 's3' OR dst = 's3') SELECT other, weight, (SELECT count(*) FROM edges e WHERE e.src = other OR e.dst = other) AS degree FROM i",
)
def graph_node_details(spark, sf_dir):
    """The neighbours of a node with the weight of their edge and their degree."""
    seen = edges(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"))
    own = graph.build(graph.hop(seen, spark.createDataFrame([("s3",)], "node string")))
    others = own.select(F.when(F.col("src") == "s3", F.col("dst")).otherwise(F.col("src")).alias("other"), "weight")
    degrees = graph.degrees(graph.build(graph.hop(seen, others.select(F.col("other").alias("node")))))
    return others.join(degrees.select(F.col("node").alias("other"), "degree"), "other").select("other", "weight", "degree")


@query("graph_hop_limited", f"WITH {EDGES} SELECT src, dst, weight FROM edges WHERE src = 's1' OR dst = 's1' ORDER BY weight DESC, src, dst LIMIT 100")
def graph_hop_limited(spark, sf_dir):
    """The first hop with the limit of a page of the graph, which is its feature."""
    seen = edges(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"))
    near = graph.build(graph.hop(seen, spark.createDataFrame([("s1",)], "node string")))
    return graph.neighbourhood(near, spark.createDataFrame([("s1",)], "node string"), hops=1, limit=100).select("src", "dst", "weight")


@query(
    "acronym_anchors",
    "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 1 END AS found, o_orderkey % 6 IN (0, 2, 4) AS valid FROM orders",
)
def acronym_anchors(spark, sf_dir):
    """An ambiguous acronym beside an anchor, without one, spelt out, inside another word; a compound and a plain name."""
    k = F.col("o_orderkey") % 6
    name = F.when(k == 4, "INSVikrant").otherwise("LAC")
    body = F.when(k == 0, "Talks on the LAC with China").when(k == 1, "The LAC is long").when(k == 2, "Line of Actual Control: the lac").when(k == 3, "A PLACE at the border").when(k == 4, "The INS Vikrant sails").otherwise("lac of it")
    return read(spark, sf_dir, "orders").select("o_orderkey", cleaning.occurrences(body, name).cast("int").alias("found"), cleaning.anchored(body, name).alias("valid"))
