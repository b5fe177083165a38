"""Queries of topics: mentions, implications, assignments, redirects and governance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.operators import topics
from storyloom.plans.registry import REPORTS, query
from storyloom.sources.tables import read, read_reports

# The registry: nations are topics of several types; those of number 3 in 5 only count beside a term, those of number 4 in 5 are rejected.
TYPES = ("location", "actor", "bilateral_relationship", "facility", "programme")


def registry(spark, sf_dir):
    n = F.col("n_nationkey")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (n % 5 + 1).cast("int"))
    return read(spark, sf_dir, "nation").select(
        F.concat(F.lit("t"), n.cast("string")).alias("topic"), F.replace(F.lower("n_name"), F.lit("_"), F.lit(" ")).alias("alias"), kind.alias("topic_type"), F.when(n % 5 == 3, F.array(F.lit("flight test"))).alias("terms"), (n % 5 == 4).alias("rejected"), "n_nationkey",
    )


def texts(spark, sf_dir):
    return read_reports(spark, sf_dir).select("id", "cluster", F.replace(F.concat_ws(". ", "title", "snippet"), F.lit("_"), F.lit(" ")).alias("text"))


# Mentions by SQL: where the alias begins, with no letter or digit around it, and what stands before and after.
MENTIONS = (
    f"{REPORTS}, x AS (SELECT id, cluster, replace(concat(title, '. ', snippet), '_', ' ') AS text, CAST(substr(nation, 8) AS INT) AS n, replace(lower(nation), '_', ' ') AS alias FROM reports), "
    "y AS (SELECT id, cluster, text, n, alias, strpos(lower(text), alias) AS p FROM x WHERE n % 5 <> 4 AND (n % 5 <> 3 OR contains(lower(text), 'flight test'))), "
    "z AS (SELECT *, substr(text, greatest(1, p - 70), p - greatest(1, p - 70)) AS before70, regexp_extract(substr(text, p, 85), '^([^.!?:]*)', 1) AS after85, lower(substr(text, greatest(1, p - 36), p - greatest(1, p - 36))) AS before36, lower(substr(text, p, 40)) AS after40 FROM y WHERE p > 0), "
    "m AS (SELECT id, cluster, text, concat('t', n) AS topic, p - 1 AS start, p - 1 + length(alias) AS \"end\", CASE n % 5 WHEN 0 THEN 'location' WHEN 3 THEN 'facility' ELSE CASE WHEN regexp_matches(before36, '(^|[^a-z0-9_])(in|at|from|near)\\s*$') THEN 'location' WHEN regexp_matches(before36, '(^|[^a-z0-9_])(attacks?|targeted|against|hits?)\\s*$') THEN 'target' "
    "WHEN regexp_matches(after40, '(^|[^a-z0-9_])(operat(es?|ing)|deploy(s|ed|ment)?|aircraft|personnel)([^a-z0-9_]|$)') THEN 'operator' WHEN n % 5 = 2 THEN 'context' ELSE 'actor' END END AS role "
    "FROM z WHERE NOT regexp_matches(concat(before70, after85), '(?i)(^|[^a-z0-9_])(histor(y|ical)|previously|former(ly)?|background)([^a-z0-9_]|$)'))"
)


@query("topic_mentions", f"WITH {MENTIONS} SELECT id, topic, role, 0.95::DOUBLE AS confidence, CAST(start AS INT) AS start, CAST(\"end\" AS INT) AS \"end\", 'exact' AS kind FROM m")
def topic_mentions(spark, sf_dir):
    """Mentions of nations in reports. The word ``former`` before a mention, context terms and rejected aliases leave some out."""
    return topics.mentions(texts(spark, sf_dir).select("id", "text"), registry(spark, sf_dir))


@query(
    "topic_implications",
    f"WITH {MENTIONS}, n AS (SELECT id, CAST(substr(topic, 2) AS INT) AS n, min(start) AS start FROM m GROUP BY 1, 2) SELECT DISTINCT id, concat('t', n + 100) AS topic, 'context' AS role, 0.9::DOUBLE AS confidence, CAST(start AS INT) AS start FROM n "
    "JOIN (SELECT id, text FROM x) USING (id) WHERE n % 2 = 0 AND (n % 4 <> 0 OR regexp_matches(lower(text), '(^|[^a-z0-9_])(military|army|air|navy|border|force|attack|personnel)([^a-z0-9_]|$)'))",
)
def topic_implications(spark, sf_dir):
    """Even nations imply a topic, every fourth one only in military reports."""
    n = F.col("n_nationkey")
    implied = F.concat(F.lit("t"), (n + 100).cast("string"))
    rules = registry(spark, sf_dir).where(n % 2 == 0).select(F.col("topic").alias("source"), implied.alias("implied"), F.array(F.col("topic")).alias("actors"), F.when(n % 4 == 0, F.array(F.lit("military"))).otherwise(F.array().cast("array<string>")).alias("events"))
    found = texts(spark, sf_dir).select("id", "text")
    return topics.implied(found, registry(spark, sf_dir), rules, "id").select("id", "topic", "role", "confidence", "start")


@query(
    "cluster_topics",
    f"WITH {MENTIONS} SELECT cluster, topic, arg_min(role, (id, start)) AS role, count(*) AS mentions FROM m GROUP BY 1, 2",
)
def cluster_topics(spark, sf_dir):
    """The best mention of each topic in a cluster: all are direct ones, so the first of the first report counts."""
    found = topics.mentions(texts(spark, sf_dir), registry(spark, sf_dir))
    best = topics.best_mentions(found, ["cluster", "id"])
    # one pass over the mentions: each report's are counted as its best one is found
    return best.groupBy("cluster", "topic").agg(F.min_by("role", F.struct("id", "start")).alias("role"), F.sum("mentions").alias("mentions"))


@query("topic_candidates", f"WITH {REPORTS} SELECT name, count(*) AS n, min(id) AS first_id FROM (SELECT id, unnest(regexp_extract_all(replace(title, 'NATION_', 'Nation'), '(^|[^A-Za-z0-9])((?:[A-Z][A-Za-z0-9''-]+\\s+){{1,4}}(?:Air Base|Base))', 2)) AS name FROM reports) GROUP BY 1".replace("{{", "{").replace("}}", "}"))
def topic_candidates(spark, sf_dir):
    """Names of bases that no registry knows yet."""
    reports = read_reports(spark, sf_dir).select("id", F.replace("title", F.lit("NATION_"), F.lit("Nation")).alias("title"))
    return topics.candidates(reports, "title").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    "topic_resolution",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN concat('t', o_orderkey % 25) WHEN o_orderkey % 4 IN (1, 2) THEN concat('t', o_orderkey % 25) END AS topic FROM orders",
)
def topic_resolution(spark, sf_dir):
    """Terms that are ids, hashtags, aliases or unknown."""
    known = registry(spark, sf_dir)
    n = (F.col("o_orderkey") % 25).cast("string")
    term = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("T"), n)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("#N"), n)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("Nation "), n)).otherwise("none")
    tags = known.select(F.col("topic").alias("id"), F.concat(F.lit("#n"), F.col("n_nationkey").cast("string")).alias("hashtag"))
    wanted = read(spark, sf_dir, "orders").select("o_orderkey", term.alias("term"))
    return topics.resolved(wanted, tags, known.select("topic", "alias")).select("o_orderkey", "topic")


@query(
    "published_topics",
    "SELECT o_orderkey, string_agg(concat(p_brand, ':', p_type), ',' ORDER BY concat(p_brand, ':', p_type)) AS topics FROM (SELECT DISTINCT l_orderkey AS o_orderkey, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 25) GROUP BY 1",
)
def published_topics(spark, sf_dir):
    """The published topics of each cluster in order."""
    part = read(spark, sf_dir, "part").where("p_size < 25")
    found = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws(":", "p_brand", "p_type").alias("t")).distinct()
    return found.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("topics"))


@query("related_topics", "SELECT a.n_nationkey AS topic, b.n_nationkey AS related, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_name, b.n_nationkey) AS position FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey QUALIFY position <= 50")
def related_topics(spark, sf_dir):
    """Up to 50 topics with the same parent for each topic; the limit is the feature."""
    nation = read(spark, sf_dir, "nation")
    a, b = nation.alias("a"), nation.alias("b")
    at = F.row_number().over(Window.partitionBy("topic").orderBy("name", "related"))
    found = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("topic"), F.col("b.n_nationkey").alias("related"), F.col("b.n_name").alias("name"))
    return found.withColumn("position", at.cast("long")).where("position <= 50").select("topic", "related", "position")


@query(
    "cluster_sources",
    f"WITH {REPORTS} SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN tier = 0 THEN 0 WHEN tier = 2 THEN 2 ELSE 1 END, published DESC, id) AS position FROM reports",
)
def cluster_sources(spark, sf_dir):
    """A cluster's sources, primary ones first and social ones last."""
    rank = F.when(F.col("tier") == 0, 0).when(F.col("tier") == 2, 2).otherwise(1)
    at = F.row_number().over(Window.partitionBy("cluster").orderBy(rank, F.col("published").desc(), "id"))
    return read_reports(spark, sf_dir).select("cluster", "id", at.cast("long").alias("position"))


@query(
    "topic_evidence",
    "SELECT l_orderkey, l_linenumber, o_orderstatus AS run_status, p_brand AS topic FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag NOT IN ('R', 'A') AND p_type <> 'PROMO'",
)
def topic_evidence(spark, sf_dir):
    """Evidence with its run and topic, without two states and one type."""
    lines = read(spark, sf_dir, "lineitem").where(~F.col("l_returnflag").isin("R", "A"))
    found = lines.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "part").where("p_type <> 'PROMO'"), F.col("l_partkey") == F.col("p_partkey"))
    return found.select("l_orderkey", "l_linenumber", F.col("o_orderstatus").alias("run_status"), F.col("p_brand").alias("topic"))


@query("affected_clusters", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3 UNION SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#3'")
def affected_clusters(spark, sf_dir):
    part = read(spark, sf_dir, "part").where("p_brand = 'Brand#3'")
    lines = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey")
    return read(spark, sf_dir, "orders").where("o_custkey % 10 = 3").select("o_orderkey").union(lines).distinct()


@query(
    "thread_topic_links",
    "SELECT DISTINCT o_custkey AS thread, p_brand AS topic FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey EXCEPT SELECT o_custkey, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'",
)
def thread_topic_links(spark, sf_dir):
    """Links of threads to the topics of their events, as far as they are not there yet."""
    found = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    links = found.select(F.col("o_custkey").alias("thread"), F.col("p_brand").alias("topic"), "l_returnflag")
    known = links.where("l_returnflag = 'R'").select("thread", "topic").distinct()
    return links.select("thread", "topic").distinct().join(known, ["thread", "topic"], "left_anti")


@query(
    "assignment_reuse",
    "SELECT o_orderkey, EXISTS (SELECT 1 FROM orders p WHERE p.o_orderdate < TIMESTAMP '1998-01-01' AND p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority AND p.o_orderstatus = o.o_orderstatus) AS reuse FROM orders o WHERE o_orderdate >= TIMESTAMP '1998-01-01'",
)
def assignment_reuse(spark, sf_dir):
    """Runs whose content, registry and policy a former run had are reused."""
    orders = read(spark, sf_dir, "orders")
    later = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    keys = ["o_custkey", "o_orderpriority", "o_orderstatus"]
    return topics.reusable(orders.where(later), orders.where(~later), keys).select("o_orderkey", "reuse")


ASSIGNED = (
    "a AS (SELECT l_orderkey AS cluster, p_brand AS topic, arg_max(l_linestatus, (l_discount, -l_linenumber, l_linestatus)) AS role, max(l_discount) AS confidence, bool_or(l_returnflag = 'R') AS locked FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 2 = 0 GROUP BY 1, 2), "
    "b AS (SELECT l_orderkey AS cluster, p_brand AS topic, arg_max(l_linestatus, (l_discount, -l_linenumber, l_linestatus)) AS role, max(l_discount) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 3 = 0 GROUP BY 1, 2)"
)


@query(
    "assignment_reconcile",
    f"WITH {ASSIGNED} SELECT cluster, topic, CASE WHEN a.locked THEN a.role ELSE b.role END AS role, CASE WHEN a.locked THEN a.confidence ELSE b.confidence END AS confidence, coalesce(a.locked, false) AS locked FROM a FULL JOIN b USING (cluster, topic) WHERE coalesce(a.locked, false) OR b.role IS NOT NULL",
)
def assignment_reconcile(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    best = F.max_by("l_linestatus", F.struct("l_discount", -F.col("l_linenumber"), "l_linestatus")).alias("role")

    def assigned(every: int):
        return lines.where(F.col("l_linenumber") % every == 0).groupBy(F.col("l_orderkey").alias("cluster"), F.col("p_brand").alias("topic")).agg(best, F.max("l_discount").alias("confidence"), F.bool_or(F.col("l_returnflag") == "R").alias("locked"))

    return topics.reconciled_assignments(assigned(2), assigned(3).drop("locked"), ["cluster", "topic"])


@query(
    "governance_claims",
    "WITH RECURSIVE v AS (SELECT n_nationkey AS topic, 1 AS version FROM nation), a AS (SELECT event_id AS id, user_id % 25 AS topic, 1 + event_id % 5 AS expected, ts AS pub FROM events), "
    "w AS (SELECT topic, version, (SELECT min((pub, id)) FROM a WHERE a.topic = v.topic AND a.expected = v.version) AS won FROM v UNION ALL SELECT topic, version + 1, (SELECT min((pub, id)) FROM a WHERE a.topic = w.topic AND a.expected = w.version + 1) FROM w WHERE won IS NOT NULL AND version < 10), "
    "g AS (SELECT *, won < max(won) OVER (PARTITION BY topic ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM w WHERE won IS NOT NULL), "
    "k AS (SELECT *, bool_or(coalesce(late, false)) OVER (PARTITION BY topic ORDER BY version) AS bad FROM g) SELECT a.id, a.topic, a.expected, EXISTS (SELECT 1 FROM k WHERE NOT bad AND won[2] = a.id) AS accepted FROM a",
)
def governance_claims(spark, sf_dir):
    """Actions on topics with the version that they expect; the first of each version is accepted."""
    versions = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("topic"), F.lit(1).alias("version"))
    actions = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 25).cast("int").alias("topic"), (F.col("event_id") % 5 + 1).alias("expected"), F.col("ts").alias("at"))
    return topics.claimed(versions, actions).select("id", "topic", "expected", "accepted")
