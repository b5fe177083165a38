"""Queries of durable ingestion and of upserts: the version before is one part of the orders, what is new another."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import ingest, merge, stories
from storyloom.plans.registry import REPORTS, query
from storyloom.sources.tables import read, read_reports

CUT = "TIMESTAMP '1998-01-01'"


def halves(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    later = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return orders.where(~later), orders.where(later)


@query(
    "article_identity",
    "SELECT page_id, concat('article_', substr(sha256(coalesce(u, concat_ws('|', 'owner', '2024-01-01', lower(trim(substr(html, 1, 40))), 'h'))), 1, 32)) AS article_id FROM ({URLS}) ".replace(
        "{URLS}",
        "WITH p AS (SELECT page_id, html, regexp_replace(trim(CASE WHEN page_id % 5 = 0 THEN '' ELSE url END), '#.*$', '') AS u FROM pages), q AS (SELECT page_id, html, u, lower(regexp_replace(regexp_extract(u, '^([A-Za-z]+://[^/?]*)', 1), ':(80|443)$', '')) AS head, "
        "regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/{2,}', '/', 'g'), '/$', '') AS path, "
        "list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src', 'source', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))) AS kept FROM p) "
        "SELECT page_id, html, CASE WHEN regexp_matches(lower(u), '^https?://') THEN concat(head, CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN len(kept) > 0 THEN concat('?', array_to_string(kept, '&')) ELSE '' END) END AS u FROM q",
    ),
)
def article_identity(spark, sf_dir):
    """Ids of pages by their canonical address; every fifth page has none and is known by its facts."""
    url = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url"))
    found = ingest.article_id(url, F.lit("owner"), F.lit("2024-01-01"), F.substring("html", 1, 40), F.lit("h"))
    return read(spark, sf_dir, "pages").select("page_id", found.alias("article_id"))


@query(
    "event_fingerprints",
    f"WITH {REPORTS} SELECT id, sha256(concat_ws('|', 'event-v1', strftime(published, '%Y-%m-%d'), array_to_string(list_sort([lower(nation), lower(part)]), '|'), "
    "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(title, '(?i)(^|[^A-Za-z0-9_])({p})([^A-Za-z0-9_]|$)') THEN '{n}' END" for n, p in stories.ACTIONS) + "], lambda a: a IS NOT NULL)), '|'), "
    "array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(trim(title)), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2))[1:12], '|'))) AS fingerprint FROM reports",
)
def event_fingerprints(spark, sf_dir):
    """Every report's title tells of an action, so no part of the digest is empty."""
    day = F.date_format("published", "yyyy-MM-dd")
    return read_reports(spark, sf_dir).select("id", ingest.event_fingerprint(day, F.array("nation", "part"), stories.actions(F.col("title")), F.col("title")).alias("fingerprint"))


@query("input_fingerprint")
def input_fingerprint(spark, sf_dir):
    """A run's id from all its articles; tests hold it against a plain version."""
    articles = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.sha2("text", 256).alias("content_hash"))
    return ingest.input_fingerprint(articles)


@query("archive_insert_ignore", f"SELECT o_custkey, min(o_orderkey) FILTER (o_orderdate < {CUT}) AS old_key, CASE WHEN min(o_orderkey) FILTER (o_orderdate < {CUT}) IS NULL THEN min(o_orderkey) ELSE min(o_orderkey) FILTER (o_orderdate < {CUT}) END AS o_orderkey FROM orders GROUP BY 1")
def archive_insert_ignore(spark, sf_dir):
    old, new = halves(spark, sf_dir)
    table = old.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    found = ingest.inserted_new(table, new.select("o_custkey", "o_orderkey"), ["o_custkey"])
    return found.join(table.select("o_custkey", F.col("o_orderkey").alias("old_key")), "o_custkey", "left").select("o_custkey", "old_key", "o_orderkey")


@query(
    "pattern_review",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND l.verdict IS NOT NULL THEN l.verdict ELSE o_orderstatus END AS status, o_orderstatus = 'O' AND l.verdict IS NOT NULL AS reviewed FROM orders LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS verdict FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) l ON l_orderkey = o_orderkey",
)
def pattern_review(spark, sf_dir):
    """Verdicts apply to drafts only."""
    verdicts = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("verdict"))
    found = read(spark, sf_dir, "orders").join(verdicts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    applies = (F.col("o_orderstatus") == "O") & F.col("verdict").isNotNull()
    return found.select("o_orderkey", F.when(applies, F.col("verdict")).otherwise(F.col("o_orderstatus")).alias("status"), applies.alias("reviewed"))


SIDES = f"a AS (SELECT o_custkey, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, max(o_orderpriority) AS title, count(*) AS n FROM orders WHERE o_orderdate < {CUT} GROUP BY 1), b AS (SELECT o_custkey, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, max(o_orderpriority) AS title, count(*) AS n FROM orders WHERE o_orderdate >= {CUT} GROUP BY 1)"


def sides(spark, sf_dir):
    facts = [F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.max("o_orderpriority").alias("title"), F.count("*").alias("n")]
    return [df.groupBy("o_custkey").agg(*facts) for df in halves(spark, sf_dir)]


@query("article_upserts", f"WITH {SIDES} SELECT o_custkey, coalesce(a.first_at, b.first_at) AS first_at, greatest(a.last_at, b.last_at) AS last_at, coalesce(b.title, a.title) AS title, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM a FULL JOIN b USING (o_custkey)")
def article_upserts(spark, sf_dir):
    """First times stay, titles are replaced, last times grow and counts add up."""
    old, new = sides(spark, sf_dir)
    return ingest.upserted(old, new, ["o_custkey"], {"first_at": merge.keep, "last_at": merge.largest, "title": merge.replace, "n": merge.add})


@query("edge_upserts", f"WITH {SIDES} SELECT o_custkey, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, coalesce(b.title, a.title) AS title, greatest(a.last_at, b.last_at) AS last_at, coalesce(a.first_at, b.first_at) AS first_at FROM a FULL JOIN b USING (o_custkey)")
def edge_upserts(spark, sf_dir):
    """Weights add up, the state is replaced, the last time grows, the first snippet stays."""
    old, new = sides(spark, sf_dir)
    return ingest.upserted(old, new, ["o_custkey"], {"n": merge.add, "title": merge.replace, "last_at": merge.largest, "first_at": merge.keep})


@query(
    "primary_demotion",
    f"WITH {REPORTS}, s AS (SELECT DISTINCT cluster, id FROM reports), o AS (SELECT cluster, min(id) AS was, max(id) AS now FROM s GROUP BY 1) SELECT cluster, id AS article, CASE WHEN cluster % 3 <> 0 THEN CASE WHEN id = was THEN 'primary' ELSE 'related' END WHEN id = now THEN 'primary' ELSE 'related' END AS coverage FROM s JOIN o USING (cluster)",
)
def primary_demotion(spark, sf_dir):
    """Every third cluster gets its last source as the primary one."""
    sources = read_reports(spark, sf_dir).select("cluster", F.col("id").alias("article")).distinct()
    first = sources.groupBy("cluster").agg(F.min("article").alias("was"), F.max("article").alias("now"))
    current = sources.join(first, "cluster").select("cluster", "article", F.when(F.col("article") == F.col("was"), "primary").otherwise("related").alias("coverage"))
    new = first.where("cluster % 3 = 0").select("cluster", F.col("now").alias("article"))
    return ingest.demoted(current, new)


@query(
    "lineage_locks",
    "WITH a AS (SELECT DISTINCT o_custkey AS cluster, o_orderpriority AS topic, 'actor' AS role FROM orders), t AS (SELECT *, cluster % 4 = 0 AS locked FROM a), c AS (SELECT DISTINCT cluster + 1 AS cluster, topic, role FROM t WHERE locked) "
    "SELECT cluster, topic, role, locked FROM t ANTI JOIN c USING (cluster, topic) UNION ALL SELECT cluster, topic, role, true FROM c",
)
def lineage_locks(spark, sf_dir):
    """Every fourth cluster is locked and followed by the next number."""
    table = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("topic"), F.lit("actor").alias("role")).distinct().withColumn("locked", F.col("cluster") % 4 == 0)
    lineage = table.where("locked").select(F.col("cluster").alias("predecessor"), (F.col("cluster") + 1).alias("successor")).distinct()
    return ingest.locks_to_successors(table, lineage)


@query(
    "run_ledger",
    "WITH RECURSIVE e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'signup' THEN 'resume' ELSE 'advance' END AS kind FROM events), "
    "r AS (SELECT DISTINCT user_id AS run, 0::BIGINT AS k, 'started' AS status, 0::BIGINT AS retries, NULL::VARCHAR AS failed_at FROM events UNION ALL "
    "SELECT r.run, e.k, CASE WHEN kind = 'advance' THEN CASE status WHEN 'started' THEN 'articles_persisted' WHEN 'articles_persisted' THEN 'clusters_persisted' WHEN 'clusters_persisted' THEN 'classified' WHEN 'classified' THEN 'publishable' WHEN 'publishable' THEN 'published' ELSE status END "
    "WHEN kind = 'fail' AND status NOT IN ('published', 'failed_retryable') THEN 'failed_retryable' WHEN kind = 'resume' AND status = 'failed_retryable' THEN 'started' ELSE status END, retries + (kind = 'resume' AND status = 'failed_retryable')::INT, "
    "CASE WHEN kind = 'fail' AND status NOT IN ('published', 'failed_retryable') THEN status WHEN kind = 'advance' AND status NOT IN ('published', 'failed_retryable') THEN NULL WHEN kind = 'resume' AND status = 'failed_retryable' THEN NULL ELSE failed_at END FROM r JOIN e ON e.run = r.run AND e.k = r.k + 1) "
    "SELECT run, arg_max(status, k) AS status, max(retries) AS retries, max(failed_at) FILTER (k = m) AS failed_at FROM (SELECT *, max(k) OVER (PARTITION BY run) AS m FROM r) GROUP BY run",
)
def run_ledger(spark, sf_dir):
    """Each user's events drive a run: errors fail it, signups resume it, others advance it."""
    events = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "resume").otherwise("advance")
    steps = ingest.numbered(events.select(F.col("user_id").alias("run"), "ts", "event_id", kind.alias("kind")), ["run"], ["ts", "event_id"]).select("run", F.col("sequence").alias("seq"), "kind")
    runs = events.select(F.col("user_id").alias("run"), F.lit("started").alias("status"), F.lit(0).alias("retries"), F.lit(None).cast("string").alias("failed_at")).distinct()
    return ingest.advanced(runs, steps)


@query("orphan_blobs", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN 'adopted' ELSE 'pending' END AS state FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) d RIGHT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def orphan_blobs(spark, sf_dir):
    """Blobs without a row are pending; those that a later run lists are adopted."""
    orphans = read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("state", F.lit("pending"))
    listed = read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id").distinct().withColumn("state", F.lit("adopted"))
    return ingest.upserted(orphans, listed.join(orphans.select("doc_id"), "doc_id", "left_semi"), ["doc_id"], {"state": merge.replace})


@query("candidate_approval", "SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' UNION SELECT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount > 0.09")
def candidate_approval(spark, sf_dir):
    """Approved pairs join the links, unless they are there."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = lambda test: lines.where(test).select("l_suppkey", "p_brand").distinct()
    return ingest.inserted_new(pairs("l_returnflag = 'R'"), pairs("l_discount > 0.09"), ["l_suppkey", "p_brand"])


@query("archive_delete", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS payload FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def archive_delete(spark, sf_dir):
    """Some ids are deleted, and payloads that were moved elsewhere are emptied."""
    gone = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    payload = F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").join(gone, "o_orderkey", "left_anti").select("o_orderkey", payload.alias("payload"))


@query(
    "semantic_cache",
    f"WITH k AS (SELECT o_orderkey, sha256(concat_ws('|', 'v1', o_orderpriority, o_orderstatus, o_custkey % 50)) AS key, o_orderdate < {CUT} AS old FROM orders), c AS (SELECT key, min(o_orderkey) AS answer FROM k WHERE old GROUP BY 1) SELECT o_orderkey, answer, answer IS NOT NULL AS hit FROM k LEFT JOIN c USING (key) WHERE NOT old",
)
def semantic_cache(spark, sf_dir):
    """Answers are kept under a digest of input and versions; the first one put stays."""
    key = F.sha2(F.concat_ws("|", F.lit("v1"), "o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 50).cast("string")), 256).alias("key")
    old, new = (df.select("o_orderkey", key) for df in halves(spark, sf_dir))
    cache = old.groupBy("key").agg(F.min("o_orderkey").alias("answer"))
    return new.join(cache, "key", "left").select("o_orderkey", "answer", F.col("answer").isNotNull().alias("hit"))


@query("backfill_failures", "SELECT user_id, count(*) FILTER (event_type = 'error') AS attempts, CASE WHEN count(*) FILTER (event_type = 'error') >= 15 THEN 'failed' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'done' ELSE 'pending' END AS status FROM events GROUP BY 1")
def backfill_failures(spark, sf_dir):
    """Attempts of two halves add up in the queue; too many fail an entry."""
    events = read(spark, sf_dir, "events")
    part = lambda test: events.where(test).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("attempts"), F.count_if(F.col("event_type") == "purchase").alias("done"))
    both = ingest.upserted(part("event_id % 2 = 0"), part("event_id % 2 = 1"), ["user_id"], {"attempts": merge.add, "done": merge.add})
    return both.select("user_id", "attempts", F.when(F.col("attempts") >= 15, "failed").when(F.col("done") > 0, "done").otherwise("pending").alias("status"))


@query("legacy_seed", "SELECT lower(p_type) AS topic, 'seed' AS origin FROM part GROUP BY 1 UNION SELECT lower(p_brand), 'legacy' FROM part WHERE p_size > 40 AND lower(p_brand) NOT IN (SELECT lower(p_type) FROM part)")
def legacy_seed(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    taxonomy = part.select(F.lower("p_type").alias("topic")).distinct().withColumn("origin", F.lit("seed"))
    legacy = part.where("p_size > 40").select(F.lower("p_brand").alias("topic"), F.lit("legacy").alias("origin"))
    return ingest.inserted_new(taxonomy, legacy, ["topic"])


@query(
    "cluster_reuse",
    "WITH RECURSIVE c AS (SELECT o_custkey AS cluster, min(o_orderkey) AS ord FROM orders GROUP BY 1), k AS (SELECT cluster, row_number() OVER (ORDER BY ord) AS k FROM c), "
    "w AS (SELECT k, cluster, concat('p', o_orderkey % 97) AS prior, min(o_orderkey) AS pos FROM k JOIN orders ON o_custkey = cluster GROUP BY 1, 2, 3), l AS (SELECT k, cluster, list(prior ORDER BY pos, prior) AS wants FROM w GROUP BY 1, 2), "
    "r AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS cluster, NULL::VARCHAR AS id, []::VARCHAR[] AS claimed UNION ALL SELECT l.k, l.cluster, list_filter(wants, lambda x: NOT list_contains(claimed, x))[1], list_concat(claimed, list_filter(wants, lambda x: NOT list_contains(claimed, x))[1:1]) FROM r JOIN l ON l.k = r.k + 1) "
    "SELECT cluster, coalesce(id, concat('new_', cluster)) AS id FROM r WHERE k > 0",
)
def cluster_reuse(spark, sf_dir):
    """Customers as clusters of their orders, which were in 97 former clusters: in order, each takes the first one that is free."""
    orders = read(spark, sf_dir, "orders")
    clusters = orders.groupBy(F.col("o_custkey").alias("cluster")).agg(F.min("o_orderkey").alias("ord")).withColumn("fingerprint", F.lit("-"))
    members = orders.select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("article"), F.col("o_orderkey").alias("pos"))
    prior = orders.select(F.col("o_orderkey").alias("article"), F.concat(F.lit("p"), (F.col("o_orderkey") % 97).cast("string")).alias("prior_id"), F.lit("+").alias("fingerprint"))
    return ingest.reused_ids(clusters, members, prior)[0]


@query("cluster_lookup", "SELECT o_orderkey, l_linenumber, o_orderpriority FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND (l_partkey % 50 = 7 OR (l_linenumber IS NULL AND o_orderpriority = '5-LOW'))")
def cluster_lookup(spark, sf_dir):
    """Active clusters of some articles, and those of a fingerprint that have no source."""
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    by_article = orders.join(lines.where("l_partkey % 50 = 7"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "o_orderpriority")
    bare = orders.where("o_orderpriority = '5-LOW'").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", F.lit(None).cast("int").alias("l_linenumber"), "o_orderpriority")
    return by_article.union(bare)


@query("seed_merge", "SELECT doc_id, md5(text) AS url, 'live' AS origin FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, md5(text), 'seed' FROM documents d WHERE doc_id % 2 <> 0 AND NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id % 2 = 0 AND x.text = d.text)")
def seed_merge(spark, sf_dir):
    """Seeds join the live articles if neither id nor address is there."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("url"))
    live = docs.where("doc_id % 2 = 0").withColumn("origin", F.lit("live"))
    seeds = docs.withColumn("origin", F.lit("seed"))
    return live.unionByName(seeds.join(live.select("doc_id"), "doc_id", "left_anti").join(live.select("url"), "url", "left_anti"))


@query("member_articles", f"WITH {REPORTS} SELECT cluster, count(DISTINCT part) AS members, min(part) AS first_part FROM reports GROUP BY 1")
def member_articles(spark, sf_dir):
    """Clusters hold the addresses of their members, which are looked up one by one."""
    reports = read_reports(spark, sf_dir)
    urls = reports.groupBy("cluster").agg(F.collect_set(F.concat(F.lit("https://example.com/"), F.replace("part", F.lit(" "), F.lit("-")))).alias("urls"))
    by_url = read(spark, sf_dir, "part").select("p_name").distinct().select(F.concat(F.lit("https://example.com/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("url"), "p_name")
    found = urls.select("cluster", F.explode("urls").alias("url")).join(by_url, "url")
    return found.groupBy("cluster").agg(F.count("*").alias("members"), F.min("p_name").alias("first_part"))
