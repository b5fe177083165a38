"""Queries of lookups, monitoring, limits and breakers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.operators import folds, ranking, rows
from storyloom.plans.registry import REPORTS, query, r4
from storyloom.sources.tables import read, read_reports

# Each signal counts rows of one table that meet a test; all signals of a table come from one pass.
COUNTS = {
    "orders": {
        "clusters_active": "o_orderstatus = 'O'", "clusters_pending": "o_orderstatus = 'P'", "clusters_final": "o_orderstatus = 'F'", "candidates_pending": "o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'",
        "provisional_waiting": "o_orderpriority = '5-LOW'", "provisional_abandoned": "o_orderpriority = '5-LOW' AND o_orderdate < TIMESTAMP{} '1998-01-01 00:00:00'", "candidates_of_a_week": "o_orderdate >= TIMESTAMP{} '1998-07-26 00:00:00' AND o_orderdate < TIMESTAMP{} '1998-08-02 00:00:00'",
    },
    "lineitem": {
        "failures": "l_returnflag = 'R'", "runs_reused": "l_linestatus = 'F'", "runs_validated": "l_linestatus = 'O'", "backlog": "l_quantity > 45", "orphan_blobs": "l_tax = 0", "runs_incomplete": "l_discount > 0.09 AND l_linestatus = 'O'",
        "runs_failed_for_good": "l_returnflag = 'R' AND l_discount > 0.09", "runs_stale": "l_returnflag = 'R' AND l_shipdate < TIMESTAMP{} '1996-01-01 00:00:00'",
    },
    "part": {"redirect_targets": "p_size > 25"},
}


@query(
    "monitoring_report",
    " UNION ALL ".join(f"SELECT '{name}' AS signal, count(*) FILTER ({test.format('', '')})::DOUBLE AS value FROM {table}" for table, tests in COUNTS.items() for name, test in tests.items())
    + " UNION ALL SELECT 'untagged_rate', floor((1 - (SELECT count(DISTINCT l_orderkey) FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey) / (SELECT count(*) FROM orders)) * 10000.0 + 0.5) / 10000.0 "
    "UNION ALL SELECT 'topics_per_cluster', floor(avg(n) * 10000.0 + 0.5) / 10000.0 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) UNION ALL SELECT concat('assigned_by_', l_returnflag), count(*) FROM lineitem GROUP BY l_returnflag "
    "UNION ALL SELECT 'broken_redirects', count(*) FROM lineitem ANTI JOIN part ON l_partkey = p_partkey UNION ALL SELECT 'public_unpublished', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_linestatus = 'O' "
    "UNION ALL SELECT 'drift', count(*) FROM (SELECT 1 FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linenumber HAVING count(*) > 1)",
)
def monitoring_report(spark, sf_dir):
    """Twenty-odd signals; those of one table come from one pass over it."""
    tables = {name: read(spark, sf_dir, name) for name in COUNTS}
    signal = lambda df, name, value: df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("signal"), "value")
    found = []
    for table, tests in COUNTS.items():
        one = tables[table].agg(*[F.count_if(F.expr(test.format("_NTZ", "_NTZ"))).cast("double").alias(name) for name, test in tests.items()])
        found.append(one.unpivot([], list(tests), "signal", "value"))
    orders, lines, part = tables["orders"], tables["lineitem"], tables["part"]
    tagged = orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("tagged", F.lit(1)), "o_orderkey", "left")
    found += [
        signal(tagged, "untagged_rate", r4(1 - F.count("tagged") / F.count("*"))), signal(lines.groupBy("l_orderkey").agg(F.count("*").alias("n")), "topics_per_cluster", r4(F.avg("n"))),
        lines.groupBy(F.concat(F.lit("assigned_by_"), "l_returnflag").alias("signal")).agg(F.count("*").cast("double").alias("value")),
        signal(lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_anti"), "broken_redirects", F.count("*")),
        signal(lines.where("l_linestatus = 'O'").join(orders.where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey")), "public_unpublished", F.count("*")),
        signal(lines.where("l_linestatus = 'O'").groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1"), "drift", F.count("*")),
    ]
    return reduce(lambda a, b: a.unionByName(b), found)


@query(
    "rate_limiter",
    "WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts)::BIGINT AS s FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)), w AS (SELECT user_id, min(s) AS start FROM e GROUP BY 1 UNION ALL SELECT w.user_id, (SELECT min(s) FROM e WHERE e.user_id = w.user_id AND e.s >= w.start + 86400) FROM w WHERE (SELECT min(s) FROM e WHERE e.user_id = w.user_id AND e.s >= w.start + 86400) IS NOT NULL), "
    "n AS (SELECT event_id, row_number() OVER (PARTITION BY e.user_id, w.start ORDER BY s, event_id) AS k FROM e ASOF JOIN w ON e.user_id = w.user_id AND e.s >= w.start) SELECT event_id, k <= 3 AS allowed, greatest(0, 3 - k) AS remaining FROM n",
)
def rate_limiter(spark, sf_dir):
    """Three events a day for each user, in windows that begin with an event."""
    return folds.rate_limited(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 86400)


@query(
    "breaker_states",
    "WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS s, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT, event_id) AS k FROM events), "
    "r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 'CLOSED' AS state, 0 AS failures, 0::BIGINT AS since FROM e UNION ALL "
    "SELECT e.user_id, e.k, e.event_id, CASE WHEN NOT bad THEN 'CLOSED' WHEN (state = 'OPEN' AND s - since >= 86400) OR failures + 1 >= 2 THEN 'OPEN' ELSE state END, CASE WHEN bad THEN failures + 1 ELSE 0 END, CASE WHEN bad THEN s ELSE since END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) "
    "SELECT event_id, state, failures::BIGINT AS failures FROM r WHERE k > 0",
)
def breaker_states(spark, sf_dir):
    """A breaker for each user that opens after two failures in a row and may be tried after a day."""
    return folds.breaker(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error", 2, 86400)


@query("thread_events", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def thread_events(spark, sf_dir):
    """The events of some threads in order."""
    wanted = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    found = read(spark, sf_dir, "events").join(wanted, "user_id", "left_semi")
    return found.select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("position"))


@query("governance_preview", "SELECT n_nationkey AS topic, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS clusters, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS aliases, (SELECT count(*) FROM nation r WHERE r.n_regionkey = n.n_nationkey) AS redirects FROM nation n")
def governance_preview(spark, sf_dir):
    """What a change of each topic touches: three counts joined to all topics."""
    count = lambda df, key, name: df.groupBy(F.col(key).alias("topic")).agg(F.count("*").alias(name))
    nation = read(spark, sf_dir, "nation")
    found = nation.select(F.col("n_nationkey").alias("topic"))
    for df, key, name in ((read(spark, sf_dir, "customer"), "c_nationkey", "clusters"), (read(spark, sf_dir, "supplier"), "s_nationkey", "aliases"), (nation, "n_regionkey", "redirects")):
        found = found.join(count(df, key, name), "topic", "left")
    return found.fillna(0)


@query("overrides_redacted", "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS position FROM orders QUALIFY position <= 50")
def overrides_redacted(spark, sf_dir):
    """The newest 50 overrides without who made them; the limit is the feature."""
    newest = rows.top(read(spark, sf_dir, "orders").drop("o_custkey"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 50)
    return newest.select("o_orderkey", "o_orderdate", F.row_number().over(Window.orderBy(F.col("o_orderdate").desc(), "o_orderkey")).cast("long").alias("position"))


@query("pending_candidates", "SELECT l_suppkey, p_brand, count(*) AS mentions, floor(least(1.0::DOUBLE, 0.3::DOUBLE + 0.15::DOUBLE * count(*) + 0.1::DOUBLE * count(DISTINCT l_returnflag)) * 10000.0 + 0.5) / 10000.0 AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY 1, 2 ORDER BY confidence DESC, mentions DESC, l_suppkey, p_brand LIMIT 50")
def pending_candidates(spark, sf_dir):
    """The first 50 pending pairs by confidence and mentions; the limit is the feature."""
    from storyloom.functions.scoring import link_confidence

    lines = read(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = lines.groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("mentions"), F.countDistinct("l_returnflag").alias("s"))
    found = found.select("l_suppkey", "p_brand", "mentions", link_confidence(F.col("mentions"), F.col("s")).alias("confidence"))
    return rows.top(found, [F.col("confidence").desc(), F.col("mentions").desc(), F.col("l_suppkey"), F.col("p_brand")], 50)


@query("thread_list", "SELECT * FROM (SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS events FROM customer ORDER BY c_name, c_custkey LIMIT 20) WHERE events > 0")
def thread_list(spark, sf_dir):
    """A page of threads without those that have no event: they go after the limit, so the page may be short."""
    page = rows.top(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), [F.col("c_name"), F.col("c_custkey")], 20)
    counts = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("events"))
    return page.join(counts, "c_custkey", "left").where("coalesce(events, 0) > 0")


@query("curator_ingest", "SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'curated' ELSE o_orderstatus END AS state FROM orders UNION ALL SELECT -1, 'curated'")
def curator_ingest(spark, sf_dir):
    """Curated clusters come first and replace those of the same id."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    new = orders.where("o_orderkey % 100 = 0").select("o_orderkey").union(spark.createDataFrame([(-1,)], "o_orderkey long")).withColumn("state", F.lit("curated"))
    both = new.withColumn("at", F.lit(0)).unionByName(orders.withColumn("at", F.lit(1)))
    return rows.one_per_key(both, ["o_orderkey"], [F.col("at")]).drop("at")


@query("discussion_quotes", f"WITH {REPORTS} SELECT id, concat('@', split_part(domain, '.', 1)) AS author, substr(title, 1, 60) AS quote, 'X' AS platform FROM reports WHERE tier = 2")
def discussion_quotes(spark, sf_dir):
    """Social sources as quotes in a discussion; a quote has 60 characters."""
    social = read_reports(spark, sf_dir).where(F.col("tier") == ranking.SOCIAL)
    quote = F.struct(F.concat(F.lit("@"), F.substring_index("domain", ".", 1)).alias("author"), F.substring("title", 1, 60).alias("quote"), F.lit("X").alias("platform"))
    return social.select("id", quote.alias("q")).select("id", "q.*")


@query("program_lookups", "SELECT o_orderkey, p_partkey, p_name FROM orders JOIN part ON p_partkey = o_orderkey % 2000 AND p_type IN ('PROMO', 'LARGE') AND p_size BETWEEN 10 AND 20")
def program_lookups(spark, sf_dir):
    """Programmes of two domains and some stages for the questions that name them by id."""
    wanted = rows.matching(read(spark, sf_dir, "part"), p_type=["PROMO", "LARGE"], p_size=list(range(10, 21)))
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 2000).alias("p_partkey")).join(wanted, "p_partkey").select("o_orderkey", "p_partkey", "p_name")


@query("order_book_value", "SELECT o_orderkey, floor(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END), 0) * 100 + 0.5) / 100 AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def order_book_value(spark, sf_dir):
    """The sum over nested batches, whose unknown values count as nothing."""
    batches = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("value"))).alias("batches"))
    total = F.aggregate("batches", F.lit(0.0), lambda s, b: s + F.coalesce(b["value"], F.lit(0.0)))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(batches, "o_orderkey", "left").select("o_orderkey", (F.floor(F.coalesce(total, F.lit(0.0)) * 100 + 0.5) / 100).alias("value"))


@query("editor_table", f"WITH {REPORTS} SELECT id, tier, title FROM reports WHERE tier <> 4 AND contains(lower(title), 'contract') ORDER BY tier, published DESC, id LIMIT 100")
def editor_table(spark, sf_dir):
    """The active candidates with a text in their title, by score; the limit is the feature."""
    found = read_reports(spark, sf_dir).where((F.col("tier") != 4) & F.contains(F.lower("title"), F.lit("contract")))
    return rows.top(found, [F.col("tier"), F.col("published").desc(), F.col("id")], 100).select("id", "tier", "title")


@query("brief_review", "SELECT l_orderkey, count(*) FILTER (l_tax > 0.05) AS points FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_tax > 0.05) > 0 OR max(l_shipdate) > TIMESTAMP '2000-01-01'")
def brief_review(spark, sf_dir):
    """Briefs that have points or a summary."""
    found = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_tax") > 0.05, F.col("l_linenumber"))).alias("p"), F.max("l_shipdate").alias("at"))
    return found.where((F.size("p") > 0) | F.coalesce(F.col("at") > F.lit("2000-01-01").cast("timestamp_ntz"), F.lit(False))).select("l_orderkey", F.size("p").cast("long").alias("points"))


@query("source_scorecard", "WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, floor((CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.85 WHEN 3 THEN 0.7 ELSE 0.5 END)::DOUBLE * 100.0 * 1.1::DOUBLE * 100 + 0.5) / 100 AS weight FROM s WHERE contains(source, '1')")
def source_scorecard(spark, sf_dir):
    tier = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 5
    counts = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).where(F.contains("source", F.lit("1")))
    return counts.select("source", "n", (F.floor(ranking.tier_weight(tier) * 100.0 * F.lit(1.1) * 100 + 0.5) / 100).alias("weight"))


@query("editorial_scores", "WITH m AS (SELECT max(o_totalprice) AS top FROM orders) SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN greatest(o_totalprice, 100) + 50 WHEN 1 THEN 0.0 ELSE o_totalprice END AS score, o_orderkey % 10 = 0 AS promoted, CASE o_orderkey % 10 WHEN 0 THEN greatest(o_totalprice, 100) + 50 WHEN 1 THEN 0.0 ELSE o_totalprice END > top AS leads FROM orders, m WHERE o_orderkey % 10 <> 2")
def editorial_scores(spark, sf_dir):
    """Promoted, demoted and deleted entries, and whether a score is above all former ones."""
    orders = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 10
    score = F.when(k == 0, F.greatest("o_totalprice", F.lit(100.0)) + 50).when(k == 1, 0.0).otherwise(F.col("o_totalprice"))
    top = F.broadcast(orders.agg(F.max("o_totalprice").alias("top")))
    return orders.where(k != 2).join(top, F.lit(True)).select("o_orderkey", score.alias("score"), (k == 0).alias("promoted"), (score > F.col("top")).alias("leads"))


@query("legacy_tags", "SELECT o_orderkey, CASE WHEN n.n_name IS NOT NULL THEN concat('topic:', n.n_name) WHEN r.r_name IS NOT NULL THEN concat('region:', r.r_name) ELSE 'candidate' END AS resolved FROM orders LEFT JOIN nation n ON n.n_nationkey = o_custkey % 40 LEFT JOIN region r ON r.r_regionkey = o_custkey % 40 - 25")
def legacy_tags(spark, sf_dir):
    """Tags are looked up as aliases, then as hashtags; what is neither is a candidate."""
    tag = F.col("o_custkey") % 40
    aliases = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("tag"), F.concat(F.lit("topic:"), "n_name").alias("a"))
    hashtags = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 25).cast("long").alias("tag"), F.concat(F.lit("region:"), "r_name").alias("h"))
    found = read(spark, sf_dir, "orders").select("o_orderkey", tag.alias("tag")).join(aliases, "tag", "left").join(hashtags, "tag", "left")
    return found.select("o_orderkey", F.coalesce("a", "h", F.lit("candidate")).alias("resolved"))


@query("quarantined_feeds", "SELECT user_id, concat('\"', max(event_id) FILTER (event_type <> 'error'), '\"') AS etag, max(ts) FILTER (event_type <> 'error') AS last_ok FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 12")
def quarantined_feeds(spark, sf_dir):
    """Feeds that failed too often, with what a conditional request would send."""
    ok = F.col("event_type") != "error"
    found = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(ok, F.col("event_id"))).alias("e"), F.max(F.when(ok, F.col("ts"))).alias("last_ok"), F.count_if(~ok).alias("bad"))
    return found.where("bad > 12").select("user_id", F.concat(F.lit('"'), F.col("e").cast("string"), F.lit('"')).alias("etag"), "last_ok")


@query("prompt_fields", "SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '(?i)(^|[^a-z0-9_])(in conclusion|it is worth noting|landscape)([^a-z0-9_]|$)', '\\1\\3', 'g'))) AS field_sha, CAST(len(regexp_extract_all(text, '[.!?]')) AS BIGINT) >= 2 AS structured FROM documents")
def prompt_fields(spark, sf_dir):
    """Texts as fields of a prompt, without control characters and set phrases; whether there are two sentences."""
    plain = F.regexp_replace("text", r"[\x00-\x1F\x7F]", " ")
    plain = F.trim(F.regexp_replace(plain, r"(?i)(^|[^a-z0-9_])(in conclusion|it is worth noting|landscape)([^a-z0-9_]|$)", "$1$3"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(plain, 256).alias("field_sha"), (F.regexp_count("text", F.lit("[.!?]")) >= 2).alias("structured"))


@query("semantic_inputs", "SELECT l_orderkey, sha256(concat_ws('|', 'v1', 'r2', string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)))) AS input_hash FROM lineitem GROUP BY 1")
def semantic_inputs(spark, sf_dir):
    """A digest of each cluster's members and the versions that its answer depends on."""
    members = F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.concat_ws("|", F.lit("v1"), F.lit("r2"), members), 256).alias("input_hash"))


@query("click_events", "SELECT event_id, user_id, concat('https://example.com/', event_id, '?utm_source=app&utm_medium=', event_type) AS url FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'click') WHERE k <= 100")
def click_events(spark, sf_dir):
    """Each user's last hundred clicks, which is what is kept, with tracked addresses."""
    clicks = read(spark, sf_dir, "events").where("event_type = 'click'")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    url = F.concat(F.lit("https://example.com/"), F.col("event_id").cast("string"), F.lit("?utm_source=app&utm_medium="), "event_type")
    return clicks.withColumn("k", at).where("k <= 100").select("event_id", "user_id", url.alias("url"))


@query("indigenous_links", "SELECT l_suppkey, string_agg(DISTINCT p_type, ',' ORDER BY p_type) FILTER (p_size <= 20) AS local, count(DISTINCT p_type) FILTER (p_size > 20) AS others FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def indigenous_links(spark, sf_dir):
    """A supplier's links by status, as filters of one nested list."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = lines.groupBy("l_suppkey").agg(F.collect_set(F.struct("p_type", (F.col("p_size") <= 20).alias("local"))).alias("links"))
    local = F.array_sort(F.array_distinct(F.transform(F.filter("links", lambda x: x["local"]), lambda x: x["p_type"])))
    others = F.size(F.array_distinct(F.transform(F.filter("links", lambda x: ~x["local"]), lambda x: x["p_type"])))
    return found.select("l_suppkey", F.nullif(F.array_join(local, ","), F.lit("")).alias("local"), others.cast("long").alias("others"))
