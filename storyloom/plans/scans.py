"""Queries of scans, adapters and cleaning. Feeds, payloads and posts are built from the tables first, so that reading them back can be checked."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from storyloom.functions import cleaning, text
from storyloom.operators import rows
from storyloom.plans.registry import query
from storyloom.sources import feeds
from storyloom.sources.tables import read
from storyloom.sources.versions import VersionedTable, scratch


@query(
    "feed_scan",
    "SELECT o_orderkey, concat('Order ', o_orderkey, ' & more') AS title, concat('https://example.com/', o_orderkey) AS url, "
    "CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '2002-01-01' ELSE o_orderdate END AS published, concat('Status ', o_orderstatus, ' #Priority', substr(o_orderpriority, 1, 1)) AS body, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'https://example.com/a.png' ELSE '' END AS thumbnail, concat('Radar,Priority', substr(o_orderpriority, 1, 1)) AS tags FROM orders WHERE o_orderkey % 10 < 8",
)
def feed_scan(spark, sf_dir):
    """RSS items for even orders, Atom entries for odd ones; some without title or link, some without a date."""
    key, lit = F.col("o_orderkey").cast("string"), F.lit
    at = F.when(F.col("o_orderkey") % 7 == 0, "soon").when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), lit(" GMT"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    title = F.when(F.col("o_orderkey") % 10 == 8, lit("")).otherwise(F.concat(lit("<b>Order</b> "), key, lit(" &amp;amp; more")))
    address = F.when(F.col("o_orderkey") % 10 == 9, lit("javascript:x")).otherwise(F.concat(lit("https://example.com/"), key))
    body = F.concat(lit("Status "), "o_orderstatus", lit(" #Priority"), F.substring("o_orderpriority", 1, 1))
    rss = F.concat(
        lit("<rss><channel><item><title>"), title, lit("</title><guid>"), address, lit("</guid><pubDate>"), at, lit("</pubDate><description><![CDATA["), body,
        lit("]]></description><category>Radar</category><category>news</category><category>radar</category><enclosure url='https://example.com/a.png' type='image/png'/></item></channel></rss>"),
    )
    atom = F.concat(lit("<feed><entry><title>"), title, lit("</title><link href='"), address, lit("'/><updated>"), at, lit("</updated><summary>"), body, lit("</summary><category><![CDATA[Radar]]></category></entry></feed>"))
    source = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, rss).otherwise(atom).alias("xml"))
    found = feeds.feed_items(source, "xml", F.lit("2002-01-01").cast("timestamp"))
    return found.select("o_orderkey", "title", "url", F.col("published").cast("timestamp_ntz").alias("published"), "body", "thumbnail", F.array_join("tags", ",").alias("tags"))


@query(
    "parliament_questions",
    "WITH q AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS rajya, o_orderkey % 4 = 0 AS starred, o_orderdate, o_orderpriority FROM orders) SELECT o_orderkey, CASE WHEN rajya THEN 'Rajya Sabha' ELSE 'Lok Sabha' END AS full_house, "
    "CASE WHEN o_orderkey % 5 = 0 THEN concat('SQ ', o_orderkey) WHEN o_orderkey % 5 = 1 THEN concat('USQ ', o_orderkey) ELSE concat(CASE WHEN starred THEN 'SQ ' ELSE 'USQ ' END, o_orderkey) END AS question_number, "
    "CASE WHEN o_orderkey % 11 = 0 THEN '2002-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS answering_date, CASE WHEN o_orderkey % 2 = 0 THEN 'Ministry of Defence' ELSE 'Ministry of Ports' END AS full_ministry, "
    "concat(CASE WHEN rajya THEN 'Rajya Sabha' ELSE 'Lok Sabha' END, CASE WHEN starred THEN ' Starred' ELSE ' Unstarred' END, ' Question No. ', o_orderkey, ': ', o_orderpriority) AS title FROM q",
)
def parliament_questions(spark, sf_dir):
    """Payloads of three shapes with numbers, dates, houses and ministries in several forms."""
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    number = F.when(k % 5 == 0, F.concat(F.lit("AS "), key)).when(k % 5 == 1, F.concat(F.lit("usq"), key)).otherwise(F.concat(F.lit("No. "), key))
    day = F.when(k % 11 == 0, "soon").when(k % 2 == 0, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    one = F.struct(
        F.when(k % 3 == 0, "RAJYA SABHA").otherwise("Lok Sabha").alias("house"), number.alias("questionNo"), F.when(k % 4 == 0, "STARRED").otherwise("Unstarred").alias("type"), day.alias("date"),
        F.when(k % 4 == 0, "Defence").when(k % 2 == 0, "").otherwise("Ports").alias("ministry"), F.col("o_orderpriority").alias("subject"),
    )
    listed = F.array(one)
    payload = F.when(k % 3 == 0, F.to_json(listed)).when(k % 3 == 1, F.to_json(F.struct(listed.alias("data")))).otherwise(F.to_json(F.struct(listed.alias("questions"))))
    source = read(spark, sf_dir, "orders").select("o_orderkey", payload.alias("json"))
    found = feeds.normalized_questions(feeds.questions(source, "json"), F.lit("2002-01-01"))
    return found.select("o_orderkey", "full_house", "question_number", "answering_date", "full_ministry", "title")


@query(
    "social_posts",
    "SELECT o_orderkey, concat('Order ', o_orderkey, ' of status ', o_orderstatus) AS title, concat('@user', o_custkey % 50) AS account, concat('https://x.com/user', o_custkey % 50, '/status/', o_orderkey + 1) AS url FROM orders",
)
def social_posts(spark, sf_dir):
    key, user = F.col("o_orderkey").cast("string"), F.concat(F.lit("user"), (F.col("o_custkey") % 50).cast("string"))
    body = F.concat(F.lit("IAF HQ: Order "), key, F.lit(" https://t.co/ab_1  of status "), "o_orderstatus", F.lit(" #Orders #x1"))
    url = F.concat(F.lit("https://nitter.net/"), user, F.lit("/status/"), (F.col("o_orderkey") + 1).cast("string"), F.lit("#m"))
    posts = read(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"), url.alias("mirror"), feeds.handle(url).alias("account"))
    return posts.select("o_orderkey", feeds.post_headline(F.col("body")).alias("title"), "account", feeds.status_url(F.col("mirror"), F.col("account")).alias("url"))


NAMED = "{0}"
for _name, _char in cleaning.ENTITIES:
    NAMED = f"replace({NAMED}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(
    "page_articles",
    "WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS b FROM pages), "
    f"c AS (SELECT page_id, trim(regexp_replace(trim({NAMED.format('concat(t, chr(46), chr(32), b)')}), '\\s+', ' ', 'g')) AS x FROM p) "
    "SELECT page_id, substr(trim(regexp_extract(x, '^([^.!?]*)', 1)), 1, 200) AS title, substr(x, 1, 500) AS snippet FROM c",
)
def page_articles(spark, sf_dir):
    """Pages as articles; here the cuts to 200 and 500 characters are the feature."""
    return read(spark, sf_dir, "pages").select("page_id", *text.page_article(F.col("html")))


@query(
    "named_entities",
    f"SELECT page_id, sha256(trim({NAMED.format('html')})) AS decoded_sha FROM pages",
)
def named_entities(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(cleaning.named_entities(F.col("html")), 256).alias("decoded_sha"))


@query("source_registry", "SELECT DISTINCT source AS domain, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 5 AS tier FROM documents WHERE CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 5 IN (0, 2)")
def source_registry(spark, sf_dir):
    """The feeds of two tiers."""
    tier = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 5
    return rows.matching(read(spark, sf_dir, "documents").select(F.col("source").alias("domain"), tier.alias("tier")).distinct(), tier=[0, 2], domain=None)


@query("snapshot_publish", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def snapshot_publish(spark, sf_dir):
    """Three versions are published and pruned to two; the newest one is read."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = VersionedTable(spark, f"{scratch(spark)}/snapshots-{os.urandom(6).hex()}")
    for wanted in ("o_orderstatus = 'O'", "true", "o_orderstatus <> 'P'"):
        table.publish(orders.where(wanted))
    table.prune(2)
    return table.read()


@query(
    "payload_store",
    "SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price, strftime(o_orderdate, '%Y') AS year FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R'",
)
def payload_store(spark, sf_dir):
    """Orders are archived as JSON payloads by year; those of returned lines are fetched by id and parsed."""
    body = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")))
    archive = read(spark, sf_dir, "orders").select("o_orderkey", body.alias("payload"), F.date_format("o_orderdate", "yyyy").alias("year"))
    table = VersionedTable(spark, f"{scratch(spark)}/payloads-{os.urandom(6).hex()}")
    table.publish(archive.repartition("year"), ["year"])
    wanted = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    found = table.read().join(wanted, "o_orderkey", "left_semi").withColumn("x", F.from_json("payload", "status string, price double"))
    return found.select("o_orderkey", "x.status", "x.price", "year")


@query(
    "site_index",
    "SELECT 'https://example.com/' AS loc, NULL AS lastmod, 'hourly' AS changefreq, 1.0::DOUBLE AS priority UNION ALL SELECT concat('https://example.com/nation/', lower(n_name)), NULL, 'daily', 0.8 FROM nation "
    "UNION ALL SELECT concat('https://example.com/customer/', o_custkey), strftime(max(o_orderdate), '%Y-%m-%d'), 'weekly', 0.5 FROM orders GROUP BY o_custkey",
)
def site_index(spark, sf_dir):
    """Addresses of a site with the day of their last change."""
    entry = lambda df, loc, at, often, weight: df.select(loc.alias("loc"), at.cast("string").alias("lastmod"), F.lit(often).alias("changefreq"), F.lit(weight).alias("priority"))
    base = F.lit("https://example.com/")
    home = entry(spark.range(1), base, F.lit(None), "hourly", 1.0)
    nations = entry(read(spark, sf_dir, "nation"), F.concat(base, F.lit("nation/"), F.lower("n_name")), F.lit(None), "daily", 0.8)
    last = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    return home.union(nations).union(entry(last, F.concat(base, F.lit("customer/"), F.col("o_custkey").cast("string")), F.date_format("at", "yyyy-MM-dd"), "weekly", 0.5))


@query(
    "safe_urls",
    "WITH h AS (SELECT event_id, event_id % 256 AS a, (event_id * 7) % 256 AS b, (event_id * 13) % 256 AS c, event_id % 300 AS d FROM events), s AS (SELECT *, "
    "(a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224 OR d > 255) AS reserved FROM h) "
    "SELECT event_id, CASE event_id % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN false WHEN 5 THEN NOT reserved ELSE NOT reserved END AS is_safe FROM s",
)
def safe_urls(spark, sf_dir):
    """Addresses with names, local names, numbers, other schemes and dotted or mapped addresses."""
    k = F.col("event_id")
    ip = F.concat_ws(".", *[x.cast("string") for x in (k % 256, (k * 7) % 256, (k * 13) % 256, k % 300)])
    forms = ("http://news.example.com:8080/x", "https://intra.local/x", "ftp://example.com/", "http://2130706433/", "https://[fe80::1]/")
    url = F.concat(F.lit("http://"), ip, F.lit("/feed"))
    for n, form in enumerate(forms):
        url = F.when(k % 8 == n, F.lit(form)).otherwise(url)
    url = F.when(k % 8 == 7, F.concat(F.lit("http://[::ffff:"), ip, F.lit("]/"))).otherwise(url)
    return read(spark, sf_dir, "events").select("event_id", cleaning.is_safe_url(url).alias("is_safe"))


@query(
    "url_domains",
    "WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]*)', 1)), '^www\\.', '') AS domain FROM pages) "
    "SELECT page_id, domain, CASE WHEN domain = 'example.com' OR domain LIKE '%.example.com' THEN 1 WHEN domain = 'example.net' OR domain LIKE '%.example.net' THEN 2 ELSE 4 END AS tier FROM h",
)
def url_domains(spark, sf_dir):
    """A host's tier by the longest registered ending: each ending of the host is looked up, so the registry may be of any size."""
    registry = spark.createDataFrame([("example.com", 1), ("example.net", 2)], "suffix string, tier int")
    pages = read(spark, sf_dir, "pages").select("page_id", cleaning.domain(F.col("url")).alias("domain"))
    parts = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    hits = pages.select("page_id", F.posexplode(suffixes).alias("at", "suffix")).join(registry, "suffix")
    best = hits.groupBy("page_id").agg(F.min_by("tier", "at").alias("tier"))
    return pages.join(best, "page_id", "left").select("page_id", "domain", F.coalesce("tier", F.lit(4)).alias("tier"))


NOISE = "(" + ", ".join(f"'{t}'" for t in cleaning.NOISE_TAGS) + ")"


@query(
    "tag_forms",
    "WITH t AS (SELECT p_partkey, concat('#', CASE WHEN p_partkey % 3 = 0 THEN 'th_' ELSE '' END, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN 'drdo mk2a' WHEN 2 THEN concat('Su', 10 + p_size) ELSE 'Latest_News' END) AS tag, p_name, p_size FROM part) "
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(upper(p_name[1]), substr(split_part(p_name, ' ', 1), 2), '-', upper(split_part(p_name, ' ', 2)[1]), substr(split_part(p_name, ' ', 2), 2)) WHEN 1 THEN 'DRDO Mk2A' WHEN 2 THEN concat('Su', 10 + p_size) ELSE 'Latest_News' END AS cleaned, "
    "concat('th_', CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN 'drdo-mk2a' WHEN 2 THEN concat('su-', 10 + p_size) ELSE 'latest-news' END) AS slug, "
    f"regexp_replace(lower(replace(tag, '#', '')), '[\\s\\-_]+', '', 'g') IN {NOISE} AS is_noise, CASE p_partkey % 4 WHEN 0 THEN concat(upper(p_name[1]), substr(split_part(p_name, ' ', 1), 2), '-', upper(split_part(p_name, ' ', 2)[1]), substr(split_part(p_name, ' ', 2), 2)) "
    "WHEN 1 THEN 'DRDO Mk2A' WHEN 2 THEN concat('Su-', 10 + p_size) ELSE CASE WHEN p_partkey % 3 = 0 THEN 'Latest_News' ELSE '' END END AS canonical FROM t",
)
def tag_forms(spark, sf_dir):
    """Tags in several spellings: cleaned, as a slug, as noise and in the canonical form."""
    k = F.col("p_partkey")
    body = F.when(k % 4 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).when(k % 4 == 1, "drdo mk2a").when(k % 4 == 2, F.concat(F.lit("Su"), (F.col("p_size") + 10).cast("string"))).otherwise("Latest_News")
    tag = F.concat(F.lit("#"), F.when(k % 3 == 0, "th_").otherwise(""), body)
    tags = read(spark, sf_dir, "part").select("p_partkey", tag.alias("tag"))
    t = F.col("tag")
    return tags.select("p_partkey", cleaning.clean_tag(t).alias("cleaned"), cleaning.tag_slug(t).alias("slug"), cleaning.is_noise_tag(t).alias("is_noise"), cleaning.canonical_tag(t).alias("canonical"))


@query(
    "snippet_cleaning",
    "SELECT o_orderkey, concat('Order ', o_orderkey, ' has status ', o_orderstatus, '.') AS stripped, CASE WHEN o_orderkey % 2 = 0 THEN 'Daily News' ELSE 'PIB' END AS source, concat('Order ', o_orderkey, ' & more') AS headline FROM orders",
)
def snippet_cleaning(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    raw = F.concat(F.lit("Originally published on Wire.com "), F.lit("Order "), key, F.lit(" has status "), "o_orderstatus", F.lit(". Read more at example.com [+12 chars]"))
    name = F.when(F.col("o_orderkey") % 2 == 0, "Daily News (Global Top 100)").otherwise("press information bureau - MoD")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"), name.alias("name"), F.concat(F.lit("Order  "), key, F.lit(" &amp; more ...")).alias("head"))
    return orders.select("o_orderkey", cleaning.strip_notices(F.col("raw")).alias("stripped"), cleaning.source_name(F.col("name")).alias("source"), cleaning.headline(F.col("head")).alias("headline"))
