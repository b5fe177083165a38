"""Queries of the archive: search, pages, days, moves, and checks of answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import cleaning, text
from storyloom.operators import rows, search
from storyloom.plans.registry import REPORTS, query
from storyloom.sources.tables import read, read_reports

SEARCHED = "concat(' ', trim(regexp_replace(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"


@query(
    "archive_search",
    f"WITH {REPORTS}, s AS (SELECT id, published, {SEARCHED.format('title')} AS a, {SEARCHED.format('snippet')} AS b, {SEARCHED.format('supplier')} AS c FROM reports) "
    "SELECT id FROM s WHERE (contains(a, ' nation 7 ') OR contains(b, ' nation 7 ') OR contains(c, ' nation 7 ')) AND (contains(a, ' flight ') OR contains(b, ' flight ') OR contains(c, ' flight ')) AND (contains(a, ' supplier ') OR contains(b, ' supplier ') OR contains(c, ' supplier '))",
)
def archive_search(spark, sf_dir):
    """All reports that have each phrase of a query in one of three fields."""
    found = read_reports(spark, sf_dir).select("id", *[search.searchable(F.col(c)).alias(c) for c in ("title", "snippet", "supplier")])
    return search.found(found, 'NATION-7 "Flight" súpplier ***', ["title", "snippet", "supplier"]).select("id")


@query("document_words", f"SELECT doc_id, sha256({SEARCHED.format('text')}) AS words_sha FROM documents")
def document_words(spark, sf_dir):
    """The searchable form of whole documents."""
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(search.searchable(F.col("text")), 256).alias("words_sha"))


@query(
    "related_stories",
    f"WITH {REPORTS}, s AS (SELECT id, title, published FROM reports WHERE contains({SEARCHED.format('title')}, ' red widget ')), t AS (SELECT title, min((-epoch(published)::BIGINT, id)) AS k FROM s GROUP BY 1), u AS (SELECT k[2] AS id, title, k FROM t) SELECT id, title FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, title) = 1",
)
def related_stories(spark, sf_dir):
    """Stories about a part: of each headline the newest, and of these of each id the newest."""
    found = read_reports(spark, sf_dir).select("id", "title", "published", search.searchable(F.col("title")).alias("t"))
    stories = search.found(found, "red-widget", ["t"]).select("id", "title", (-F.unix_seconds(F.col("published").cast("timestamp"))).alias("age"))
    return search.first_of_both(stories, ["age", "id"], "id", "title").select("id", "title")


@query("topic_articles_next", "SELECT o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 AND (o_orderdate < TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey < 900)) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def topic_articles_next(spark, sf_dir):
    """A later page of a topic's articles; the limit is the feature."""
    from datetime import datetime

    found = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").where("c_nationkey = 7"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate")
    return rows.page(found, [("o_orderdate", False), ("o_orderkey", False)], (datetime(1998, 1, 1), 900), 20)


@query("names_by_collation", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING lower(p_name) >= 'large' ORDER BY n DESC, p_name LIMIT 25")
def names_by_collation(spark, sf_dir):
    """Names by count, then by the order of the root collation, and compared without case; the limit is the feature."""
    named = read(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    return named.where("collate(p_name, 'UTF8_LCASE') >= collate('LARGE', 'UTF8_LCASE')").orderBy(F.col("n").desc(), F.expr("collate(p_name, 'UNICODE')")).limit(25)


@query(
    "archive_day_labels",
    "SELECT strftime(ts + INTERVAL '330 minutes', '%Y-%m-%d') AS day, CASE CAST(ts + INTERVAL '330 minutes' AS DATE) WHEN DATE '2024-01-20' THEN 'Today' WHEN DATE '2024-01-19' THEN 'Yesterday' ELSE strftime(ts + INTERVAL '330 minutes', '%-d %b %Y') END AS label, count(*) AS n FROM events GROUP BY 1, 2",
)
def archive_day_labels(spark, sf_dir):
    day = F.to_date(F.expr("ts + INTERVAL 330 MINUTES"))
    found = read(spark, sf_dir, "events").groupBy(day.alias("d")).agg(F.count("*").alias("n"))
    return found.select(F.date_format("d", "yyyy-MM-dd").alias("day"), search.day_label(F.col("d"), F.lit("2024-01-20").cast("date")).alias("label"), "n")


@query(
    "relative_times",
    "WITH s AS (SELECT event_id, greatest(0, date_diff('second', ts, TIMESTAMP '2024-01-20')) AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN concat(s // 60, 'm ago') WHEN s < 86400 THEN concat(s // 3600, 'h ago') WHEN s < 604800 THEN concat(s // 86400, 'd ago') END AS ago FROM s",
)
def relative_times(spark, sf_dir):
    seconds = F.expr("timestampdiff(SECOND, date_trunc('SECOND', ts), TIMESTAMP_NTZ '2024-01-20 00:00:00')")
    return read(spark, sf_dir, "events").select("event_id", search.ago(seconds).alias("ago"))


@query(
    "tag_variant_groups",
    "WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE replace(p_name, ' ', '-') END AS tag FROM part WHERE p_size > 5), g AS (SELECT regexp_replace(lower(tag), '[^a-z0-9]', '', 'g') AS key, count(DISTINCT tag) AS spellings, string_agg(DISTINCT tag, ',' ORDER BY tag) AS names, count(*) AS n FROM t GROUP BY 1 HAVING count(DISTINCT tag) > 1) "
    "SELECT *, floor(n * 10000.0 / (SELECT count(*) FROM part) + 0.5) / 10000.0 AS share FROM g",
)
def tag_variant_groups(spark, sf_dir):
    """Tags in several spellings and the share of all parts that have them."""
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    tag = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    grouped = part.where("p_size > 5").select(tag.alias("tag")).groupBy(F.regexp_replace(F.lower("tag"), "[^a-z0-9]", "").alias("key")).agg(
        F.countDistinct("tag").alias("spellings"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("names"), F.count("*").alias("n")
    )
    total = part.agg(F.count("*").alias("total"))
    return grouped.where("spellings > 1").join(F.broadcast(total), F.lit(True)).select("key", "spellings", "names", "n", (F.floor(F.col("n") * 10000.0 / F.col("total") + 0.5) / 10000.0).alias("share"))


@query("kb_page_counted", "SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier WHERE s_name ILIKE '%1%') AS total FROM supplier WHERE s_name ILIKE '%1%' ORDER BY s_name DESC, s_suppkey LIMIT 20 OFFSET 10")
def kb_page_counted(spark, sf_dir):
    """A page with the number of all rows; the limit is the feature."""
    found = read(spark, sf_dir, "supplier").where(F.col("s_name").ilike("%1%")).select("s_suppkey", "s_name")
    page = found.orderBy(F.col("s_name").desc(), "s_suppkey").offset(10).limit(20)
    return page.join(F.broadcast(found.agg(F.count("*").alias("total"))), F.lit(True))


@query(
    "archive_moves",
    "WITH b AS (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), a AS (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'), x AS (SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey % 4 = 0) "
    "SELECT DISTINCT o_custkey, 'archive' AS move FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a) UNION SELECT o_custkey, 'restore' FROM x WHERE o_custkey IN (SELECT o_custkey FROM a)",
)
def archive_moves(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    later = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    archive = read(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return search.popped(orders.where(~later), orders.where(later), archive, "o_custkey")


@query("unthreaded_batch", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey ORDER BY c_custkey LIMIT 25")
def unthreaded_batch(spark, sf_dir):
    """The next 25 of what has no thread; a run's size is the feature."""
    bare = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return rows.top(bare.select("c_custkey"), [F.col("c_custkey")], 25)


@query(
    "answer_salvage",
    "SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_totalprice END AS price, o_orderkey % 4 <> 2 AND o_orderkey % 4 <> 3 AS verbatim FROM orders WHERE o_orderkey % 5 <> 4",
)
def answer_salvage(spark, sf_dir):
    """Answers in fences, with commas too many and words around, one in five without any object; evidence that is or is not in the text."""
    k = F.col("o_orderkey") % 4
    evidence = F.when(k == 2, F.array(F.lit("not there"))).when(k == 3, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus", "o_orderpriority"))
    fields = F.struct(F.col("o_orderstatus").alias("status"), F.when(k != 3, F.col("o_totalprice")).alias("price"), evidence.alias("evidence"))
    body = F.regexp_replace(F.regexp_replace(F.to_json(fields), r"\}$", ",}"), r"\]", ",]")
    body = F.regexp_replace(body, r"\[,\]", "[]")
    answer = F.when(F.col("o_orderkey") % 5 == 4, "I cannot say.").when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body, F.lit(" Done.")))
    source = F.concat_ws(" ", "o_orderstatus", "o_orderpriority")
    found = read(spark, sf_dir, "orders").select("o_orderkey", source.alias("source"), F.from_json(search.salvaged(answer), "status string, price double, evidence array<string>").alias("x"))
    return found.where("x.status IS NOT NULL").select("o_orderkey", "x.status", "x.price", search.verbatim(F.col("x.evidence"), F.col("source")).alias("verbatim"))


@query("edge_tags", "SELECT p_partkey, concat(lpad(lower(printf('%x', {0})), 8, '0'), lpad(lower(printf('%x', {1})), 8, '0')) AS etag FROM part".replace("{0}", "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::HUGEINT)), lambda s, c: (xor(s, c) * 16777619) & 4294967295::HUGEINT)::BIGINT").replace("{1}", "list_reduce(list_prepend(16777619::HUGEINT, list_transform(string_split(reverse(p_name), ''), lambda c: ord(c)::HUGEINT)), lambda s, c: (xor(s, c) * 16777619) & 4294967295::HUGEINT)::BIGINT"))
def edge_tags(spark, sf_dir):
    """Tags of two hashes, forwards and backwards with another start."""
    eight = lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")
    units = text.utf16_units(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(eight(text.fnv1a(units)), eight(text.fnv1a(F.reverse(units), 16777619))).alias("etag"))


@query(
    "snippet_cuts",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('Order ', o_orderkey, ' is done.') WHEN 1 THEN concat('Order ', o_orderkey, ' has a long story that ends here, well within the least and most that a cut text may have, as far as one can tell from it. ', 'And here.') "
    "WHEN 2 THEN concat('Order ', o_orderkey, ' goes', repeat(' onwards', 31), '...') ELSE concat('Order ', o_orderkey, ' is short') END AS snippet".replace('o_orderkey, CASE o_orderkey % 4', 'k AS o_orderkey, CASE k % 4') + " FROM (SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 5, '0') AS o_orderkey FROM orders)",
)
def snippet_cuts(spark, sf_dir):
    """Texts that are short and ended, that end a sentence within bounds, that are cut at a word, and that are short without an end."""
    k, key = F.col("o_orderkey") % 4, F.lpad(F.col("o_orderkey").cast("string"), 5, "0")
    long = F.concat(F.lit("Order "), key, F.lit(" has a long story that ends here,  well within the least and most that a cut text may have, as far as one can tell from it. And here."))
    body = (
        F.when(k == 0, F.concat(F.lit("Order "), key, F.lit("  is done."))).when(k == 1, F.concat(long, F.lit(" " + "x" * 200)))
        .when(k == 2, F.concat(F.lit("Order "), key, F.lit(" goes" + " onwards" * 31 + " and of the onwards" + " more" * 20))).otherwise(F.concat(F.lit("Order "), key, F.lit(" is short")))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", cleaning.cut(body).alias("snippet"))
