"""Queries of repaired answers and of pages by the allow-list."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import answers, markup
from storyloom.plans.registry import query
from storyloom.sources.tables import read

TITLE = "CASE WHEN doc_id % 10 = 9 THEN '  ' ELSE split_part(text, chr(10), 1) END"


@query(
    "salvaged_answers",
    f"WITH d AS (SELECT doc_id, source, lang, {TITLE} AS t FROM documents), e AS (SELECT *, CASE WHEN doc_id % 7 = 6 THEN 'root' WHEN length(trim(t)) = 0 OR length(t) > 1000 THEN 'whyItMatters' END AS error FROM d) "
    "SELECT doc_id, CASE WHEN error IS NULL THEN trim(t) END AS why, CASE WHEN error IS NULL AND doc_id % 4 <> 1 THEN concat('angle ', doc_id) END AS angle, CASE WHEN error IS NULL THEN concat('#', replace(source, ' ', '')) END AS tag, "
    "CASE WHEN error IS NULL THEN concat_ws(',', CASE WHEN length(lang) > 0 THEN concat('#', lang) END, '#two') END AS hashtags, CASE WHEN error IS NULL AND doc_id % 2 = 0 THEN source END AS entity, CASE WHEN error IS NULL THEN CASE WHEN doc_id % 3 = 0 THEN concat('Theater ', doc_id) ELSE concat('Theater ', doc_id, 'xx') END END AS theater, error, "
    "CASE WHEN error IS NULL THEN concat_ws(',', CASE WHEN doc_id % 4 = 1 THEN 'strategicAngle' END, 'hashtags[invalid entries]') ELSE '' END AS dropped FROM e",
)
def salvaged_answers(spark, sf_dir):
    """Answers made of documents, in fences, with text around them, and cut off inside their last value: repaired, then checked field by field."""
    k = F.col("doc_id")
    title = F.when(k % 10 == 9, "  ").otherwise(F.split_part("text", F.lit("\n"), F.lit(1)))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    angle = F.when(k % 4 == 1, F.lit("17")).otherwise(quoted(F.concat(F.lit("angle "), k.cast("string"))))
    whole = F.concat(
        F.lit('{"whyItMatters": '), quoted(title), F.lit(', "strategicAngle": '), angle, F.lit(', "primaryTag": '), quoted(F.col("source")), F.lit(', "hashtags": ['), quoted(F.coalesce("lang", F.lit(""))), F.lit(', "#two", 3], "focalEntity": '),
        F.when(k % 2 == 0, quoted(F.col("source"))).otherwise('"None"'), F.lit(', "operationalTheater": "Theater '), k.cast("string"), F.lit('xx"}'),
    )
    cut = F.when(k % 3 == 0, F.expr("substr(w, 1, length(w) - 4)")).otherwise(F.concat("w", F.lit("\n```\nI hope this } helps")))
    given = F.when(k % 7 == 6, F.lit("I cannot answer.")).otherwise(F.concat(F.lit("Here it is:\n```json\n"), cut))
    rows = read(spark, sf_dir, "documents").withColumn("w", whole).select("doc_id", given.alias("given"))
    found = answers.checked(answers.salvaged(rows, "doc_id", "given"), "doc_id")
    return found.select("doc_id", "why", "angle", "tag", F.array_join("hashtags", ",").alias("hashtags"), "entity", "theater", "error", F.array_join("dropped", ",").alias("dropped"))


@query("sanitized_pages")
def sanitized_pages(spark, sf_dir):
    """All pages by the allow-list: their length, how many tags are left, and a digest. No SQL; tests hold the invariants."""
    found = markup.sanitized(read(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return found.select("page_id", F.length("html").alias("chars"), F.regexp_count("html", F.lit("<[a-z]")).alias("tags"), F.sha2("html", 256).alias("clean_sha"))
