"""Queries of large dictionaries: patterns, programmes and entities against whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import dictionary
from storyloom.plans.extraction import one_of_each_id
from storyloom.plans.registry import REPORTS, bounded, query
from storyloom.sources.shared import Scratch
from storyloom.sources.tables import read, read_reports

WORD = "[a-z]{4,11}"


def pattern_dictionary(spark, sf_dir):
    """A pattern for each word of four to eleven letters in any document: with endings, with a word after it, or with one of two hyphens in it."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![a-z0-9_])({WORD})(?![a-z0-9_])"), 1)
    found = read(spark, sf_dir, "documents").select(F.explode(F.array_distinct(words)).alias("word")).distinct()
    kind = F.length("word") % 3
    pattern = F.when(kind == 0, F.concat("word", F.lit("(?:s|en)?"))).when(kind == 1, F.concat("word", F.lit(r"\s+(?:der|la|the)"))).otherwise(F.concat(F.lit("(?:"), "word", F.lit("|"), "word", F.lit("[- ]x)")))
    # a position that does not depend on how rows are dealt: the word itself, as a number of 60 bits
    return found.select(F.conv(F.substring(F.md5("word"), 1, 15), 16, 10).cast("long").alias("position"), "word", pattern.alias("pattern"))


WORDS_OF = "regexp_split_to_array(lower(text), '[^a-z0-9_]+')"


@query(
    "pattern_dictionary",
    f"WITH d AS (SELECT doc_id, unnest(list_distinct({WORDS_OF})) AS word FROM documents), k AS (SELECT DISTINCT word FROM d WHERE regexp_full_match(word, '{WORD}')), e AS (SELECT DISTINCT doc_id, word FROM d), "
    "c AS (SELECT doc_id, k.word FROM k JOIN e USING (word) UNION SELECT doc_id, k.word FROM k JOIN e ON e.word = concat(k.word, 's') OR e.word = concat(k.word, 'en')), "
    "m AS (SELECT doc_id, word FROM c JOIN documents USING (doc_id) WHERE CASE length(word) % 3 WHEN 1 THEN regexp_matches(text, concat('(?i)(^|[^A-Za-z0-9_])', word, '\\s+(der|la|the)([^A-Za-z0-9_]|$)')) WHEN 2 THEN list_contains(" + WORDS_OF + ", word) ELSE true END) "
    "SELECT doc_id, count(*) AS patterns, min(word) AS first_word, max(word) AS last_word FROM m GROUP BY 1",
)
def patterns_in_documents(spark, sf_dir):
    """All patterns against all documents: of each document how many it has, and the first and last of their words."""
    known = Scratch(spark).written(pattern_dictionary(spark, sf_dir), "dictionary")
    found = dictionary.found_patterns(read(spark, sf_dir, "documents"), "doc_id", "text", known, "word")
    return found.groupBy("doc_id").agg(F.count("*").alias("patterns"), F.min("word").alias("first_word"), F.max("word").alias("last_word"))


SPELT = "replace(regexp_replace({0}, '\\s+', '\\s+', 'g'), '-', '[-\\s]?')"
NAMED = "CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' (', split_part(p_name, ' ', 2), '-', p_partkey, ')') WHEN 1 THEN concat(split_part(p_name, ' ', 1), '-', p_partkey, '/', p_brand) ELSE concat('Project ', p_partkey) END"


@query(
    "programme_spellings",
    "WITH p AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part WHERE p_size > 0), "
    f"t AS (SELECT o_orderkey, l_linenumber, p_partkey AS k, CASE (o_orderkey + l_linenumber) % 6 WHEN 0 THEN concat('New: ', a, '   ', b, '.') WHEN 1 THEN concat(b, ' ', p_partkey) WHEN 2 THEN concat(upper(a), p_partkey, ' tested') WHEN 3 THEN concat('PROJECT  ', p_partkey) WHEN 4 THEN concat('x', a, '-', p_partkey) ELSE concat(a, '-', p_partkey, 'y') END AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN p ON l_partkey = p_partkey), "
    # each line against its own part's spellings, and against all parts of its two words
    "m AS (SELECT o_orderkey, l_linenumber, p_partkey FROM t JOIN p ON (CASE (o_orderkey + l_linenumber) % 6 WHEN 0 THEN p_partkey % 3 = 0 AND regexp_extract(text, '([a-z]+   [a-z]+)', 1) = concat(a, '   ', b) WHEN 1 THEN p_partkey = k AND p_partkey % 3 = 0 WHEN 2 THEN p_partkey = k AND p_partkey % 3 = 1 WHEN 3 THEN p_partkey = k AND p_partkey % 3 = 2 ELSE false END)) "
    "SELECT o_orderkey, l_linenumber, count(*) AS programmes, min(p_partkey) AS first_programme FROM m GROUP BY 1, 2",
)
def programme_spellings(spark, sf_dir):
    """Order lines that spell parts in several ways against all parts as programmes: names with brackets, with slashes and with numbers."""
    part = read(spark, sf_dir, "part").where("p_size > 0")
    a, b, key = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 3
    name = F.when(kind == 0, F.concat("p_name", F.lit(" ("), b, F.lit("-"), key, F.lit(")"))).when(kind == 1, F.concat(a, F.lit("-"), key, F.lit("/"), "p_brand")).otherwise(F.concat(F.lit("Project "), key))
    programmes = part.select(F.col("p_partkey").alias("position"), dictionary.programme_pattern(F.array(name)).alias("pattern"))
    turn = (F.col("o_orderkey") + F.col("l_linenumber")) % 6
    text = F.when(turn == 0, F.concat(F.lit("New: "), a, F.lit("   "), b, F.lit("."))).when(turn == 1, F.concat(b, F.lit(" "), key)).when(turn == 2, F.concat(F.upper(a), key, F.lit(" tested"))).when(turn == 3, F.concat(F.lit("PROJECT  "), key))
    text = text.when(turn == 4, F.concat(F.lit("x"), a, F.lit("-"), key)).otherwise(F.concat(a, F.lit("-"), key, F.lit("y")))
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    # lines of one text name the same, so each text is looked up once; lines that repeat their numbers count together
    lines = lines.select("o_orderkey", "l_linenumber", text.alias("text"))
    of_text = dictionary.found_patterns(lines.select("text", F.col("text").alias("body")).distinct(), "text", "body", programmes).groupBy("text").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    return lines.join(of_text, "text").groupBy("o_orderkey", "l_linenumber").agg(F.sum("n").alias("programmes"), F.min("first").alias("first_programme"))


CATEGORIES = (("TRIALS", "trials?", ("tech",)), ("Contract", "contract|orders", ("procurement", "tenders")), ("Base", r"air\s+base", ("airforce",)), ("Seven", r"NATION_(?:7|17)", ()))
FOUND = "list_concat(" + ", ".join(f"CASE WHEN regexp_matches(title, '{bounded(p)}') THEN {list(c)} ELSE [] END" if c else "[]" for _, p, c in CATEGORIES) + ")"


@query(
    "classified_reports",
    f"WITH {REPORTS}, t AS (SELECT id, title, {FOUND} AS c, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(title, '{bounded(p)}') THEN '{n}' END" for n, p, _ in CATEGORIES) + ") AS entities FROM (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY id ORDER BY title, snippet, published, domain, part, nation) = 1)) "
    "SELECT id, entities, concat(array_to_string(CASE WHEN len(c) > 0 THEN c WHEN regexp_matches(lower(title), 'army|troop|soldier') THEN ['army'] WHEN regexp_matches(lower(title), 'navy|ship|submarine|maritime') THEN ['navy'] WHEN regexp_matches(lower(title), 'air force|iaf|aircraft|jet') THEN ['airforce'] "
    "WHEN regexp_matches(lower(title), 'defence|defense|military|mod|armed forces|drdo|weapon|missile|ammunition') AND regexp_matches(lower(title), 'procurement|deal|crore|order|contract|acquisition|tender') THEN ['procurement'] ELSE ['strategic'] END, ','), ',ssb') AS categories FROM t",
)
def classified_reports(spark, sf_dir):
    """Reports with what they name and their categories, by a dictionary with categories and the fallback for the rest."""
    rows = [(k, n, p, list(c)) for k, (n, p, c) in enumerate(CATEGORIES)]
    known = spark.createDataFrame(rows, "position long, name string, pattern string, categories array<string>")
    found = dictionary.classified(one_of_each_id(read_reports(spark, sf_dir)).select("id", "title"), "id", "title", known)
    return found.select("id", F.array_join("entities", ",").alias("entities"), F.array_join("categories", ",").alias("categories"))
