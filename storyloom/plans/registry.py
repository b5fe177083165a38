"""The register of queries, each with the SQL that says the same, and pieces of SQL that several checks share."""

from __future__ import annotations

from pyspark.sql import Column

from storyloom.functions import scoring, text

QUERIES: dict = {}
SQL: dict = {}

STOP = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")"
ARTICLES = (
    "articles AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS snippet, source AS domain, "
    "CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 5 AS tier, doc_id * 7 AS published_min, concat('http://', source, '/', md5(text)) AS url, text FROM documents)"
)
TOKENS = f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(%s), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN {STOP}))"
EDGES = (
    "obs AS (SELECT concat('c', o_custkey) AS src, concat('s', l_suppkey) AS dst, l_shipdate AS seen, l_returnflag AS flag, l_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey), "
    "edges AS (SELECT src, dst, count(*) AS weight, min(seen) AS first_seen, max(seen) AS last_seen, arg_max(flag, (seen, l_orderkey, l_linenumber)) AS state FROM obs GROUP BY 1, 2)"
)
#: The time that queries take for now, in minutes since the first of January 2024.
NOW_MIN = 1_000_000


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def r4(x: Column) -> Column:
    return scoring.rounded(x, 4)


def bounded(pattern: str) -> str:
    """``pattern`` between ASCII word boundaries, in any case, for engines without lookaround."""
    return f"(?i)(^|[^A-Za-z0-9_])({pattern})([^A-Za-z0-9_]|$)"


REPORTS = (
    "reports AS (SELECT l_orderkey * 8 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN concat(n_name, ' orders ', CAST(floor(l_quantity) AS BIGINT), ' units of ', p_name) "
    "WHEN 1 THEN concat('Flight test of ', p_name, ' at ', n_name, ' Air Base') WHEN 2 THEN concat(p_name, ' inducted: contract worth Rs ', CAST(floor(l_extendedprice) AS BIGINT), ' crore') "
    "ELSE concat('Formerly of ', n_name, ', ', p_name, ' enters trials') END AS title, "
    "concat('Delivery by ', year(l_shipdate) + 25, ' from ', s_name, ', ', CAST(floor(l_discount * 100) AS BIGINT), '% indigenous content.') AS snippet, "
    "concat('src', l_suppkey % 7, '.example.com') AS domain, CAST(l_suppkey % 5 AS INT) AS tier, l_shipdate AS published, p_brand AS program, p_name AS part, n_name AS nation, s_name AS supplier, l_orderkey AS cluster, l_suppkey "
    "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
)
