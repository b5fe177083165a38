"""Readers, and adapters that give the contract's tables the shape of articles, threads, graphs and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "orc", "text", "xml")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS feeds: title, link and body; items without a title or a web link are dropped."""
    schema = "title string, link string, guid string, pubDate string, description string"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    link = F.when(F.col("link").rlike("^https?://"), F.col("link")).when(F.col("guid").rlike("^https?://"), F.col("guid"))
    return items.select(F.trim("title").alias("title"), link.alias("url"), F.col("pubDate").alias("published"), F.col("description").alias("snippet")).where(
        "title <> '' AND url IS NOT NULL"
    )


def articles(docs: DataFrame) -> DataFrame:
    """Documents as articles: the first line is the title, the whole text the snippet. ``published_min`` counts minutes since the first of January 2024."""
    tier = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 5
    return docs.select(
        F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("snippet"),
        F.col("source").alias("domain"), tier.alias("tier"), (F.col("doc_id") * 7).alias("published_min"),
        F.concat(F.lit("http://"), "source", F.lit("/"), F.md5("text")).alias("url"),
    )


def edges(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One observation for each order line: customer and supplier nodes."""
    return orders.join(lineitem, orders["o_orderkey"] == lineitem["l_orderkey"]).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.col("l_shipdate").alias("seen"), F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber",
    )


def reports(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Order lines as short articles about a part, a nation and a supplier; those of one order are a cluster."""
    found = (
        lineitem.join(part, lineitem["l_partkey"] == part["p_partkey"])
        .join(supplier, lineitem["l_suppkey"] == supplier["s_suppkey"])
        .join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    )
    whole = lambda x: F.floor(x).cast("string")
    kind = F.col("l_linenumber") % 4
    title = (
        F.when(kind == 0, F.concat("n_name", F.lit(" orders "), whole("l_quantity"), F.lit(" units of "), "p_name"))
        .when(kind == 1, F.concat(F.lit("Flight test of "), "p_name", F.lit(" at "), "n_name", F.lit(" Air Base")))
        .when(kind == 2, F.concat("p_name", F.lit(" inducted: contract worth Rs "), whole("l_extendedprice"), F.lit(" crore")))
        .otherwise(F.concat(F.lit("Formerly of "), "n_name", F.lit(", "), "p_name", F.lit(" enters trials")))
    )
    snippet = F.concat(
        F.lit("Delivery by "), (F.year("l_shipdate") + 25).cast("string"), F.lit(" from "), "s_name", F.lit(", "), whole(F.col("l_discount") * 100), F.lit("% indigenous content.")
    )
    return found.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), title.alias("title"), snippet.alias("snippet"), F.concat(F.lit("src"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".example.com")).alias("domain"),
        (F.col("l_suppkey") % 5).cast("int").alias("tier"), F.col("l_shipdate").alias("published"), F.col("p_brand").alias("program"), F.col("p_name").alias("part"), F.col("n_name").alias("nation"),
        F.col("s_name").alias("supplier"), F.col("l_orderkey").alias("cluster"), "l_suppkey",
    )


def read_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(*[read(spark, sf_dir, name) for name in ("lineitem", "part", "supplier", "nation")])
