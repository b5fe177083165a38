"""The weighted graph: edges, degrees, neighbourhoods and time slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(observations: DataFrame) -> DataFrame:
    """One row for each (src, dst): weight, first and last time, and the flag that was seen last."""
    latest = F.struct("seen", "l_orderkey", "l_linenumber")
    return observations.groupBy("src", "dst").agg(
        F.count("*").alias("weight"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.max_by("flag", latest).alias("state")
    )


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), "weight").union(edges.select("dst", "weight"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))


def hop(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``edges`` that touch ``nodes`` (node), each as often as it is there: two equi joins instead of one with OR."""
    nodes = nodes.select("node").distinct()
    out = edges.join(nodes, edges["src"] == nodes["node"], "left_semi")
    others = edges.join(nodes, edges["src"] == nodes["node"], "left_anti")
    return out.union(others.join(nodes, others["dst"] == nodes["node"], "left_semi"))


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def neighbourhood(edges: DataFrame, centre: DataFrame, hops: int = 2, limit: int | None = None) -> DataFrame:
    """The rows of ``edges`` (src, dst) that touch nodes at most ``hops - 1`` edges away from ``centre`` (node).

    ``edges`` may be single observations, which are then picked before they are added up. ``limit`` keeps, after each hop, the rows of largest ``weight`` (ties by src and dst).
    """
    if hops < 1:
        raise ValueError("hops must be 1 or more")
    nodes = centre.select("node").distinct()
    for k in range(hops):
        found = hop(edges, nodes)
        if limit is not None:
            found = found.orderBy(F.col("weight").desc(), "src", "dst").limit(limit)
        if k + 1 < hops:
            nodes = ends(found).union(nodes).distinct()
    return found


def overlapping(edges: DataFrame, start, end, least_weight: int = 1) -> DataFrame:
    return edges.where((F.col("last_seen") >= F.lit(start)) & (F.col("first_seen") <= F.lit(end)) & (F.col("weight") >= least_weight))
