"""Dossiers, conflicts and lookups on small rows with nulls and ties."""

from pyspark.sql import functions as F

from storyloom.operators import dossier

MILESTONE = "k string, day int, id int, official boolean, budget double, timeline int, share double, status string"


def test_dossier_and_conflicts(spark):
    data = [
        ("a", 1, 1, False, 5.0, 2030, None, "old"), ("a", 2, 2, True, 7.0, 2031, 0.5, None), ("a", 2, 3, True, 9.0, None, None, None),
        ("a", 3, 4, False, None, 2032, None, None), ("a", 4, 5, None, 1.0, 2031, None, None), ("b", 1, 6, False, 3.0, None, None, "new"), ("c", 1, 7, True, None, None, None, None),
    ]
    df = spark.createDataFrame(data, MILESTONE)
    found = {r["k"]: tuple(r)[1:] for r in dossier.synthesized(df, "k", ["day", "id"], F.col("official")).collect()}
    assert found == {"a": (5, 7.0, 2031, 0.5, None), "b": (1, 3.0, None, None, "new"), "c": (1, None, None, None, None)}
    conflicts = dossier.timeline_conflicts(df, "k", ["day", "id"], F.col("official")).select("id", "official_timeline").collect()
    assert {tuple(r) for r in conflicts} == {(1, 2031), (4, 2031)}
    assert dossier.synthesized(df.where("false"), "k", ["day", "id"], F.col("official")).count() == 0


def test_first_match_prefers_earlier_keys_and_ignores_nulls(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", "t"), (3, "z", "t"), (4, None, None)], "id int, url string, title string")
    others = spark.createDataFrame([(9, "x", "t", 90), (2, None, "t", 80), (8, "y", None, 70), (7, "y", None, 60)], "id int, url string, title string, hit int")
    found = dossier.first_match(df, others, ["id", "url", "title"], "hit").select("id", "hit").collect()
    assert dict(map(tuple, found)) == {1: 90, 2: 80, 3: 80, 4: None}


def test_symmetric_links_and_overlaps(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (2, 4)], "a int, b int")
    assert {tuple(r) for r in dossier.both_ways(links, "a", "b").collect()} == {(1, 2), (2, 1), (2, 4), (4, 2)}
    texts = spark.createDataFrame([(1, ["p", "q", "q"]), (2, []), (3, None)], "id int, t array<string>")
    topics = spark.createDataFrame([(5, ["q"]), (4, ["q"]), (6, ["p", "q"])], "topic int, t array<string>")
    found = dossier.best_overlaps(texts, topics, "id", "topic", "t", 2).select("id", "topic", "shared", "position").collect()
    assert {tuple(r) for r in found} == {(1, 6, 2, 1), (1, 4, 1, 2)}
