"""Operators that SQL does not express, and awkward inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from storyloom.functions import scoring, text
from storyloom.operators import graph, merge, rows, stories, threads
from storyloom.sources import tables
from storyloom.streaming import events as streaming

ARTICLE = "id long, title string, published_min long, domain string"


def test_fnv_known_answers(spark):
    found = spark.createDataFrame([("abc",), (" ABC ",), ("",)], "t string").select(text.stable_hash(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in found] == ["1a47e90b", "1a47e90b", "811c9dc5"]


@pytest.mark.parametrize("body,want", [("It was withdrawn.", "RETRACTED"), ("x denied y", "DISPUTED"), ("revised", "SUPERSEDED"), ("unverified", "CONTESTED"), ("deniedx", "CONFIRMED"), (None, "CONFIRMED")])
def test_epistemic_states(spark, body, want):
    assert spark.createDataFrame([(body,)], "t string").select(text.epistemic_state(F.col("t"))).first()[0] == want


def test_urls(spark):
    url = "HTTP://Example.COM:80/a/?b=2&utm_source=x&a=1#frag"
    found = spark.createDataFrame([(url,), ("ftp://x/y",)], "u string").select(text.canonical_url(F.col("u"))).collect()
    assert [r[0] for r in found] == ["http://example.com/a?a=1&b=2", None]


def test_scores(spark):
    one = spark.range(1).select(scoring.recency(F.lit(4.0)), scoring.recency(F.lit(-1.0)), scoring.source_count(F.lit(9)), scoring.reputation(F.lit(10), F.lit(9), F.lit(9), F.lit(50)), scoring.reputation(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    assert tuple(one.first()) == (50.0, 100.0, 100, 1.3, 1.0)


def brute_pairs(articles, threshold=0.32, minutes=2880):
    tokens = {i: {w for w in t.split() if len(w) > 2} for i, t, _, _ in articles}
    times = {i: m for i, _, m, _ in articles}
    out = set()
    for a in tokens:
        for b in tokens:
            if a < b and abs(times[a] - times[b]) <= minutes and tokens[a] & tokens[b] and len(tokens[a] & tokens[b]) / len(tokens[a] | tokens[b]) >= threshold:
                out.add((a, b))
    return out


def some_articles(n=120):
    import random

    rng = random.Random(4)
    names = [f"word{k}" for k in range(14)]
    return [(k, " ".join(rng.sample(names, rng.randint(2, 6))), rng.randint(0, 6000), f"d{k % 3}") for k in range(n)]


def test_pairs_and_greedy_stories(spark):
    data = some_articles()
    df = spark.createDataFrame(data, ARTICLE)
    want = brute_pairs(data)
    assert {(r["a"], r["b"]) for r in stories.similar_pairs(df).collect()} == want
    groups = []
    for i, _, _, _ in sorted(data, key=lambda r: (r[2], r[0])):
        home = next((g for g in groups if any((min(i, x), max(i, x)) in want for x in g)), None)
        groups.append([i]) if home is None else home.append(i)
    found = {r["id"]: r["story"] for r in stories.greedy_stories(df).collect()}
    assert found == {x: g[0] for g in groups for x in g}


def test_components(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4)], "a long, b long")
    assert dict(stories.components(df).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_paging_walks_all_rows(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(20)], "a int, id int")
    seen, after = [], None
    while True:
        part = [tuple(r) for r in rows.page(df, [("a", False), ("id", True)], after, 6).collect()]
        seen += part[:6]
        if len(part) <= 6:
            break
        after = seen[-1]
    assert seen == sorted(((k % 3, k) for k in range(20)), key=lambda r: (-r[0], r[1]))


def test_empty_inputs(spark):
    df = spark.createDataFrame([], ARTICLE)
    assert stories.similar_pairs(df).count() == 0
    assert rows.one_per_key(df, ["domain"], [F.col("id")]).count() == 0
    assert rows.matching(df).count() == 0
    assert graph.degrees(spark.createDataFrame([], "src string, dst string, weight long")).count() == 0


def test_violations_and_freshness(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 2.0)], "id int, x double")
    assert [r["id"] for r in rows.violations(df, F.col("x") <= 1).collect()] == [2, 3]
    assert [r["id"] for r in rows.fresh(df, F.col("x"), 1).collect()] == [1, 2]


def test_merge_rules_and_locks(spark):
    old = spark.createDataFrame([(1, 5, "a", True), (2, 5, "b", False)], "k int, n int, s string, locked boolean")
    new = spark.createDataFrame([(1, 1, "x", False), (2, 1, "y", False), (3, 1, None, False)], "k int, n int, s string, locked boolean")
    rules = {"n": merge.add, "s": merge.replace}
    assert sorted(map(tuple, merge.merged(old, new, ["k"], rules, F.col("o.locked")).collect())) == [(1, 5, "a"), (2, 6, "y"), (3, 1, None)]
    state = dict(merge.reconciled(old, new.where("k > 1"), "k").collect())
    assert state == {1: "missing", 2: "present", 3: "unreferenced"}


def test_breaker(spark):
    df = spark.createDataFrame([(1, t, e) for t, e in enumerate("eeeoee")], "user_id int, ts int, e string")
    assert tuple(threads.breaker_states(df, "user_id", "ts", "ts", F.col("e") == "e", 2).first()) == (1, 2, 3, True)


def test_feeds(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><link>http://x/1</link></item><item><title>B</title><link>no</link></item><item><title></title><link>http://x/2</link></item></channel></rss>")
    assert [(r["title"], r["url"]) for r in tables.feed_items(spark, str(tmp_path)).collect()] == [("A", "http://x/1")]


def event_rows():
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    return [(1, at(0), 1, "error", 1.0, ""), (1, at(0), 1, "error", 1.0, ""), (2, at(5), 1, "error", 1.0, ""), (3, at(70), 2, "view", 1.0, "")]


def test_streams(spark, tmp_path):
    spark.createDataFrame(event_rows(), streaming.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.read_events(spark, str(tmp_path / "in"))
    streaming.append_to(streaming.deduplicated(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    query = streaming.circuit_breaker(stream, 3).writeStream.format("memory").queryName("breaker").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("breaker").collect()} == {(1, 3, True), (2, 0, False)}
    for name, df in (("s", streaming.sessions(stream)), ("w", streaming.windowed(stream, "1 hour", "30 minutes"))):
        query = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(name).count() > 0
