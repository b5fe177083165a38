"""Operators that SQL does not express, and the cases in which older forms lost rows, against plain versions."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from storyloom.functions import cleaning, text
from storyloom.operators import entities, folds, graph, ingest, rows, search, stories, threads, topics
from storyloom.sources import feeds
from storyloom.sources.versions import VersionedTable, scratch


def test_pages_keep_rows_with_nulls(spark):
    data = [(None if k % 4 == 0 else k % 3, k) for k in range(20)]
    df = spark.createDataFrame(data, "a int, id int")
    for up in (True, False):
        seen, after = [], None
        while True:
            part = [tuple(r) for r in rows.page(df, [("a", up), ("id", True)], after, 3).collect()]
            seen += part[:3]
            if len(part) <= 3:
                break
            after = seen[-1]
        first = (lambda r: (r[0] is not None, r[0] or 0, r[1])) if up else (lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        assert seen == sorted(data, key=first)


def test_hops_are_as_many_as_asked_for(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}", 1) for k in range(6)], "src string, dst string, weight long")
    centre = spark.createDataFrame([("n0",)], "node string")
    for hops in (1, 2, 3, 4):
        assert {r["dst"] for r in graph.neighbourhood(chain, centre, hops).collect()} == {f"n{k}" for k in range(1, hops + 1)}
    with pytest.raises(ValueError):
        graph.neighbourhood(chain, centre, 0)
    loop = spark.createDataFrame([("n0", "n0", 5), ("n0", "x", 1)], "src string, dst string, weight long")
    assert graph.neighbourhood(loop, centre, 2).count() == 2
    assert [r["dst"] for r in graph.neighbourhood(loop, centre, 1, limit=1).collect()] == ["n0"]


def test_components_of_a_long_chain(spark):
    ids = list(range(60))
    random.Random(2).shuffle(ids)
    found = dict(stories.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect())
    assert found == dict.fromkeys(ids, 0)


def test_greedy_stories_of_one_title(spark):
    """All titles are alike and one after the other within the time band: one story through the whole chain."""
    df = spark.createDataFrame([(k, "same words here", k * 2000, "d") for k in range(30)], "id long, title string, published_min long, domain string")
    assert {r["story"] for r in stories.greedy_stories(df).collect()} == {0}


def test_ranks_with_equal_scores(spark):
    data = [(k, k % 3) for k in range(200)]
    found = stories.ranked(spark.createDataFrame(data, "id long, s long").repartition(7), "s", "id")
    want = {k: n + 1 for n, (k, _) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])))}
    assert {r["id"]: r["position"] for r in found.collect()} == want


def test_dense_windows_match_counting(spark):
    rng = random.Random(5)
    base = datetime.datetime(2024, 1, 1)
    data = [(rng.choice("ab"), base + datetime.timedelta(minutes=rng.randint(0, 4000)), rng.randint(0, 6)) for _ in range(150)]
    found = {r["k"]: (r["start_at"], r["members"]) for r in threads.dense_windows(spark.createDataFrame(data, "k string, ts timestamp_ntz, m int"), "k", "ts", "m", 2, 4).collect()}
    want = {}
    for k, start, _ in sorted(data, key=lambda r: (r[0], r[1])):
        n = len({m for x, at, m in data if x == k and start <= at <= start + datetime.timedelta(hours=2)})
        if n >= 4:
            want.setdefault(k, (start, n))
    assert found == want
    assert threads.dense_windows(spark.createDataFrame([], "k string, ts timestamp_ntz, m int"), "k", "ts", "m", 2, 1).count() == 0


# --- folds


def plain_milestones(items):
    kept = []
    words = lambda t: {w for w in re.split(r"\W+", t.lower()) if len(w) > 3}
    for x in sorted(items, key=lambda m: (-m["day"], m["id"])):
        x = x | {"from_id": x["id"], "merged": 1}
        for k, m in enumerate(kept):
            if (x["url"] and x["url"] == m["url"]) or (abs(x["day"] - m["day"]) <= 30 and len(words(x["title"]) & words(m["title"])) >= 2):
                canon = m if m["official"] else x if x["official"] else m if m["tier"] <= x["tier"] else x
                new = canon | {f: next((y[f] for y in (canon, m, x) if y[f] is not None), None) for f in folds.FACTS}
                kept[k] = new | {"status": canon["status"] if canon["status"] != "general" else x["status"], "from_id": m["from_id"], "merged": m["merged"] + 1}
                break
        else:
            kept.append(x)
    return {(m["from_id"], m["id"], m["day"], m["budget"], m["timeline"], m["share"], m["status"], m["merged"]) for m in kept}


def test_milestones_merge_as_by_hand(spark):
    rng = random.Random(3)
    words = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot"]
    names = ["id", "key", "day", "title", "url", "official", "tier", "budget", "timeline", "share", "status"]
    data = [
        (k, f"e{k % 3}", rng.randint(0, 200), " ".join(rng.sample(words, 3)), rng.choice(["", "u1", f"v{k}"]), rng.random() < 0.3, rng.randint(0, 4), rng.choice([None, 5.0, 7.0]), rng.choice([None, "2030-31"]), rng.choice([None, 60.0]), rng.choice(["general", "trials"]))
        for k in range(90)
    ]
    df = spark.createDataFrame(data, "id long, key string, day int, title string, url string, official boolean, tier int, budget double, timeline string, share double, status string")
    found = {tuple(r[c] for c in ("from_id", "id", "day", "budget", "timeline", "share", "status", "merged")) for r in folds.milestones_merged(df, "key").collect()}
    want = set().union(*[plain_milestones([dict(zip(names, r)) for r in data if r[1] == key]) for key in ("e0", "e1", "e2")])
    assert found == want
    assert folds.milestones_merged(df.where("false"), "key").count() == 0


def test_breaker_is_tried_again_after_its_cooldown(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    data = [(1, at(0), 1, True), (2, at(1), 1, True), (3, at(2), 1, False), (4, at(3), 1, True), (5, at(4), 1, True), (6, at(29), 1, True), (7, at(60), 1, False)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, k long, bad boolean")
    found = {r["event_id"]: (r["state"], r["failures"]) for r in folds.breaker(df, "k", "ts", "event_id", F.col("bad"), 2).collect()}
    assert found == {1: ("CLOSED", 1), 2: ("OPEN", 2), 3: ("CLOSED", 0), 4: ("CLOSED", 1), 5: ("OPEN", 2), 6: ("OPEN", 3), 7: ("CLOSED", 0)}


# --- ingestion


def test_input_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(f"a{k}", f"h{k}") for k in range(50)], "id string, content_hash string")
    one, other = ingest.input_fingerprint(df).first(), ingest.input_fingerprint(df.orderBy(F.rand(1)).repartition(5)).first()
    assert one == other and one["articles"] == 50
    assert ingest.input_fingerprint(df.where("id <> 'a3'")).first()["run_id"] != one["run_id"]
    lines = {}
    for k in range(50):
        import zlib

        lines.setdefault(zlib.crc32(f"a{k}".encode()) % 256, []).append(f"a{k}:h{k}")
    digests = [hashlib.sha256("|".join(sorted(v)).encode()).hexdigest() for _, v in sorted(lines.items())]
    assert one["run_id"] == "ingest_" + hashlib.sha256("|".join(digests).encode()).hexdigest()[:32]


def test_identities_are_claimed_in_order(spark):
    rng = random.Random(8)
    prior = {f"a{k}": f"p{rng.randint(0, 12)}" for k in range(60)}
    clusters = [(c, c, f"f{c % 5}") for c in range(40)]
    members = [(c, f"a{rng.randint(0, 80)}", pos) for c in range(40) for pos in range(rng.randint(0, 3))]
    prints = {f"f{k}": max(p for a, p in prior.items() if int(a[1:]) % 5 == k) for k in range(5)}
    claimed, ids, lineage = set(), {}, set()
    for c, _, fp in clusters:
        own = sorted((m for m in members if m[0] == c), key=lambda m: m[2])
        wants = list(dict.fromkeys(prior[a] for _, a, _ in own if a in prior)) or [prints[fp]]
        free = next((p for p in wants if p not in claimed), None)
        ids[c] = free or f"new_{c}"
        lineage |= {(p, ids[c], "split" if p in claimed else "merge") for p in wants if p != ids[c]}
        claimed.add(ids[c])
    rows_ = [(a, p, f"f{int(a[1:]) % 5}") for a, p in prior.items()]
    got, changes = ingest.reused_ids(
        spark.createDataFrame(clusters, "cluster long, ord long, fingerprint string"), spark.createDataFrame(sorted(members, key=lambda m: (m[0], m[2])), "cluster long, article string, pos long"),
        spark.createDataFrame(rows_, "article string, prior_id string, fingerprint string"),
    )
    assert dict(got.collect()) == ids
    assert {tuple(r) for r in changes.collect()} == lineage


def test_versions_are_published_and_pruned(spark):
    table = VersionedTable(spark, f"{scratch(spark)}/versions-test")
    with pytest.raises(ValueError):
        table.read()
    for n in (1, 2, 3):
        assert table.publish(spark.range(n)) == n
    assert table.read().count() == 3 and table.read(1).count() == 1
    assert table.prune(1) == 2 and table.versions() == [3] and table.read().count() == 3


# --- texts and topics


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("raw,want", [("&#65;&#x42;&#0;c &amp;lt;", "ABc &lt;"), ("<![CDATA[x]]> &nbsp;", "x"), ("&#xD800;a", "a"), ("", ""), (None, None)])
def test_entities_decode(spark, raw, want):
    assert one(spark, cleaning.decode_entities(F.lit(raw).cast("string"))) == want


def test_cut_texts(spark):
    long = "word " * 100
    assert one(spark, cleaning.cut(F.lit(long))) == ("word " * 56).strip() + "..."
    assert one(spark, cleaning.cut(F.lit("a b. " * 40), 100, 50)) == ("a b. " * 20).strip()
    assert one(spark, cleaning.cut(F.lit("It goes to the"))) == "It goes..." and one(spark, cleaning.cut(F.lit(None).cast("string"))) == ""


def test_stable_hash_counts_utf16_units(spark):
    def plain(t):
        h = 0x811C9DC5
        for b in memoryview(t.encode("utf-16-le")).cast("H"):
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        return f"{h:08x}"

    for t in ("abc", "é", "a😀b", ""):
        assert one(spark, text.stable_hash(F.lit(t))) == plain(t)


def test_topic_spans_in_marked_texts(spark):
    aliases = spark.createDataFrame([("t1", "Sao Tome", "actor", None, False), ("t2", "UAE", "actor", None, False), ("t3", "Base X", "facility", ["flight test"], False), ("t4", "gone", "actor", None, True)], "topic string, alias string, topic_type string, terms array<string>, rejected boolean")
    body = "Talks in São-Tomé; attacks against U.A.E. there. A flight test at Base X: former guests. gone"
    df = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "Base X alone"), (5, "previously Sao Tome")], "id long, text string")
    found = {(r["id"], r["topic"]): (r["role"], body[r["start"] : r["end"]]) for r in topics.mentions(df, aliases).collect()}
    assert found == {(1, "t1"): ("location", "São-Tomé"), (1, "t2"): ("target", "U.A.E"), (1, "t3"): ("facility", "Base X")}
    assert topics.context_terms('{"requiredTerms": ["a"]}') == ["a"] and topics.context_terms("{") == [] and topics.context_terms(None) == []


def test_names_meet_by_their_words(spark):
    texts = spark.createDataFrame([(1, "The MQ-9B/Predator flew"), (2, "mq 9b"), (3, None)], "id long, t string")
    names = spark.createDataFrame([("MQ-9B",), ("Predator",), ("",), ("9B flew",)], "name string")
    assert {tuple(r) for r in entities.mentions_of_names(texts, "id", "t", names).collect()} == {(1, "MQ-9B"), (2, "MQ-9B"), (1, "Predator")}
    with pytest.raises(ValueError):
        entities.tagged(texts, "t", [("n", "p")] * 65)


def test_search_phrases(spark):
    assert search.phrases('S-400 "Été"\x00 ***') == ["s 400", "ete"] and search.phrases(None) == [] and len(search.phrases("a " * 99)) == 10
    df = spark.createDataFrame([(1, "The S-400, été", None), (2, "s 4001 ete", "x"), (3, "été", "s.400")], "id long, a string, b string")
    ready = df.select("id", *[search.searchable(F.col(c)).alias(c) for c in "ab"])
    assert {r["id"] for r in search.found(ready, "S-400 ete", ["a", "b"]).collect()} == {1, 3}
    assert search.found(ready, "***", ["a", "b"]).count() == 0


def test_first_by_either_key(spark):
    rng = random.Random(1)
    data = [(k, rng.randint(0, 15), rng.randint(0, 15)) for k in range(80)]
    kept, a, b = set(), set(), set()
    for k, x, y in data:
        if x not in a and y not in b:
            kept.add(k)
            a.add(x)
            b.add(y)
    found = search.first_by_either(spark.createDataFrame(data, "k long, x long, y long"), ["k"], "x", "y")
    assert {r["k"] for r in found.collect()} == kept


def test_feeds_of_odd_forms(spark, tmp_path):
    xml = [
        "<rss><item><title>A &#38; b</title><link>javascript:x</link><guid>http://x/1</guid><media:description>m</media:description><media:thumbnail url='http://x/t.png'/></item><item><title/></item></rss>",
        "<feed><entry><title><![CDATA[B]]></title><link rel='self' href='http://x/2'/><published>2024-01-02T03:04:05Z</published><content>c #Tag #tag</content></entry></feed>",
        None, "", "no feed",
    ]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xml)], "k int, xml string")
    now = F.lit("2020-01-01").cast("timestamp")
    found = [tuple(r) for r in feeds.feed_items(df, "xml", now).select("k", "title", "url", "body", "thumbnail", "tags", F.year("published")).orderBy("k").collect()]
    assert found == [(1, "B", "http://x/2", "c #Tag #tag", "", ["Tag"], 2024)]
    assert feeds.feed_items(df, "xml", now, most=10).count() == 0
    (tmp_path / "a").write_bytes(b"x" * 10)
    (tmp_path / "b").write_bytes(b"x" * 100)
    sizes = {r["path"][-1]: r["content"] for r in feeds.capped_files(spark, str(tmp_path), 50).collect()}
    assert bytes(sizes["a"]) == b"x" * 10 and sizes["b"] is None
