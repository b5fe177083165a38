"""Counts that add up, the stored text index, gates, facts, streams, markup and answers."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from storyloom.operators import answers, distinct, entities, extraction, gates, markup, search, similarity
from storyloom.operators.text_index import TextIndex
from storyloom.plans import streams
from storyloom.streaming import patterns


@pytest.mark.parametrize("exact", [3, 1000])
def test_runs_add_up_to_one(spark, exact):
    rng = random.Random(1)
    rows = [(f"k{rng.randint(0, 3)}", f"v{rng.randint(0, 400)}" if rng.random() < 0.9 else None, n) for n in range(3000)] + [("none", None, 0), ("few", "a", 1), ("few", "a", 2)]
    df = spark.createDataFrame(rows, "k string, v string, n int")
    whole, table = distinct.distinct_states(df, ["k"], "v", exact), None
    for part in range(4):
        new = distinct.distinct_states(df.where(F.col("n") % 4 == part), ["k"], "v", exact)
        if table is not None:
            j = table.alias("o").join(new.alias("n"), F.col("o.k") == F.col("n.k"), "full_outer")
            values = F.when(F.col("n.k").isNull(), F.col("o.values")).otherwise(distinct.merged_values(F.col("o.values"), F.col("n.values"), F.col("o.k").isNull(), exact))
            new = j.select(F.coalesce("o.k", "n.k").alias("k"), values.alias("values"), distinct.merged_sketches(F.col("o.sketch"), F.col("n.sketch")).alias("sketch"))
        table = new.cache()
    count = distinct.distinct_count(F.col("values"), F.col("sketch")).alias("c")
    got, one = ({r["k"]: r["c"] for r in t.select("k", count).collect()} for t in (table, whole))
    true = {k: len({v for a, v, _ in rows if a == k and v}) for k, *_ in rows}
    assert got == one and got["none"] == 0 and got["few"] == 1
    assert all(abs(got[k] - true[k]) <= (0 if true[k] <= exact else 0.05 * true[k]) for k in true)


def test_text_index(spark):
    texts = [(k, " ".join(random.Random(k).choices("alpha beta gamma delta s 400 ete".split(), k=12)), "s 400" if k % 3 else None) for k in range(40)]
    df = spark.createDataFrame(texts, "id long, a string, b string").select("id", *[search.searchable(F.col(c)).alias(c) for c in "ab"])
    index = TextIndex(spark, ["a", "b"], buckets=8, block=7)
    assert index.search("alpha").count() == 0
    index.add(df.where("id < 25"), "id")
    index.add(df.where("id >= 20"), "id")
    index.delete(df.where("id % 10 = 3"), "id")
    assert TextIndex(spark, ["a", "b"], index.path, 8, 7).segments() == [1, 2, 3]
    queries = ["alpha", "alpha-beta", "S-400", "beta gamma", "gamma-delta alpha", "nowhere", "alpha nowhere", "", None, "***"]
    for merged in (False, True):
        if merged:
            index.merge()
            assert index.segments() == [4]
        for query in queries:
            want = {r["id"] for r in search.found(df.where("id % 10 <> 3"), query, ["a", "b"]).select("id").collect()}
            assert {r["doc"] for r in index.search(query).collect()} == want, (query, merged)
    # only the folders of a query's tokens are read
    plan = index.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*token", plan)
    index.drop()


def test_stop_nodes_and_state(spark):
    names = ["India", "the  Indian Army", "MoD", "Government of India", "L-70 Guns", "Delhi", None, "", " the Navy ", "Raksha Mantralaya", "the military"]
    found = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(extraction.is_stop_node(F.col("n"))).collect()]
    assert found == [True, True, True, True, False, False, True, True, True, True, False]
    rows = [
        ("c1", 0, "2026-08-10", "IAF deploys S-400 Triumf missile in Ladakh", None, "", "u1", ["S-400 Triumf", "Ladakh", "India"], ["#India"]),
        ("c2", 1, "2026-08-12", "Ministry denies reports of S-400 Triumf deployment in Ladakh", None, "", "u2", ["S-400 Triumf", "Ladakh"], ["#ladakh", None]), ("c3", 2, "2026-08-01", "", None, None, "u3", [], []),
    ]
    stories = spark.createDataFrame(rows, "story string, at long, published string, headline string, snippet string, title string, url string, entities array<string>, tags array<string>")
    targets = spark.createDataFrame([(0, "Missile Threat", "missile")], "position long, name string, pattern string")
    named = extraction.candidates(stories, targets).cache()
    edges = {(r["source"], r["predicate"], r["target"]): r for r in extraction.edges(stories, named).collect()}
    one = edges["node_s-400-triumf", "DEPLOYED_TO", "node_ladakh"]
    assert (one["weight"], one["state"], one["first_observed"], one["last_observed"], one["url"]) == (2, "DISPUTED", "2026-08-10", "2026-08-12", "u1")
    nodes = {r["node"]: r for r in extraction.with_degrees(extraction.nodes(stories, named), extraction.edges(stories, named)).collect()}
    assert nodes["node_ladakh"]["mentions"] == 2 and "node_india" not in nodes and nodes["node_missile-threat"]["degree"] == 2


def test_gates_in_order(spark):
    g = gates.Gates("scum", "yoga day", "trials?", "missile", "defen[sc]e", "army")
    rows = [
        (1, "Scum trials missile", None, "official", None), (2, "Yoga day trials", "", "social", "x"), (3, "sea trials", "", "social", None), (4, "Tejas seen", "", "x", "social"), (5, "a missile", "", "social", None), (6, "Tejas", None, "wire", None),
        (7, None, "the missile", "wire", None), (8, "defence of the army", "", "wire", None), (9, "defence of goals", "", "wire", None), (10, "words", "", "wire", "official"), (11, None, None, None, None),
    ]
    items = spark.createDataFrame(rows, "id long, title string, snippet string, feed_tier string, tier string")
    names = spark.createDataFrame([(0, "tejas")], "position long, pattern string")
    found = {r["id"]: (r["gate"], r["relevant"]) for r in gates.gated(items, "id", g, names).collect()}
    want = ["blacklist", "ceremonial", "action", "social_entity", "no_action", "entity", "keyword", "corroborated", "nothing", "tier", "nothing"]
    assert found == {k + 1: (x, x not in ("blacklist", "ceremonial", "no_action", "nothing")) for k, x in enumerate(want)}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Deal worth Rs. 65,400.5 crore for 97 Tejas Mk1A fighter jets by 2027-29", (65400.5, "97 jets", "2027", None)), ("INR 12cr in 2031–2033, 75% IC", (12.0, None, "2031-2033", 75)), ("0 crore", (None, None, None, None)),
        ("ic of 140%", (None, None, None, None)), ("indigenous content of 60%", (None, None, None, 60)), ("", (None, None, None, None)), (None, (None, None, None, None)), ("plan 2026-2030", (None, None, "2026-2030", None)),
    ],
)
def test_facts(spark, text, want):
    facts = entities.metrics(F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in facts.items()]).first()
    assert (row["budget"], row["quantity"], row["timeline"], row["share"]) == want


@pytest.mark.parametrize("text, want", [("target for March 2027", "March 2027"), ("delivery by 2027", "by 2027"), ("from FY26", "FY26"), ("in 2026-27 maybe", "2026-27"), ("scheduled to commence by 2030", "2030"), ("none", None)])
def test_milestone_times(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(entities.milestone_facts(F.col("t"))["timeline"].alias("x")).first()
    assert row["x"] == want


def test_alike_equals_all_pairs(spark):
    rng = random.Random(3)
    sets = [(k, rng.choices("abcdefghij", weights=[9, 9, 9, 5, 4, 3, 2, 1, 1, 1], k=rng.randint(0, 8))) for k in range(80)]
    df = spark.createDataFrame(sets, "k long, tokens array<string>")
    for threshold in (0.14, 0.5, 0.8, 1.0):
        got = {(r["a"], r["b"]): round(r["similarity"], 9) for r in similarity.alike(df.select(F.col("k").alias("a"), "tokens"), df.select(F.col("k").alias("b"), "tokens"), threshold).collect()}
        want = {(x, y): round(len(set(s) & set(t)) / len(set(s) | set(t)), 9) for x, s in sets for y, t in sets if s and t and len(set(s) & set(t)) / len(set(s) | set(t)) >= threshold}
        assert got == want


@pytest.mark.parametrize("files", [1, 3])
def test_first_windows_for_any_split(spark, files):
    rng = random.Random(9)
    rows = [("p", f"m{rng.randint(0, 1)}", rng.randint(0, 30), f"d{rng.randint(0, 2)}", rng.randint(0, 4000)) for _ in range(60)]
    df = spark.createDataFrame(rows, "place string, motif string, cluster long, domain string, h long").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
    stream, base = streams.dealt(df, F.col("h") % files, "windows", files)
    patterns.run(patterns.first_windows(stream, lateness="300 days"), f"{base}/out", f"{base}/state")
    got = {r["motif"]: (r["start_ms"], r["clusters"], r["domains"]) for r in patterns.latest(spark, f"{base}/out", ["place", "motif"]).collect()}
    want = {}
    for motif in ("m0", "m1", "CONVERGENCE"):
        own = sorted((h, c, d) for _, m, c, d, h in rows if motif in (m, "CONVERGENCE"))
        for h, *_ in own:
            inside = [x for x in own if h <= x[0] <= h + 72]
            if len({c for _, c, _ in inside}) >= 3:
                want[motif] = (h * 3_600_000, len({c for _, c, _ in inside}), len({d for *_, d in inside}))
                break
    assert got == want
    # a run that is started again has nothing more to do, and its rows are the same
    patterns.run(patterns.first_windows(stream, lateness="300 days"), f"{base}/out", f"{base}/state")
    assert {r["motif"]: (r["start_ms"], r["clusters"], r["domains"]) for r in patterns.latest(spark, f"{base}/out", ["place", "motif"]).collect()} == want


# --- markup and answers


@pytest.mark.parametrize(
    "dirty, clean",
    [
        ('<script>alert("x")</script><p>Normal text</p><img src="x" onerror="alert(1)">', "<p>Normal text</p>"), ('<svg><script>a</script></svg><iframe src="javascript:alert(1)"></iframe>b', "b"), (None, ""), ("", ""),
        ('<p><strong>MoD</strong> <em>x</em> <a href="https://pib.gov.in">T</a></p>', '<p><strong>MoD</strong> <em>x</em> <a href="https://pib.gov.in">T</a></p>'), ('<a href="javascript:alert(1)">C</a>', "<a>C</a>"), ('<a href=" DATA:text/html,<b>">C</a>', "<a>C</a>"),
        ('<div onmouseover="a" autofocus class="k">Text</div>', '<div class="k">Text</div>'), ("a<!-- b -->c", "ac"), ("<b>open <i>two", "<b>open <i>two</i></b>"), ("</p>x", "x"), ("1 < 2 &amp; &#39;", "1 &lt; 2 &amp; &#39;"), ("<table><tr><td>t</td></tr></table>", "t"),
    ],
)
def test_allow_list(dirty, clean):
    assert markup.sanitize(dirty) == clean and markup.sanitize(clean) == clean


def test_sanitized_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    for r in markup.sanitized(pages.select("page_id", "html"), "html").collect():
        tags = re.findall(r"<(/?)([a-z0-9]+)", r["html"])
        assert {t for _, t in tags} <= markup.TAGS and not re.search(r"<[^>]*\son[a-z]+=|<!--", r["html"])
        opened = [t for end, t in tags if not end and t != "br"]
        assert sorted(opened) == sorted(t for end, t in tags if end) and markup.sanitize(r["html"]) == r["html"]


def test_every_cut_is_repaired():
    full = {"whyItMatters": 'a "q" b\\c\n', "hashtags": ["#a", "b c"], "n": {"x": [1, True, None, 2.5], "y": "z"}, "t": False}
    text = json.dumps(full)
    for k in range(1, len(text) + 1):
        found = json.loads(answers.repaired("Sure: ```json\n" + text[:k]))
        assert set(found) <= set(full)
    assert json.loads(answers.repaired(text + " } and more {")) == full
    assert answers.repaired(None) is None and answers.repaired("none") is None and answers.repaired('{"a": [1,2,], "b": {"c": 1 ], }') == '{"a": [1,2], "b": {"c": 1}}'


def test_fields_are_checked_one_by_one(spark):
    rows = [
        ("ok", '{"whyItMatters":" w ","strategicAngle":null,"gdLecturettePoints":["a",1,""],"primaryTag":"T 1","hashtags":"x","focalEntity":"N/A","operationalTheater":" LAC "}'), ("none", None), ("list", "[1]"), ("bad", '{"whyItMatters": 5}'), ("blank", '{"whyItMatters": "  "}'),
        ("long", json.dumps({"whyItMatters": "x" * 1001})), ("angle", json.dumps({"whyItMatters": "x", "strategicAngle": "y" * 1001, "potentialInterviewQuestions": []})),
    ]
    got = {r["k"]: r for r in answers.checked(spark.createDataFrame(rows, "k string, answer string"), "k").collect()}
    ok = got["ok"]
    assert (ok["why"], ok["angle"], ok["points"], ok["tag"], ok["hashtags"], ok["entity"], ok["theater"], ok["error"]) == ("w", None, ["a"], "#T1", None, None, "LAC", None)
    assert ok["dropped"] == ["gdLecturettePoints[invalid entries]", "hashtags"]
    assert {k: r["error"] for k, r in got.items()} == {"ok": None, "none": "root", "list": "root", "bad": "whyItMatters", "blank": "whyItMatters", "long": "whyItMatters", "angle": None}
    assert got["angle"]["dropped"] == ["strategicAngle"] and got["angle"]["questions"] is None
