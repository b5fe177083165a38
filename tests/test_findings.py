"""What a reviewer found on odd inputs and larger tables."""

import datetime
import pathlib
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from storyloom.operators import continuity, dictionary, entities, extraction, folds, rows, search, stories, threads
from storyloom.operators.text_index import TextIndex
from storyloom.plans import catalog, streams
from storyloom.streaming import patterns


def at(text):
    return datetime.datetime.fromisoformat(text)


def test_freshness_counts_whole_seconds(spark, tmp_path):
    data = [(1, 1, at("2024-01-17T23:59:59.500000")), (2, 1, at("2024-01-18T00:00:00.500000")), (3, 1, None)]
    spark.createDataFrame(data, "event_id long, user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    assert {r["event_id"] for r in catalog.QUERIES["freshness_filter"](spark, str(tmp_path)).collect()} == {2, 3}


def test_silence_counts_whole_seconds(spark):
    data = [(1, 1, at("2024-01-01T00:00:00.900000")), (2, 1, at("2024-01-01T10:00:01.100000")), (3, 1, at("2024-01-01T20:00:01.900000"))]
    df = spark.createDataFrame(data, "event_id long, user_id long, ts timestamp_ntz")
    assert threads.reactivations(df, "user_id", "ts", "event_id", 36000).first()["reactivations"] == 1


def test_first_of_both(spark):
    # y's first row gives way to x's, and y's second row does not come in its place; copies count once
    data = [(1, 5, "x"), (1, 5, "x"), (2, 5, "y"), (3, 6, "y"), (1, 7, "z"), (1, 7, "w")]
    found = search.first_of_both(spark.createDataFrame(data, "age long, id long, title string"), ["age", "id"], "id", "title")
    assert sorted(map(tuple, found.select("id", "title").collect())) == [(5, "x"), (7, "w")]


def test_likeness_by_kinds(spark):
    # each event has a token of its own, so all sets are unlike; their kinds are few
    rng = random.Random(3)
    data = [(f"t{k % 2}", k, [f"own{k}", *rng.sample("abcd", rng.randint(0, 3))] if k % 9 else list("ab")) for k in range(150)] + [("t0", 900, []), ("t2", 901, ["x"])]
    df = spark.createDataFrame(data, "thread string, story long, tokens array<string>")
    sets = df.select("thread", F.col("story").cast("string").alias("c"), F.col("tokens").alias("t"))
    assert continuity.kinds_of(sets)[1].count() <= 40
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    for thread, story, value in continuity.mean_likeness(df).collect():
        own = next(set(t) for h, s, t in data if (h, s) == (thread, story))
        others = [set(t) for h, s, t in data if h == thread and s != story]
        assert abs(value - (sum(like(own, o) for o in others) / len(others) if others else 0.0)) < 1e-9


def test_titles_meet_in_their_time_alone(spark):
    posts = spark.createDataFrame([(bytes([k]), 3, 0, "often", k * 2) for k in range(50)] + [(b"x", 3, 1, "often", 9), (b"y", 3, 2, "often", 9)], "set_id binary, n int, at int, token string, bucket long")
    # one bucket apart; what is left of y's members after the token cannot reach it
    assert {(bytes(x), bytes(y)) for x, y in stories.met_classes(posts, 0.6).collect()} == set()
    assert {(bytes(x), bytes(y)) for x, y in stories.met_classes(posts, 0.5).collect()} == {(bytes([4]), b"x"), (bytes([5]), b"x")}
    data = [(k, f"alpha beta own{k}", k * 3000, "d") for k in range(30)] + [(100, "alpha beta more", 1500, "d")]
    df = spark.createDataFrame(data, "id long, title string, published_min long, domain string")
    assert {(r["a"], r["b"]) for r in stories.similar_pairs(df).collect()} == {(0, 100), (1, 100)}


def test_patterns_meet_on_their_rarest_word(spark):
    known = spark.range(200).select(F.col("id").alias("position"), F.concat(F.lit(r"project\s+"), (F.col("id") + 1000).cast("string"), F.lit(r"|red[-\s]?"), (F.col("id") + 1000).cast("string")).alias("pattern"))
    # no key is that of all patterns: each has its number, joined or apart
    assert dictionary.keyed(known).groupBy("key").count().agg(F.max("count")).first()[0] == 1
    texts = [(0, "PROJECT  1003 and red1004"), (1, "Red-1005"), (2, "projects 1003, 1004"), (3, "red 10033"), (4, "PROJECT -1003"), (5, "redK 1003")]
    found = dictionary.found_patterns(spark.createDataFrame(texts, "id long, t string"), "id", "t", known)
    assert sorted(map(tuple, found.collect())) == [(0, 3), (0, 4), (1, 5)]
    assert dictionary.choices("a{2}[^x]") is None or all(dictionary.choices("a{2}[^x]"))


def test_names_meet_on_their_rarest_word(spark):
    names = spark.createDataFrame([(f"Supplier#{k}",) for k in range(300)], "name string")
    found = entities.mentions_of_names(spark.createDataFrame([(1, "from supplier 7 and Supplier#12"), (2, "supplier")], "id long, t string"), "id", "t", names)
    assert {tuple(r) for r in found.collect()} == {(1, "Supplier#7"), (1, "Supplier#12")}
    keys = [r["_word"] for r in spark.read.parquet(next(iter(f for f in found.inputFiles() if "/names-" in f)).rsplit("/", 1)[0]).collect()]
    assert "supplier" not in keys and len(set(keys)) == 300


def test_alternatives_are_looked_for_once(spark):
    cut = {"a|b": ["a", "b"], "(?:a|b c)": ["a", "b c"], "(a|b)c": ["(a|b)c"], "(?:a|b)(?:c|d)": ["(?:a|b)(?:c|d)"], r"x[|]y\||z|z": [r"x[|]y\|", "z"], r"(a)\1|b": [r"(a)\1|b"], "(?-i:a|b)|c": ["(?-i:a|b)|c"], "[]|]": ["[]|]"], "a)|(b": ["a)|(b"]}
    assert {p: dictionary.alternatives(p) for p in cut} == cut
    names = [(k, f"Red box (box-{k})") for k in range(300)]
    known = spark.createDataFrame(names, "position long, word string").withColumn("pattern", dictionary.programme_pattern(F.array("word")))
    met = dictionary.rarest(dictionary.alternatives_of(known).select("pattern").distinct())
    # of 300 programmes, a text of a red box meets one alternative instead of all; a number has those with and without the name before it
    assert met.groupBy("key").count().agg(F.max("count")).first()[0] == 2 and met.where("key IN ('red ', 'box ')").count() == 1
    texts = [(0, "New: red   BOX."), (1, "box 7"), (2, "the box-8"), (3, "Red box (box-9) of box10"), (4, "redbox 5x"), (5, None)]
    found = dictionary.found_patterns(spark.createDataFrame(texts, "id long, word string"), "id", "word", known, "word")
    got = sorted((r["id"], r["position"]) for r in found.collect())
    assert got == sorted([(t, k) for t in (0, 3) for k in range(300)] + [(1, 7), (2, 8)])
    assert {r["word"] for r in found.where("id = 2").collect()} == {"Red box (box-8)"}


def test_words_beside_a_key_leave_few_windows(spark):
    known = spark.createDataFrame([(k, f"w{k}x(?:-|\\s)+(?:der|la)") for k in range(20)] + [(20, "w1x y?z w2x"), (21, "w3x?"), (22, "w4x, [0-9]+")], "position long, pattern string")
    texts = [(0, "w1x der w1x la W2X- -la w3x w4x, 17 w5xder"), (1, "w1x yz w2x der"), (2, "w1x z"), (3, "w1x z w2x"), (4, "w3 w6x lam w7x-der")]
    found = dictionary.found_patterns(spark.createDataFrame(texts, "id long, t string"), "id", "t", known)
    want = {(i, r["position"]) for r in known.collect() for i, t in texts if re.search(dictionary.BOUNDED % r["pattern"], t, re.A)}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 6
    around = spark.createDataFrame(texts, "id long, t string").select(F.explode(dictionary._windows(F.col("t"), 0, 1, [(1, 0, ["la "])])).alias("x"))
    assert sorted(tuple(r["x"]) for r in around.collect()) == [("w1x", "w1x la W2X"), ("w2x", "W2X- -la w3x")]


def test_near_duplicate_names_are_classes(spark, tmp_path):
    spark.createDataFrame([(1, "Red box"), (2, "red-BOX"), (3, "redbox"), (4, "blue"), (5, None), (6, None)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.QUERIES["near_duplicate_names"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 0), (5, 5, 0), (6, 6, 0)]


def test_near_duplicate_names_are_all_pairs(spark, tmp_path):
    spark.createDataFrame([(1, "Red box"), (2, "red-BOX"), (3, "redbox"), (4, "blue"), (5, None), (6, None)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.QUERIES["near_duplicate_names"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(2, 1), (3, 1), (3, 2)]
    # a key of many rows is dealt to blocks that all meet once
    many = spark.range(30).select("id", F.when(F.col("id") < 25, "x").otherwise("y").alias("name"))
    pairs = [tuple(r) for r in rows.pairs_of_equals(many, "name", "id", paired=4).collect()]
    assert len(pairs) == len(set(pairs)) == 25 * 24 // 2 + 5 * 4 // 2 and all(a > b for a, b in pairs)


def test_postings_are_read_as_they_stand(spark):
    index = TextIndex(spark, ["a"], buckets=2, block=100)
    rows = spark.range(0, 1000).select("id", F.concat(F.lit(" in "), F.col("id").cast("string"), F.lit(" in ")).alias("a"))
    index.add(rows.where("id < 600"), "id")
    index.add(rows.where("id >= 500"), "id")
    index.merge()
    stored = spark.read.parquet(f"{index.path}/postings/segment=3")
    assert stored.where("token = 'in'").count() == 10 and stored.agg(F.max(F.array_max("docs"))).first()[0] == 99
    assert {(r["doc"], tuple(r["places"])) for r in index.postings(["in"]).collect()} == {(k, (0, 2)) for k in range(1000)}
    # no running sums over what a posting holds
    assert "aggregate(" not in index.postings()._jdf.queryExecution().optimizedPlan().toString().lower().replace("aggregate [", "")


def test_candidates_come_out_of_their_row(spark):
    rows = [(1, "", "of the navy", "t", ["Red", "RED", "", None, "x"], ["#red", None, "#blue-2", "#Blue-2", "#news"]), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "story long, headline string, snippet string, title string, entities array<string>, tags array<string>")
    few = spark.createDataFrame([(0, "red", "navy"), (1, "None", "army")], "position long, name string, pattern string")
    many = few.union(spark.range(20).select(F.col("id") + 9, F.lit("z"), F.concat(F.lit("zz"), F.col("id").cast("string"))))
    # named as it stands last, ranked as it stands first; of tags the first counts, and a noise tag is only cleaned
    want = {((0, 0), "red"), ((0, 4), "x"), ((2, 2), "Blue-2"), ((2, 4), "News")}
    for targets in (few, many):
        found = extraction.candidates(df, targets)
        assert {(tuple(r["rank"]), r["name"]) for r in found.collect()} == want
    # rows dealt by story stay where they are
    assert "Exchange" not in extraction.candidates(df, few)._jdf.queryExecution().executedPlan().toString()


def test_edges_compare_turns(spark):
    rows = [(k, at, f"h{k}", "", "", f"u{k}", k % 1000, ["Red tank", "Red valley"], []) for k, at in ((-9, 5), (9, 4), (7, None), (2**62, 5), (-(2**62), 4))]
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, "story long, at long, headline string, snippet string, title string, url string, published long, entities array<string>, tags array<string>").withColumn("story", F.col("story").cast(kind))
        targets = spark.createDataFrame([(0, "n", "none")], "position long, name string, pattern string")
        one = extraction.edges(df, extraction.candidates(df, targets)).first()
        last = max([r for r in rows if r[1] == 5], key=lambda r: r[0] if kind == "long" else str(r[0]))
        assert (one["weight"], one["story"], one["url"], one["first_observed"], one["context"]) == (5, 7 if kind == "long" else "7", "u7", 7, last[2])


def test_patterns_are_tried_near_their_key(spark):
    assert [dictionary.most_words(p) for p in ("word(?:s|en)?", r"a\s+(?:b|c d)", "foo.*bar", "a(?=b)", "(?:a b)*", "[9-A]x", "[0-9]{2,}")] == [1, 3, None, None, None, 2, 1]
    patterns = [r"k\d\s+end", r"red\s", "x[- ]k1", "k2.*k5", "k3 a b", "k4(?:s|)", "k5[^a]", "_k6", r"a\s+b\s+k7 c", "k8 d"]
    known = spark.createDataFrame(list(enumerate(patterns)), "position long, pattern string")
    pieces = ["k1", "K2", "k3", "k4s", "k5", "_k6", "k7", "red", "x", "a", "b", "c", "end", "k8", "d", "K4"]
    rng = random.Random(7)
    texts = [(k, "".join(rng.choice(pieces) + rng.choice([" ", "  ", "-", "\n", ", ", " é"]) for _ in range(rng.randint(0, 30)))) for k in range(150)] + [(900, "red"), (901, "red red"), (902, "red  "), (903, "k8 do"), (904, "k8 d"), (905, "")]
    found = dictionary.found_patterns(spark.createDataFrame(texts, "id long, t string"), "id", "t", known)
    want = {(i, k) for i, t in texts for k, p in enumerate(patterns) if re.search(dictionary.BOUNDED % p, t, re.A)}
    assert sorted(map(tuple, found.collect())) == sorted(want) and {k for _, k in want} >= {0, 1, 3, 5, 6, 7, 9}


def test_state_holds_the_first_window_alone(spark):
    """Sightings behind a first window are dropped as they come, and a late one still moves the window to an earlier start."""

    class State:
        def __init__(self, value=None):
            self.value = value

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value if self.value is not None else iter(())

        def put(self, rows):
            self.value = list(rows)

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, []

        def getListState(self, name, schema):
            return self.states.setdefault(name, State())

        getValueState = getListState

        def registerTimer(self, at):
            self.timers.append(at)

    class Timers:
        def getCurrentWatermarkInMs(self):
            return 0

    hour = 3_600_000
    window = patterns.FirstWindow(72, 3)
    handle = Handle()
    window.init(handle)
    frame = lambda hours: pd.DataFrame([(h * hour, h, "d") for h in hours], columns=["at", "cluster", "domain"])
    out = [r for f in window.handleInputRows(("p", "m"), iter([frame(range(1000, 3000)), frame(range(3000, 5000))]), Timers()) for r in f.itertuples(index=False)]
    assert [tuple(r)[2:5] for r in out] == [(1000 * hour, 73, 1)]
    assert len(handle.states["seen"].value) == 73
    out = [r for f in window.handleInputRows(("p", "m"), iter([frame([990, 1500])]), Timers()) for r in f.itertuples(index=False)]
    assert [tuple(r)[2:5] for r in out] == [(990 * hour, 64, 1)]
    assert len(handle.states["seen"].value) == 64
    assert not list(window.handleInputRows(("p", "m"), iter([frame([2000])]), Timers()))


def test_each_turn_of_a_stream_is_written_by_several_tasks(spark):
    df = spark.range(0, 4000, 1, 8).withColumn("k", F.col("id") % 4)
    stream, base = streams.dealt(df, F.col("k"), "dealt")
    assert len(spark.read.schema(df.schema).parquet(f"{base}/in").inputFiles()) > 4
    seen = []
    stream.writeStream.foreachBatch(lambda batch, number: seen.append({r["k"] for r in batch.select("k").distinct().collect()})).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    assert seen == [{0}, {1}, {2}, {3}]


def test_names_are_cleaned_once(spark):
    """Each spelling counts once, the first as it stands; the rules are written into the plan once, not anew for each name's place."""
    rows = [(["Tejas", "TEJAS ", None, "#army-base"], "tejas", ["x", "Army-Base", "  ", "News", "Tejas Mk1"]), (None, None, None), ([], "#", ["Ä", "ÄÖ", "äö", "#-a", "-#news", "# news"])]
    df = spark.createDataFrame(rows, "p array<string>, f string, e array<string>")
    names = continuity.canonical_entities(F.col("p"), F.col("f"), F.col("e"))
    assert [r[0] for r in df.select(names).collect()] == [["Tejas", "Army-Base", "Tejas Mk1"], [], ["ÄÖ", "-#news"]]
    plan = df.select(names.alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("breakingnews") == 1


def test_milestones_look_at_near_ones_alone(spark, monkeypatch):
    """Over many months, a row is compared with the milestones that are still near, and with older ones by address; the result is that of trying all in order."""
    rng = random.Random(4)
    titles = ["alpha bravo charlie", "alpha bravo delta", "delta echo foxtrot", "echo foxtrot golf hotel", "one two"]
    rows = [(k, "x", rng.randint(0, 900), rng.choice(titles), rng.choice(["", "", "u1", "u2", f"v{k % 40}"]), rng.random() < 0.3, rng.randint(0, 4), None, None, rng.choice([None, 1.0, 2.0]), rng.choice(["general", "trials"])) for k in range(400)]
    names = ["id", "key", "day", "title", "url", "official", "tier", "budget", "timeline", "share", "status"]
    kept = []
    for row in sorted(rows, key=lambda r: (-r[2], r[0])):
        x = dict(zip(names, row)) | {"from": row[0], "merged": 1}
        words = lambda m: {w for w in m["title"].split() if len(w) > 3}
        for k, m in enumerate(kept):
            if (abs(m["day"] - x["day"]) <= 30 and len(words(m) & words(x)) >= 2) or (x["url"] and x["url"] == m["url"]):
                canon = m if m["official"] else x if x["official"] else m if m["tier"] <= x["tier"] else x
                share = next((y["share"] for y in (canon, m, x) if y["share"] is not None), None)
                kept[k] = canon | {"share": share, "status": canon["status"] if canon["status"] != "general" else x["status"], "from": m["from"], "merged": m["merged"] + 1}
                break
        else:
            kept.append(x)
    df = spark.createDataFrame(rows, "id long, key string, day int, title string, url string, official boolean, tier int, budget double, timeline string, share double, status string")
    found = {(r["from_id"], r["id"], r["day"], r["share"], r["status"], r["merged"]) for r in folds.milestones_merged(df, "key").collect()}
    assert found == {(m["from"], m["id"], m["day"], m["share"], m["status"], m["merged"]) for m in kept}
    # rows of many months, of which none is near an older one: each looks at the few of its own month alone
    calls = []

    class Words(set):
        def __and__(self, other):
            calls.append(1)
            return set.__and__(self, other)

    monkeypatch.setattr(folds, "_words", lambda title: Words(title.split()))
    steps = []
    monkeypatch.setattr(folds, "fold", lambda rows, keys, order, step, schema, last: steps.append(step))
    folds.milestones_merged(df, "key")
    state = None
    for k in range(1000):
        state, _ = steps[0](state, (k, "x", 40_000 - 10 * k, f"t{k} a{k}", "", False, 1, None, None, None, "general"))
    assert len(calls) <= 4000


def test_implications_read_each_text_once(spark):
    """Implications count what all texts of a key say; texts pass through Python once, and their bodies are not shuffled."""
    from storyloom.operators import topics

    aliases = spark.createDataFrame([("t1", "alpha", "actor", None, False), ("t2", "bravo", "actor", None, False)], "topic string, alias string, topic_type string, terms array<string>, rejected boolean")
    rules = spark.createDataFrame([("t1", "t9", ["t1", "t2"], []), ("t2", "t8", ["t2"], ["military"]), ("t1", "t2", ["t1"], [])], "source string, implied string, actors array<string>, events array<string>")
    rows = [(1, "Alpha and bravo"), (1, "the navy"), (2, "an alpha"), (3, "army of bravo"), (4, None), (None, "alpha, bravo, army"), (5, "navy")]
    df = spark.createDataFrame(rows, "id long, text string")
    found = topics.implied(df, aliases, rules, "id")
    assert {(r["id"], r["topic"], r["start"]) for r in found.collect()} == {(1, "t9", 0), (1, "t8", 10), (2, "t2", 3), (3, "t8", 8)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_cluster_topics_read_each_report_once(spark, small):
    from storyloom.plans import catalog

    assert catalog.QUERIES["cluster_topics"](spark, small)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_words_that_begin_no_alias_are_passed_over():
    from storyloom.operators import topics

    trie = topics.AliasTrie(topics.trie_arrays([("t1", "new delhi", "actor", None), ("t2", "UAE", "actor", None)]))
    assert trie.first == {"new", "u", "ua", "uae"}
    assert [m[0] for m in trie.mentions("The U.A.E. met in New-Delhi; delhi, ae, new")] == ["t1", "t2"]
    assert topics.incidental("Long ago. In \u017fome hi\u017ftorical \u212aa UAE", 30) and not topics.incidental("The UAE. A former one", 4)


def test_entities_and_feeds_need_no_python(spark):
    """Numeric entities are decoded natively, in all their forms, and no field of a feed's items is worked out by Python."""
    from storyloom.functions import cleaning
    from storyloom.sources import feeds

    rows = [(1, "A&#65;&#x42;&#X43; &#0;&#xD800;&#x110000;&#128512;&#65279;.&#12345678901; &#;&#38;lt;b&gt; &# &"), (2, None), (3, ""), (4, "<b>x</b> &amp;#65; <![CDATA[a<i>b]]>"), (5, "plain &lt;"), (6, "a<script>b</script><b")]
    df = spark.createDataFrame(rows, "k long, t string").select("k", cleaning.decode_entities(F.col("t")).alias("d"), cleaning.plain_text(F.col("t")).alias("p"))
    found = {r["k"]: (r["d"], r["p"]) for r in df.collect()}
    first = "AAB&#X43; \U0001f600\ufeff.&#12345678901; &#;<b> &# &"
    assert found == {1: (first, first), 2: (None, None), 3: ("", ""), 4: ("<b>x</b> &#65; a<i>b", "x &#65; b]]>"), 5: ("plain <", "plain <"), 6: ("a<script>b</script><b", "a")}
    xml = "<item><TITLE>A &amp; B</TITLE><link>https://x/1</link><Dc:Date>2001-02-03</Dc:Date></item><item><title></title><link>https://x/2</link></item>"
    items = feeds.feed_items(spark.createDataFrame([(1, xml)], "k long, xml string"), "xml", F.lit("2002-01-01").cast("timestamp"))
    assert [(r["title"], r["url"], str(r["published"])[:10]) for r in items.collect()] == [("A & B", "https://x/1", "2001-02-03")]
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()


def test_threads_are_matched_by_kinds(spark):
    """Rows that repeat a cluster's entity count once, and clusters are shuffled once, whatever they match."""
    clusters = spark.createDataFrame([(1, "a b c d", list("abcd"), ["p"])] * 3 + [(2, "a x", ["a", "x"], ["p", "q"]), (2, "e", ["e"], ["p"]), (3, "e", ["e"], [])], "cluster long, entity string, words array<string>, tokens array<string>")
    threads = spark.createDataFrame([("t1", "a x y", ["a", "x", "y"], ["p", "q", "r"]), ("t2", "e", ["e"], [])], "thread string, entity string, words array<string>, tokens array<string>")
    found = entities.matched_threads(clusters, threads)
    assert found._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(cluster") == 1
    assert {tuple(r) for r in found.collect()} == {(2, "t2", 1.0, 1), (2, "t1", 0.9, 2), (3, "t2", 1.0, 1)}


def test_all_searches_take_one_pass(spark, small):
    assert catalog.QUERIES["story_search"](spark, small)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_facts_are_looked_for_once(spark):
    """Facts as by looking for each group in the whole text, in small and large letters; patterns are tried only on texts that can have them."""
    texts = [
        "Rs. 1,200.5 CRORE for 12 new big fighter JETS by 2027-29", "₹ 5 and 3 tanks", "x₹90 cr", "in 2031–2035, 20% ic. 99% IDDM", "indigenous content of 130%", "40 % local content, 45% local content", "target for 2030", "7 guns 8 missile systems in 2040-41",
        "delivery by 2026-2030", "INR 0 cr", "", None, "1 a b c d e units", "2 a-b c_d units of 3 tanks", "2029-2031", "100 crs in March 2026", "5% indigenous 2,0 cr",
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    t, some = F.col("t"), lambda c: F.nullif(c, F.lit(""))
    get = lambda p, k=1: some(F.regexp_extract(t, p, k))
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    span = lambda p: F.when(t.rlike(p), F.concat_ws("-", get(p), get(p, 2)))
    budget, share, own = number(F.coalesce(*[get(entities.BUDGET, k) for k in (1, 2, 3)])), F.coalesce(*[get(p) for p in entities.SHARES]).try_cast("int"), get(entities.MILESTONE_SHARE).try_cast("int")
    plain = [
        F.when(budget > 0, budget), F.when(t.rlike(entities.THINGS), F.concat_ws(" ", get(entities.THINGS), F.lower(get(entities.THINGS, 2)))), F.coalesce(span(entities.BY_YEAR), span(entities.YEARS)), F.when(share <= 100, share),
        number(get(entities.MILESTONE_BUDGET)), some(F.trim(F.regexp_extract(t, entities.MILESTONE_TIME, 1))), F.when(own <= 100, own),
    ]
    facts = [*entities.metrics(t).values(), *entities.milestone_facts(t).values()]
    rows = df.select("t", F.array(*[c.cast("string") for c in facts]).alias("found"), F.array(*[c.cast("string") for c in plain]).alias("wanted")).collect()
    assert [(r["t"], r["found"]) for r in rows] == [(r["t"], r["wanted"]) for r in rows]
    plan = df.select(*facts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan or "contains(" in plan.lower()


def test_postings_are_shuffled_once(spark):
    index = TextIndex(spark, ["a", "b"], buckets=4, block=100)
    rows = spark.range(0, 700).select("id", F.concat(F.lit(" in "), F.col("id").cast("string"), F.lit(" in ")).alias("a"), F.when(F.col("id") % 2 == 0, " in  x ").alias("b"))
    index.add(rows, "id")
    index.add(rows.where("id % 7 = 0").withColumn("a", F.lit(" out ")), "id")
    index.delete(rows.where("id % 5 = 0"), "id")
    before = sorted(r[0] for r in index.search("in x").collect())
    # the blocks of the documents that are gone are known without postings
    gone = {(r["segment"], 100 * r["block"] + k) for r in index.gone().collect() for k in range(100) if r["bits"][k // 64] >> k % 64 & 1}
    assert gone == {(1, k) for k in range(700) if k % 5 == 0 or k % 7 == 0} | {(2, k) for k in range(0, 700, 35)}
    index.merge()
    index.expire()
    assert index.segments() == [4] and len(list(pathlib.Path(index.path.removeprefix("file://"), "postings").iterdir())) == 1
    want = {("in", 0, k, (0, 2)) for k in range(700) if k % 5 and k % 7} | {(str(k), 0, k, (1,)) for k in range(700) if k % 5 and k % 7} | {("out", 0, k, (0,)) for k in range(0, 700, 7) if k % 5}
    want |= {(w, 1, k, (p,)) for k in range(0, 700, 2) if k % 5 for p, w in enumerate(["in", "x"])}
    assert {(r["token"], r["field"], r["doc"], tuple(r["places"])) for r in index.postings().collect()} == want
    assert sorted(r[0] for r in index.search("in x").collect()) == before


def test_patterns_look_at_what_is_not_behind_a_dense_span(spark, monkeypatch):
    rng, seen, plain = random.Random(11), [], threads.dense_windows
    monkeypatch.setattr(threads, "dense_windows", lambda events, *a: seen.append(events.count()) or plain(events, *a))
    start = at("2024-01-01T00:00:00")
    rows = [(rng.randint(0, 300), f"p{k % 3}", rng.choice(["a", "b", None]), f"d{k % 2}", start + datetime.timedelta(minutes=rng.randint(0, 500_000))) for k in range(3000)]
    # a place that never has three clusters in three days, and rows without a cluster or a time
    rows += [(k % 2, "lone", "a", "d0", start + datetime.timedelta(hours=k)) for k in range(500)] + [(None, "p0", "a", "d0", start), (1, "p0", "a", "d0", None)]
    found = entities.patterns(spark.createDataFrame(rows, "cluster long, place string, motif string, domain string, ts timestamp_ntz"))
    want = {}
    for place, motif in {(r[1], m) for r in rows for m in (r[2], "CONVERGENCE")}:
        mine = [r for r in rows if r[1] == place and motif in (r[2], "CONVERGENCE") and r[4] is not None]
        for t in sorted(r[4] for r in mine if r[0] is not None):
            inside = [r for r in mine if t <= r[4] <= t + datetime.timedelta(hours=72)]
            if len({r[0] for r in inside} - {None}) >= 3:
                if motif is not None:
                    want[place, motif] = (t, len({r[0] for r in inside} - {None}), len({r[3] for r in inside}))
                break
    assert {(r["place"], r["motif"]): (r["start_at"], r["clusters"], r["domains"]) for r in found.where("motif IS NOT NULL").collect()} == want and len(want) == 9
    # the lone place's 500 rows, of each motif and of all, and few of the others' 6,000
    assert 1000 <= seen[0] < 1600


def test_stories_of_a_kind_are_taken_once(spark):
    rng = random.Random(3)
    names, texts = ["Red tank", "RED tank", "Delhi valley", "Army", "red-tank", "", None, "Navy mission"], ["it is stationed there", "sea trials of the air base", "a deal", "", None]
    rows = [(k, rng.choice([5, 6, None]), None if k % 9 == 0 else k % 70, None, rng.choice(texts), "t", rng.choices(names, k=2), [rng.choice(["#Fort-x", "#red tank", None])]) for k in range(600)]
    df = spark.createDataFrame(rows, "story long, at long, published long, headline string, snippet string, title string, entities array<string>, tags array<string>").withColumn("url", F.lit("u"))
    few = spark.createDataFrame([(0, "Base", r"air\\s+base"), (1, "Deal", "deals?")], "position long, name string, pattern string")
    for kind in ("long", "string"):
        for targets in (few, few.union(spark.range(20).select(F.col("id") + 9, F.lit("z"), F.concat(F.lit("zz"), F.col("id").cast("string"))))):
            stories_ = df.withColumn("story", F.col("story").cast(kind))
            named = extraction.candidates(stories_, targets)
            want = extraction.with_degrees(extraction.nodes(stories_, named), extraction.edges(stories_, named))
            got = extraction.nodes_with_degrees(stories_, targets)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        alike = extraction.kinds(df, few)
        assert alike.count() < 600 and alike.agg(F.sum("n")).first()[0] == 600


def test_audit_finds_tokens_of_loose_events_once(spark):
    events = spark.createDataFrame([("a", k, f"Talks {k % 3} on red box", None, ["x"]) for k in range(9)] + [("b", 1, "Red talks", None, ["Red"])], "thread string, story long, headline string, summary string, entities array<string>")
    found = continuity.audit(events.withColumn("thread", F.when(F.col("thread") == "a", "--").otherwise("b")), spark.createDataFrame([("--", "--"), ("b", "Red")], "thread string, entity string"))
    assert all(r["valid"] for r in found.collect()) and found.count() == 10
    assert any("/audit-loose-" in f for f in found.inputFiles())
