"""Pattern dictionaries and alias tries against trying everything."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from storyloom.operators import dictionary, topics


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("trials?", ["tria"]), ("contract|orders", ["contract", "orders"]), (r"air\s+base", ["air "]), ("s-?400", ["s ", "s400"]), ("(?:mk|mark)[- ]?1a?", ["mark", "mk"]), ("[ab]x", ["ax", "bx"]), ("a{2,3}b", ["a"]),
        (r"\d+ km", None), ("x*y", ["x", "y"]), (".foo", None), ("(?:foo)?", None), ("(", None), ("&co", None), (r"\bfoo", ["fo"]), ("f(?:oo|u)bar", ["foobar", "fuba"]), ("", None), ("é", None),
    ],
)
def test_beginnings(pattern, want):
    found = dictionary.beginnings(pattern)
    assert found == want
    if found:
        for text in ("trial trials contracts s-400 s400 mark 1 mk1a ax aab xy y foo fubar foobar air  base orders"):
            for m in re.finditer(dictionary.BOUNDED % pattern, text):
                assert any(re.match(re.escape(k.rstrip()) + ("(?![a-z0-9_])" if k[-1] == " " else ""), m[0].lower()) for k in found)


def test_found_patterns_equal_trying_all(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "s-400", "s400", "mk1", "x9", "d_e", "über", "a", "42", "gamma-ray", "GAMMA ray"]
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for k in range(60)] + [(60, None), (61, ""), (62, "alphabet"), (63, "42alpha")]
    patterns = ["alpha", "bet[ao]", "s-?400", r"gamma[-\s]?ray", "mk1|x9", "d_e", r"\d+", "(?:s|a)", "ber", "e", "alpha (?:beta|a)", "x{1,2}9?", "über"]
    known = spark.createDataFrame([(k, p) for k, p in enumerate(patterns)] + [(99, None)], "position long, pattern string")
    df = spark.createDataFrame(texts, "id long, t string")
    want = {(i, k) for i, t in texts for k, p in enumerate(patterns) if t is not None and re.search(dictionary.BOUNDED % p, t, re.A)}
    assert {tuple(r) for r in dictionary.found_patterns(df, "id", "t", known).collect()} == want
    assert {r["position"] for r in dictionary.keyless(known).collect()} == {6, 12, 99}
    assert dictionary.found_patterns(df, "id", "t", known.where("false")).count() == 0 == dictionary.found_patterns(df.where("false"), "id", "t", known).count()


def test_few_pairs_are_tried(spark):
    """Ten thousand patterns: texts meet those whose words they have."""
    known = spark.range(10_000).select(F.col("id").alias("position"), F.concat(F.lit("w"), F.conv(F.col("id") + 40_000, 10, 36), F.lit("s?")).alias("pattern"))
    texts = known.where("position % 100 = 0").select(F.col("position").alias("id"), F.concat(F.lit("the "), F.expr("substr(pattern, 1, length(pattern) - 2)"), F.lit("S end")).alias("t"))
    found = dictionary.found_patterns(texts, "id", "t", known)
    assert {tuple(r) for r in found.collect()} == {(k, k) for k in range(0, 10_000, 100)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("ArrowEvalPython") == 0


def test_programme_spellings(spark):
    names = [
        (0, ["Project 75I (P-75I)", "Scorpene follow-on/AIP"]), (1, ["LCA Tejas Mk1A", "Tejas-Mk1A"]), (2, ["AMCA"]), (3, ["Zorawar Light Tank", "Zorawar"]), (4, ["X", None, ""]), (5, ["INS A+B"]),
    ]
    df = spark.createDataFrame(names, "position long, names array<string>")
    known = df.select("position", dictionary.programme_pattern(F.col("names")).alias("pattern"))
    assert {r["position"]: r["pattern"] is None for r in known.collect()} == {0: False, 1: False, 2: False, 3: False, 4: True, 5: False}
    texts = [
        (10, "trials for Project  75I submarines", {0}), (11, "team up for P-75I", {0}), (12, "the P75I deal", {0}), (13, "an aip module", {0}), (14, "Tejas Mk1A flies, LCA Tejas   Mk1A too", {1}), (15, "tejasmk1a", {1}),
        (16, "The ramcat and superarjuna", set()), (17, "zorawar", {3}), (18, "INS A+B sails", {5}), (19, "AMCA, Zorawar light tank", {2, 3}), (20, "scorpene followon", {0}),
    ]
    found = dictionary.found_patterns(spark.createDataFrame([t[:2] for t in texts], "id long, t string"), "id", "t", known)
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], set()).add(r["position"])
    assert got == {t[0]: t[2] for t in texts if t[2]}


def test_numerals_in_entity_names(spark):
    names = spark.createDataFrame([(0, "Rudram-II"), (1, "Agni-V"), (2, "ab"), (3, "9M"), (4, "Prithvi-III"), (5, "x" * 61), (6, None)], "position long, name string")
    known = names.select("position", dictionary.entity_pattern(F.col("name")).alias("pattern"))
    assert {r["position"] for r in known.where("pattern IS NULL").collect()} == {2, 3, 5, 6}
    df = spark.createDataFrame([(0, "Rudram-2 and agni5"), (1, "RUDRAM-ii, Agni-V"), (2, "RudramII"), (3, "Rudram-IIIx Agni-VI"), (4, "prithvi3")], "id long, t string")
    assert sorted(map(tuple, dictionary.found_patterns(df, "id", "t", known).collect())) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (4, 4)]


# --- aliases


def tried_one_by_one(rows, text):
    """Every alias's own pattern on the text."""
    body, places = topics.searchable(text)
    plain, found = topics.normal(text), {}
    for topic, alias, kind, terms in rows:
        if terms is None or any(topics.normal(t) in plain for t in terms):
            for m in topics.alias_pattern(alias).finditer(body):
                start, end = places[m.start()], places[m.end() - 1] + 1
                if not topics.incidental(text, start):
                    found.setdefault((topic, start, end), (topic, topics.role(kind, text, start), topics.DIRECT, start, end, "exact"))
    return sorted(found.values(), key=lambda f: (f[0], f[3]))


def test_trie_equals_patterns():
    rng = random.Random(7)
    words = ["uae", "u.a.e", "U-A-E", "new", "delhi", "New-Delhi", "são", "tomé", "l&t", "air", "base", "x", "9", "the", "former", "in", "京都", "straße", "a", "b", "c", "us", "u.s."]
    aliases = ["UAE", "new delhi", "Sao Tome", "L&T", "air base", "air base x", "base", "x 9", "京都", "straße", "a b", "a a", "us", "the", "new", "&", "l&t air", "delhi new delhi", "U.S."]
    rows = [(f"t{k}", a, ("actor", "location", "bilateral_relationship")[k % 3], ["air"] if k % 5 == 4 else None) for k, a in enumerate(aliases)]
    trie = topics.AliasTrie(topics.trie_arrays(rows))
    for _ in range(1500):
        text = "".join(rng.choice(words) + rng.choice([" ", "-", ".", "  ", ", ", " - ", "\n"]) for _ in range(rng.randint(0, 12)))
        assert trie.mentions(text) == tried_one_by_one(rows, text), text


def test_many_aliases_start_fast():
    rows = [(f"t{k}", f"project {k % 1000} alpha {k}", "actor", None) for k in range(200_000)]
    arrays = topics.trie_arrays(rows)
    start = time.perf_counter()
    trie = topics.AliasTrie(arrays)
    assert time.perf_counter() - start < 3  # about 0.5 s where nothing else runs
    start = time.perf_counter()
    found = trie.mentions("Talks on project 17 alpha 3017, not on project 17 alpha 3018. " * 50)
    assert time.perf_counter() - start < 1 and {f[0] for f in found} == {"t3017"} and len(found) == 50
