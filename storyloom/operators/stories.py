"""Similarity of articles, story clusters, and choices within clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions.text import has_word, tokens
from storyloom.operators.similarity import frequencies, rare_first
from storyloom.sources.shared import Scratch

# What happens in a story, by patterns of its text.
ACTIONS = (
    ("TRIAL_TEST", r"flight\s+tests?|test-?fires?|test-?firing|user\s+trials?|sea\s+trials?|weapon\s+trials?|successfully\s+(?:tested|fired|launched|validated)|trials?|tested|tests?|validat(?:es|ed|ing|ion)|launch(?:es|ed|ing)?"),
    ("DAC_PROCUREMENT", r"dac\s+clearance|acceptance\s+of\s+necessity|aon|ccs\s+approval|defence\s+acquisition\s+council|procurement|acquisition|tender|rfp|eoi"),
    ("INDUCTION_COMMISSION", r"commissioned|commissioning|induct(?:s|ed|ing)?|induction|handed\s+over|delivery|delivered|operationali[sz]ed|operationali[sz]ation"),
    ("CONTRACT_DEAL", r"signed\s+contract|deal|orders?|contracts?|agreement|deal\s+worth|crore\s+deal|crore\s+order"),
    ("BORDER_SECURITY", r"lac|loc|standoff|skirmish|border\s+talks|infiltration|deployment|corps\s+commander|line\s+of\s+actual\s+control"),
    ("RND_UPGRADE", r"rollout|prototype|first\s+flight|indigenous\s+engine|upgrade|upgraded|moderni[sz]ation|stealth\s+design"),
    ("CRASH_ACCIDENT", r"crashed?|emergency\s+landing|mishap|court\s+of\s+inquiry|pilot\s+ejected"),
    ("STRATEGIC_EXERCISE", r"joint\s+exercise|war\s+games?|tri-service\s+exercise|milan|tarang\s+shakti|malabar|yudh\s+abhyas|exercise"),
)
#: Least title similarity of two articles that share an entity and an action, an entity, an agency, or nothing.
LEAST = {"platform_action": 0.05, "platform": 0.14, "agency": 0.24, "other": 0.32}


def actions(text: Column) -> Column:
    """The names of the actions that a text tells of, in the order of ``ACTIONS``."""
    return F.filter(F.array(*[F.when(has_word(text, pattern), name) for name, pattern in ACTIONS]), lambda a: a.isNotNull())


def same_story(articles: DataFrame, minutes: int = 48 * 60) -> DataFrame:
    """(a, b) of articles (id, title, published_min, url, entities (name, agency), actions) that tell one story.

    They have the same address without its query; or they are at most ``minutes`` apart and their titles reach the similarity for what they share. Each
    case has a join of its own, so no two articles meet without a reason: on the address, on the entity within a time bucket, or on rare title tokens.
    """
    address = F.lower(F.substring_index(F.coalesce("url", F.lit("")), "?", 1))
    a = articles.select(F.col("id").alias("a"), address.alias("u")).where("u <> ''")
    same = a.join(a.toDF("b", "u"), "u").where("a < b").select("a", "b")
    facts = articles.select("id", tokens(F.col("title")).alias("t"), "published_min", "entities", "actions", F.floor(F.col("published_min") / minutes).alias("bucket"))
    words = facts.select("id", "published_min", F.size("t").alias("n"), "bucket", F.explode("entities.name").alias("e"), "t").select("id", "published_min", "n", "bucket", "e", F.explode("t").alias("token"))
    left = words.select(F.col("id").alias("a"), F.col("published_min").alias("ta"), F.col("n").alias("na"), "e", "token", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = words.select(F.col("id").alias("b"), F.col("published_min").alias("tb"), F.col("n").alias("nb"), "e", "token", "bucket")
    near = left.join(right, ["e", "token", "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= minutes))
    alike = near.groupBy("a", "b", "na", "nb", "e").agg(F.count("*").alias("i")).groupBy("a", "b", "na", "nb").agg(F.max("i").alias("i"))
    alike = alike.select("a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("jaccard")).where(F.col("jaccard") >= min(LEAST.values()))
    of = lambda k: facts.select(F.col("id").alias(k), F.col("entities").alias(f"entities_{k}"), F.col("actions").alias(f"actions_{k}"))
    platform = F.exists("entities_a", lambda x: ~x["agency"] & F.exists("entities_b", lambda y: y["name"] == x["name"]))
    least = F.when(platform & F.arrays_overlap("actions_a", "actions_b"), LEAST["platform_action"]).when(platform, LEAST["platform"]).otherwise(LEAST["agency"])
    sharing = alike.join(of("a"), "a").join(of("b"), "b").where(F.col("jaccard") >= least).select("a", "b")
    return same.union(sharing).union(similar_pairs(articles, LEAST["other"], minutes).select("a", "b")).distinct()


def cluster_documents(articles: DataFrame, cluster: str, weight: Column, social: Column) -> DataFrame:
    """One document for each cluster: primary source (not social, heaviest, newest, least id), members, discussions (its social members), tags and last time.

    The members of one cluster make one nested row, as the document asks for.
    """
    best = F.struct((~social).alias("s"), weight.alias("w"), F.col("published").alias("t"), (-F.col("id")).alias("i"))
    item = F.struct("id", "title", "domain", "tier", "published")
    return articles.groupBy(cluster).agg(
        F.max_by(item, best).alias("primary"), F.collect_list(item).alias("members"), F.collect_list(F.when(social, item)).alias("discussions"), F.array_sort(F.collect_set("part")).alias("tags"), F.max("published").alias("updated_at")
    )


def set_id(tokens: str) -> Column:
    """A name of 16 bytes for a sorted array of tokens, by a digest that no two arrays share in practice."""
    return F.unhex(F.md5(F.array_join(tokens, " ")))


def around(bucket: str) -> Column:
    return F.explode(F.array(F.col(bucket) - 1, F.col(bucket), F.col(bucket) + 1)).alias(bucket)


def met_classes(posts: DataFrame, threshold: float) -> DataFrame:
    """(x, y) of the classes of ``posts`` (set_id, n, at, token, bucket) that meet on a token in a bucket or in the one beside it and may reach ``threshold``."""
    left = posts.select(F.col("set_id").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), "token", around("bucket"))
    right = posts.select(F.col("set_id").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), "token", "bucket")
    lengths = F.least("nx", "ny") >= (threshold - 1e-9) * F.greatest("nx", "ny")
    # for each pair of classes the first token that they share has the least place, so a test of each token's place alone loses none
    rest = 1 + F.least(F.col("nx") - F.col("ax") - 1, F.col("ny") - F.col("ay") - 1)
    met = left.join(right, ["token", "bucket"]).where("x < y").where(lengths & (rest >= (threshold - 1e-9) * (F.col("nx") + F.col("ny") - rest)))
    return met.select("x", "y").distinct()


def similar_pairs(articles: DataFrame, threshold: float = 0.32, minutes: int = 48 * 60) -> DataFrame:
    """(a, b, similarity) of articles within ``minutes`` whose title tokens have a Jaccard similarity of ``threshold`` or more.

    Prefix filtering keeps it lossless and small: tokens are ordered from rare to common, a similar pair shares one of the first tokens of both, and at the place of the first one that they share, what is left
    of both must still reach the threshold. Titles meet in time buckets as wide as the band, the own one and those beside it, so their candidates grow with the articles of a bucket and not with all of time. Articles of
    one bucket with the same tokens are one class; its members are expanded by the time band only.
    """
    base = articles.select("id", "published_min", F.array_sort(tokens(F.col("title"))).alias("tokens"), F.floor(F.col("published_min") / minutes).alias("bucket")).where(F.size("tokens") > 0).withColumn("set_id", set_id("tokens"))
    scratch = Scratch(articles.sparkSession)
    timed = scratch.written(base.select("id", "published_min", "set_id", "bucket"), "timed")
    sets = scratch.written(base.groupBy("set_id").agg(F.first("tokens").alias("tokens")), "sets")
    ordered = rare_first(sets, "set_id", "tokens", frequencies(sets, "tokens"))
    prefix = F.expr(f"slice(ordered, 1, n - cast(ceil(n * {threshold - 1e-9!r}) as int) + 1)")
    posts = ordered.select("set_id", "n", F.posexplode(prefix).alias("at", "token"))
    posts = scratch.written(posts.join(timed.select("set_id", "bucket").distinct(), "set_id"), "posts")
    pairs = met_classes(posts, threshold)
    one, two = sets.toDF("x", "tx"), sets.toDF("y", "ty")
    both = F.size(F.array_intersect("tx", "ty"))
    close = pairs.join(one, "x").join(two, "y").withColumn("similarity", both / (F.size("tx") + F.size("ty") - both)).where(F.col("similarity") >= threshold)
    close = scratch.written(close.select("x", "y", "similarity"), "close")
    close = close.union(close.select("y", "x", "similarity")).union(sets.select("set_id", "set_id", F.lit(1.0)))
    # of all buckets of a class, those near one of the other's
    a = timed.select(F.col("id").alias("a"), F.col("published_min").alias("ta"), F.col("set_id").alias("x"), around("bucket"))
    b = timed.select(F.col("id").alias("b"), F.col("published_min").alias("tb"), F.col("set_id").alias("y"), "bucket")
    return (
        a.join(close, "x")
        .join(b, ["y", "bucket"])
        .where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= minutes))
        .select("a", "b", "similarity")
    )


def settled(labels: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``labels`` (id, label) after as many rounds of ``step`` as it takes until no label changes.

    ``step`` returns (id, label) for all ids and may only lower labels, so the sum of changes ends. Each round is written to the shared folder
    and the one before is deleted, so a lost executor costs one round's tasks and plans do not grow.
    """
    scratch = Scratch(labels.sparkSession)
    now = scratch.written(labels, "labels")
    while True:
        after = scratch.written(step(now).alias("n").join(now.select("id", F.col("label").alias("was")), "id").select("id", "label", "was"), "labels")
        scratch.drop(now)
        now = after
        if not now.where("label <> was").limit(1).count():
            return now.select("id", "label")


def lowest_reached(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, label): the least id from which directed ``edges`` (a, b: from a to b) lead to each of ``ids``, itself included.

    A round takes the least label of the direct sources, then the label of that label, so paths double in length.
    """

    def step(now: DataFrame) -> DataFrame:
        labels = now.select("id", "label")
        near = edges.join(labels, edges["a"] == labels["id"]).groupBy("b").agg(F.min("label").alias("near"))
        found = labels.join(near, labels["id"] == near["b"], "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"))
        far = labels.toDF("label", "far")
        return found.join(far, "label", "left").select("id", F.least("label", F.coalesce("far", "label")).alias("label"))

    return settled(ids.select("id", F.col("id").alias("label")), step)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that edges (a, b) reach in either direction, for the ids that they name.

    Large-star and small-star steps alternate until the edges stay as they are: neighbours above a node move to the least one around it, then a node and its
    smaller neighbours move to the least of them. A hub is aggregated by partial minima and never gathered.
    """
    scratch = Scratch(edges.sparkSession)
    named = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    now, state = scratch.written(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct(), "edges"), None
    while True:
        both = now.union(now.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        joined = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        small = joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).union(joined.select("m", "hi")).where("lo <> hi").distinct()
        before, now = now, scratch.written(small, "edges")
        scratch.drop(before)
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if found == state:
            return named.join(now.select(F.col("hi").alias("id"), F.col("lo").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        state = found


def greedy_stories(articles: DataFrame, threshold: float = 0.32, pairs: DataFrame | None = None) -> DataFrame:
    """(id, story): greedy single link in the order of (published_min, id): an article joins the first story with a similar member, or starts one.

    Stories are in the order of their first members. So an article's story is the earliest article from which links lead to it that all go forward in
    time, which is found by joins of links and labels: no story, however large, is held in one task. ``pairs`` (a, b) are the similar articles if they are known.
    """
    order = articles.select("id", F.struct("published_min", "id").alias("at"))
    pairs = similar_pairs(articles, threshold) if pairs is None else pairs
    linked = pairs.select("a", "b").join(order.toDF("a", "at_a"), "a").join(order.toDF("b", "at_b"), "b")
    forward = linked.select(F.least("at_a", "at_b").alias("a"), F.greatest("at_a", "at_b").alias("b"))
    scratch = Scratch(articles.sparkSession)
    found = lowest_reached(scratch.written(forward, "links"), order.select(F.col("at").alias("id")))
    scratch.close()
    return found.select(F.col("id")["id"].alias("id"), F.col("label")["id"].alias("story"))


def primary_source(members: DataFrame, cluster: str, weight: Column) -> DataFrame:
    """The member of each cluster with the largest weight, then the newest, then the least id."""
    best = F.struct(weight.alias("w"), F.col("published_min").alias("t"), (-F.col("id")).alias("i"))
    return members.groupBy(cluster).agg(F.max_by("id", best).alias("primary_id"), F.count("*").alias("members"))


def scoop_leader(members: DataFrame, cluster: str) -> DataFrame:
    """The domain that published first in each cluster; the least id breaks ties."""
    return members.groupBy(cluster).agg(F.min_by("domain", F.struct("published_min", "id")).alias("leader"), F.countDistinct("domain").alias("domains"))


def ranked(stories: DataFrame, score: str, tie: str) -> DataFrame:
    """Adds ``position`` by falling score, then by ``tie``, which is unique.

    Rows are dealt to ordered ranges of (score, tie), so equal scores are spread, too; a position is the number of rows in earlier ranges plus the
    place in its own. Only the sizes of the ranges meet in one task.
    """
    dealt = stories.repartitionByRange(F.col(score).desc(), F.col(tie)).sortWithinPartitions(F.col(score).desc(), F.col(tie))
    placed = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = Scratch(stories.sparkSession).written(placed, "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    return placed.join(sizes, "_part").withColumn("position", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
