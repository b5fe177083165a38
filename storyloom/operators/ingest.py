"""Durable ingestion: identities, reuse and lineage of clusters, run ledgers, and upserts with their own rule for each column.

Tables are not updated in place: each function takes the current version and what is new, and returns the next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions.text import canonical_url
from storyloom.operators import merge
from storyloom.sources.shared import Scratch

# What a run may become.
STEPS = ("started", "articles_persisted", "clusters_persisted", "classified", "publishable", "published")
LIFECYCLE = {"provisional": ("active", "deprecated", "merged"), "active": ("deprecated", "merged"), "deprecated": ("active", "merged")}


def plain(text: Column) -> Column:
    """A text in small letters on one line, for digests."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " ")


def article_id(url: Column, owner: Column, published: Column, title: Column, content_hash: Column) -> Column:
    """``article_`` and a digest of the canonical address, or of owner, time, title and content where there is no address."""
    key = F.coalesce(canonical_url(url), F.concat_ws("|", owner, published, plain(title), content_hash))
    return F.concat(F.lit("article_"), F.substring(F.sha2(key, 256), 1, 32))


def content_hash(title: Column, snippet: Column) -> Column:
    return F.sha2(F.concat_ws("\n", plain(title), plain(snippet)), 256)


def event_fingerprint(day: Column, entities: Column, actions: Column, title: Column) -> Column:
    """A digest of what a story tells: day, entities, actions and the first twelve words of the title in order."""
    words = F.filter(F.split(F.regexp_replace(plain(title), r"[^a-z0-9\s-]", " "), r"\s+"), lambda w: F.length(w) > 2)
    parts = F.concat(F.array(F.lit("event-v1"), day), F.array_sort(F.transform(entities, plain)), F.array_sort(actions), F.slice(F.array_sort(words), 1, 12))
    return F.sha2(F.array_join(parts, "|"), 256)


def input_fingerprint(articles: DataFrame, buckets: int = 256) -> DataFrame:
    """(run_id, articles): a digest of all (id, content_hash), whatever their order.

    Articles are digested in ``buckets`` by id first, so that only one line for each bucket meets in one place.
    """
    line = F.concat_ws(":", "id", "content_hash")
    parts = articles.groupBy(F.pmod(F.crc32("id"), F.lit(buckets)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256).alias("d"), F.count("*").alias("n"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "|"), 256)
    return parts.agg(whole.alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("articles")).select(F.concat(F.lit("ingest_"), F.substring("d", 1, 32)).alias("run_id"), "articles")


def reused_ids(clusters: DataFrame, members: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cluster, id) and lineage (predecessor, successor, change) of new clusters, from what their articles and fingerprints were in before.

    ``clusters``: cluster, ord (their order), fingerprint; ``members``: cluster, article, pos; ``prior``: article, prior_id, fingerprint. In order, a cluster takes the first former id of its members that no
    earlier one has claimed, else one of its fingerprint if no member was anywhere, else a new id. Other former ids are merged into it, or split from it if claimed before.

    Claims depend on the order, and one cluster waits for another only if they share a former id: rounds settle all clusters whose first free id no earlier undecided one wants.
    """
    by_article = members.join(prior.where("article IS NOT NULL").groupBy("article").agg(F.max("prior_id").alias("prior_id")), "article").groupBy("cluster", "prior_id").agg(F.min("pos").alias("pos"))
    by_print = clusters.join(by_article.select("cluster").distinct(), "cluster", "left_anti").join(prior.groupBy("fingerprint").agg(F.max("prior_id").alias("prior_id")), "fingerprint").select("cluster", "prior_id", F.lit(0).cast(by_article.schema["pos"].dataType).alias("pos"))
    wants = by_article.union(by_print).join(clusters.select("cluster", "ord"), "cluster")
    scratch = Scratch(clusters.sparkSession)
    keep = lambda df: scratch.written(df, "claims")
    wants = keep(wants)
    left, claims = wants, None
    while left.limit(1).count():
        best = left.groupBy("cluster", "ord").agg(F.min_by("prior_id", F.struct("pos", "prior_id")).alias("prior_id"))
        first = left.groupBy("prior_id").agg(F.min("ord").alias("first"))
        # settled: no earlier undecided cluster wants this id at all
        won = keep(best.join(first, "prior_id").where("ord = first").select("cluster", "prior_id", "ord"))
        claims = won if claims is None else keep(claims.union(won))
        left = keep(left.join(won.select("cluster"), "cluster", "left_anti").join(won.select("prior_id"), "prior_id", "left_anti").select(*wants.columns))
    if claims is None:
        claims = wants.select("cluster", "prior_id", "ord")
    ids = clusters.join(claims.select("cluster", "prior_id"), "cluster", "left").select("cluster", F.coalesce("prior_id", F.concat(F.lit("new_"), F.col("cluster").cast("string"))).alias("id"))
    owner = claims.select("prior_id", F.col("cluster").alias("owner"), F.col("ord").alias("owner_ord"))
    lineage = wants.join(ids, "cluster").where("prior_id <> id").join(owner, "prior_id", "left")
    change = F.when(F.col("owner_ord") < F.col("ord"), "split").otherwise("merge")
    return ids, lineage.select(F.col("prior_id").alias("predecessor"), F.col("id").alias("successor"), change.alias("change"))


def inserted_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those of ``rows`` whose keys it has not; of rows with equal keys the first by all columns."""
    fresh = rows.join(table.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in table.columns if c not in keys]
    fresh = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else fresh.select(*keys).distinct()
    return table.unionByName(fresh)


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], rules: dict[str, merge.Rule], locked: Column | None = None) -> DataFrame:
    return merge.merged(table, rows, keys, rules, locked)


def advanced(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs (run, status, retries, failed_at) after ``events`` (run, seq, kind), which are applied in order: the next version of the ledger.

    ``advance`` goes to the next step, ``fail`` to failed_retryable with the step that failed, and ``resume`` restarts a failed run and counts it. Other events change nothing. A run's events are folded in one ordered array.
    """
    steps = F.array(*map(F.lit, STEPS))
    state = F.struct(F.col("status").alias("status"), F.col("retries").cast("long").alias("retries"), F.col("failed_at").alias("failed_at"))

    def apply(s: Column, e: Column) -> Column:
        at = F.array_position(steps, s["status"]).cast("int")
        return (
            F.when((e["kind"] == "advance") & at.between(1, len(STEPS) - 1), F.struct(F.element_at(steps, F.least(at + 1, F.lit(len(STEPS)))).alias("status"), s["retries"].alias("retries"), F.lit(None).cast("string").alias("failed_at")))
            .when((e["kind"] == "fail") & at.between(1, len(STEPS) - 1), F.struct(F.lit("failed_retryable").alias("status"), s["retries"].alias("retries"), s["status"].alias("failed_at")))
            .when((e["kind"] == "resume") & (s["status"] == "failed_retryable"), F.struct(F.lit("started").alias("status"), (s["retries"] + 1).alias("retries"), F.lit(None).cast("string").alias("failed_at")))
            .otherwise(s)
        )

    ordered = events.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("events"))
    found = runs.join(ordered, "run", "left")
    return found.select("run", F.aggregate(F.coalesce("events", F.array().cast("array<struct<seq: bigint, kind: string>>")), state, apply).alias("s")).select("run", "s.*")


def locks_to_successors(assignments: DataFrame, lineage: DataFrame) -> DataFrame:
    """Assignments (cluster, topic, role, locked) after ``lineage`` (predecessor, successor): locked ones of predecessors are copied to their successors and replace what these have.

    If several predecessors have a lock for a topic, that of the greatest predecessor counts.
    """
    locked = assignments.where("locked").join(lineage, F.col("cluster") == F.col("predecessor"))
    copies = locked.groupBy(F.col("successor").alias("cluster"), "topic").agg(F.max_by("role", "predecessor").alias("role")).withColumn("locked", F.lit(True))
    return assignments.join(copies.select("cluster", "topic"), ["cluster", "topic"], "left_anti").select("cluster", "topic", "role", "locked").union(copies)


def demoted(sources: DataFrame, primary: DataFrame) -> DataFrame:
    """Sources (cluster, article, coverage) with the new primary ones (cluster, article): the former primary of each cluster becomes related."""
    new = primary.select("cluster", F.col("article").alias("_new"))
    found = sources.join(new, "cluster", "left")
    role = F.when(F.col("_new") == F.col("article"), "primary").when(F.col("_new").isNotNull() & (F.col("coverage") == "primary"), "related").otherwise(F.col("coverage"))
    return found.select("cluster", "article", role.alias("coverage"))


def numbered(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
