"""The operators of this subpackage as queries over whole tables, with production parameters."""

from __future__ import annotations

import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import audio, chat_format, decontaminate, hard_negatives, language_id, mixing, near_dedup, nearest, quality, sharding, substring_dedup, token_output, whitening
from storyloom.llm._spark import fresh_path
from storyloom.llm.oracles import SQL

__all__ = ["QUERIES", "SQL"]
ARRIVALS = 8


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = json.dumps({"id": -7, "messages": [{"role": r, "content": said} for r in ("user", "assistant")]})
    record = spark.createDataFrame([(extra,)], "record string")
    turns = chat_format.turns_from_table(table(spark, sf_dir, "conversations"))
    turns = turns.unionByName(chat_format.turns_from_records(record).drop("layout"))
    return chat_format.digests(chat_format.format_turns(turns))


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, size=2)


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.summarize(audio.store_texts(table(spark, sf_dir, "documents")))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs)).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(scanned).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ``ARRIVALS`` parts; what the last manifest lists after compaction is read back."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, fresh_path(spark, "shards"), target_bytes=32 << 20)
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
    store.compact()
    store.expire(grace_seconds=0)  # this query is the only writer
    return store.read().select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def incremental_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.col("vec_id") % 100 == 0, positives=5, k=10, low=30, high=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {
    "op1_chat_formatting": chat_formatting,
    "op2_minhash_near_dedup": minhash_near_dedup,
    "op3_media_columns": media_columns,
    "op4_quality_classifier": quality_classifier,
    "op5_language_id": identify_language,
    "op6_benchmark_decontamination": benchmark_decontamination,
    "op7_sharding": shard_compaction,
    "op8_token_ids": token_ids,
    "op9_substring_dedup": incremental_substring_dedup,
    "op10_source_mixing": source_mixing,
    "op11_embedding_whitening": embedding_whitening,
    "op12_nearest_neighbours": nearest_neighbours,
    "op13_hard_negatives": hard_negative_mining,
}
