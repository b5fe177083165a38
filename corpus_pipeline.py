"""A corpus pipeline of five operators: language ID, near-dedup, decontamination, mixing and token output.

Each stage takes the documents that the one before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import decontaminate, language_id, mixing, near_dedup, token_output
from storyloom.llm._spark import WHOLE, discard, fresh_path, whole
from storyloom.llm.queries import table, tokenizer_path


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, each row as it is.

    Rejected is what the network has nothing to go by: null, empty and letterless texts, which ``predict`` calls undetermined. Every text with letters gets a
    language of the network, so no clean text goes. Where no row has a language to learn from, there is no network, and texts with letters stay.
    """
    model = language_id.fit(docs)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.predict(docs.select("text", whole(docs)), model, keys=(WHOLE,))
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).select(f"{WHOLE}.*")


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, on shingles of five words; null and repeated ids make no difference."""
    return near_dedup.one_of_each(docs, threshold=0.8, size=5)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows with null or repeated ids are taken one by one."""
    return mixing.mixed_rows(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with document boundaries; the rows are read back from the files."""
    return token_output.token_output(docs, tokenizer_path(), fresh_path(spark, "tokens"))


STAGES = [
    ("language_id", keep_identified),
    ("near_dedup", keep_one_of_copies),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
