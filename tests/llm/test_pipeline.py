"""The pipeline's stages on awkward rows, and its result against a plain version; queries against their SQL."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storyloom.llm import queries
from storyloom.llm._spark import placed_rows
from tests.llm import brute

CLASHING = ("_row", "_whole", "score", "lang_pred", "n_words", "hits", "items", "copies", "_copy", "size", "a b")


def odd_rows():
    text = lambda k: " ".join(f"{k}w{n} the" for n in range(40))
    rows = [(1, text(1), "en", "s1", 0), (1, text(2), "en", "s1", 0), (1, text(2), "en", "s2", 0), (None, text(3), "en", None, 0), (None, text(4), "de", "s2", 0), (9, text(4) + " end", "de", "s2", 0)]
    return rows + [(10 + k, f"short text number {k}", "en" if k % 2 else "de", "s1", 0) for k in range(20)] + [(40, None, None, None, None), (41, "", "en", "s1", 0), (42, "12 34", "en", "s1", 0)]


def test_stages_on_odd_rows(spark, small):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in CLASHING})
    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/odd-{name}"
        stage(spark, now, small).write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == docs.columns
        counts.append(now.count())
    # null, empty and letterless texts go; then one copy of text(2) and one of text(4)
    assert counts[:3] == [26, 24, 24] and counts[3] >= 24
    assert {r["doc_id"] for r in now.where("doc_id IS NULL").collect()} == {None}
    tokens = corpus_pipeline.STAGES[-1][1](spark, now, small).orderBy("start").collect()
    assert sorted(map(str, (r["doc_id"] for r in tokens))) == sorted(map(str, (r["doc_id"] for r in now.collect())))
    assert [r["start"] for r in tokens] == [0, *np.cumsum([r["n_tokens"] for r in tokens])[:-1].tolist()] and tokens[-1]["doc_id"] is None
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.keep_identified(spark, unlabelled, small).count() == 26


def test_rows_of_files_are_not_copied(spark, small):
    """A scan is numbered by place, alike in each pass; what is computed is written first."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = placed_rows(docs, "rows")
    assert rows.inputFiles() == docs.inputFiles()
    one = {r["_row"]: r["_whole"]["doc_id"] for r in rows.collect()}
    two = {r["_row"]: r["d"] for r in rows.select("_row", F.col("_whole.doc_id").alias("d")).collect()}
    assert one == two and len(one) == docs.count()
    made = placed_rows(docs.withColumn("x", F.rand()), "rows")
    assert made.inputFiles() != docs.inputFiles() and made.count() == docs.count()


def test_pipeline_result_matches_a_plain_version(spark, small):
    from tokenizers import Tokenizer

    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    near = brute.near_duplicates(rows, 5)
    rows = [r for r in rows if near[r[0]][3]]
    bad = brute.decontaminate(rows, items)
    rows = sorted(r for r in rows if not bad[r[0]][-1])
    out = corpus_pipeline.run(spark, small).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    assert {r["doc_id"] for r in out} <= set(ids) and sum(r["n_tokens"] for r in out) == sum(len(ids[r["doc_id"]]) for r in out)
    start, words, sizes = 0, {}, {}
    for r in out:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids[r["doc_id"]]), zlib.crc32(np.array(ids[r["doc_id"]], "<u4").tobytes()))
        start += r["n_tokens"]
    by_id = {r[0]: r for r in rows}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    for r in out:
        doc = by_id[r["doc_id"]]
        words[doc[3]] = words.get(doc[3], 0) + len(brute.words(doc[1]))
    # every source takes what the mix gives it, and none more than twice its words
    assert all(words[s] <= 2 * sizes[s] + 2 for s in words) and abs(sum(words.values()) - 1.5 * sum(sizes.values())) < 0.02 * sum(sizes.values())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, small, name):
    found = duckdb.connect()
    for file in glob.glob(f"{small}/*.parquet"):
        found.sql(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    want = found.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, small).select(*want.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall()))
