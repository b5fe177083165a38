"""Each operator against its plain version, on real and awkward documents."""

import glob
import hashlib
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import audio, chat_format, decontaminate, language_id, mixing, near_dedup, quality, queries, sharding, substring_dedup, token_output
from storyloom.llm._spark import component_labels, fresh_path
from tests.llm import brute


@pytest.fixture(scope="module")
def rows(spark, small):
    return brute.documents(spark, small)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return brute.frame(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def by_id(df):
    return {r["doc_id"]: tuple(r) for r in df.collect()}


# --- 1: chat formatting


def test_chat_query_matches_table(spark, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet").collect()
    said = r"\### Assistant: </turn> ok"
    all_turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns] + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    found = {r["conv_id"]: r for r in queries.chat_formatting(spark, small).collect()}
    assert set(found) == {t[0] for t in all_turns}
    for conv, r in found.items():
        own = sorted((t for t in all_turns if t[0] == conv), key=lambda t: t[1])
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == brute.sha("".join(f"{t[2]}\n{t[3] or ''}\n" for t in own))
        lost = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(lost), brute.sha(lost))
        assert r["formatted_chars"] > len(lost)


@pytest.mark.parametrize("text", ["", "\\", "\\\\###", "####", "</turn>\n### user: hi</turn>\n", "\\</turn>", "a:b\\:c", "<</turn>", "</turn", "\\###\\"])
def test_template_reads_back(spark, text):
    turns = spark.createDataFrame([(1, 0, text, text), (1, 1, "assistant", text)], chat_format.TURNS)
    pieces = chat_format.format_turns(turns).orderBy("turn").collect()
    assert chat_format.parse("".join(r["piece"] for r in pieces)) == [(text, text), ("assistant", text)]
    assert chat_format.unescape(pieces[1]["piece"][pieces[1]["loss_from"] : pieces[1]["loss_to"]]) == text


def test_layouts_become_turns(spark):
    records = [
        {"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"id": 3, "instruction": "do", "input": "this", "output": "done"},
        {"id": 4, "prompt": "p", "response": "r", "system": "s"},
        {"id": 5, "unknown": 1},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [(None,), ("{",)], "record string")
    found = [tuple(r) for r in chat_format.turns_from_records(df).orderBy("conv_id", "turn").collect()]
    assert [r for r in found if r[0] is not None] == [
        (1, 0, "user", "q", "messages"), (1, 1, "assistant", "", "messages"), (2, 0, "user", "q", "share_gpt"), (2, 1, "assistant", "a", "share_gpt"),
        (3, 0, "user", "do", "instruction"), (3, 1, "user", "this", "instruction"), (3, 2, "assistant", "done", "instruction"),
        (4, 0, "system", "s", "prompt_response"), (4, 1, "user", "p", "prompt_response"), (4, 2, "assistant", "r", "prompt_response"),
    ]
    assert sum(r[4] == "unknown" for r in found) == 3


def test_odd_records_become_rows(spark):
    turn = [{"role": "user", "content": "q"}]
    odd = [{"id": x, "messages": turn} for x in ("c-1", 1.5, None, True, 2**63, [1])] + [{"id": 1, "messages": [{"role": "user", "content": "q"}, 5]}, 7, [1]]
    good = [{"id": " -12 ", "messages": turn}, {"id": 3, "messages": [{"role": None, "content": 4}]}]
    raw = [json.dumps(x) for x in odd + good] + ["[" * 100_000, "", None]
    found = [tuple(r) for r in chat_format.turns_from_records(spark.createDataFrame([(x,) for x in raw], "record string")).collect()]
    assert len(found) == len(raw) and sorted(r for r in found if r[4] != "unknown") == [(-12, 0, "user", "q", "messages"), (3, 0, "", "4", "messages")]
    assert {r[:2] for r in found if r[4] == "unknown"} == {(None, None)}


def test_chat_awkward_tables(spark):
    turns = spark.createDataFrame([(1, 0, None, None, "x"), (1, 0, None, None, "x"), (None, 0, "user", "a", "x")], chat_format.TURNS + ", piece string")
    found = chat_format.digests(chat_format.format_turns(chat_format.turns_from_table(turns))).collect()
    assert {(r["conv_id"], r["n_turns"]) for r in found} == {(1, 2), (None, 1)}
    assert chat_format.digests(chat_format.format_turns(chat_format.turns_from_table(turns.where("false")))).count() == 0
    with pytest.raises(ValueError):
        chat_format.turns_from_table(turns.select("role"))


# --- 2: near-dedup


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_brute_force(docs, rows, size):
    assert by_id(near_dedup.near_duplicates(docs, 0.8, size)) == brute.near_duplicates(rows, size)


def test_near_duplicates_in_a_large_bucket(spark):
    """Hundreds of copies of one text with few and many changes: chains of links across the threshold."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for doc in range(300):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 14), replace=False):
            w[at] = f"x{rng.integers(40)}"
        rows.append((doc, " ".join(w), "en", "s", 0))
    assert by_id(near_dedup.near_duplicates(brute.frame(spark, rows), 0.8, 2)) == brute.near_duplicates(rows, 2)


def test_near_duplicates_empty_and_repeated(nothing, spark):
    assert near_dedup.near_duplicates(nothing).count() == 0
    twice = brute.frame(spark, [(1, "a b c", "en", "s", 5)] * 2 + [(2, None, None, None, None)])
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(twice, 0.8, 2).collect()) == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]


def test_near_duplicates_with_null_and_repeated_ids(spark, small):
    import corpus_pipeline

    long = [" ".join(f"{k}w{n}" for n in range(60)) for k in range(4)]
    rows = [
        (1, long[0], "en", "s", 0), (1, long[1], "en", "s", 0), (1, long[1], "en", "s", 0), (2, long[1] + " end", "en", "s", 0), (3, long[0] + " end", "en", "s", 0),
        (None, long[2], "en", "s", 0), (None, long[2] + " end", "en", "s", 0), (None, long[3], "en", "s", 0), (5, long[3] + " end", "en", "s", 0), (None, "", "en", "s", 0), (None, None, "en", "s", 0),
    ]
    df = brute.frame(spark, rows)
    kept = sorted(((r["doc_id"], r["text"] and r["text"][:2]) for r in corpus_pipeline.keep_one_of_copies(spark, df, small).collect()), key=str)
    assert kept == sorted([(1, "0w"), (1, "1w"), (None, "2w"), (5, "3w"), (None, ""), (None, None)], key=str)
    found = near_dedup.near_duplicates(df).collect()
    assert len(found) == len(rows) and all(r["kept"] is not None for r in found)
    assert {r["component_id"] for r in found if r["doc_id"] in (2, 3)} == {1} and sum(r["kept"] for r in found if r["component_id"] is None) == 3


def test_bounds_keep_true_links():
    least = near_dedup.least_matches(0.8)
    rng = np.random.default_rng(1)
    draws = rng.random((2000, near_dedup.HASHES)) < 0.8
    for k, bound in enumerate(least):
        assert (draws[:, : (k + 1) * near_dedup.STEP].sum(axis=1) < bound).mean() < 1e-3


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 200), (300, 100), (7, 7)]
    found = dict(component_labels(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {k: 0 for k in range(51)} | {100: 100, 200: 100, 300: 100}


# --- 3: audio


def test_media_rows(spark, docs, rows, nothing):
    found = by_id(audio.summarize(audio.store_texts(docs)))
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        assert found[doc][1:5] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = audio.wav(payload)
        assert found[doc][5:7] == (len(stored), hashlib.sha256(stored).hexdigest())
        assert audio.wav_samples(stored) == (payload, audio.RATE)
    assert audio.summarize(audio.store_texts(nothing)).count() == 0


def test_blocks_do_not_change_features(monkeypatch):
    samples = np.random.default_rng(0).integers(0, 256, 90_001, dtype=np.uint8).tobytes()
    whole = audio.log_mel(samples)
    monkeypatch.setattr(audio, "BLOCK", 5000)
    parts = audio.log_mel(samples)
    assert np.allclose(whole[0], parts[0], atol=1e-3) and np.allclose(whole[1], parts[1], atol=1e-3)


def test_resampling_keeps_a_tone():
    t = np.arange(4000) / audio.RATE
    tone = np.sin(2 * np.pi * 500 * t).astype(np.float32)
    out = audio.resample(tone)
    want = np.sin(2 * np.pi * 500 * np.arange(len(out)) / (audio.RATE * audio.UP / audio.DOWN))
    assert len(out) == 3000 and np.abs(out - want)[100:-100].max() < 0.02


def test_hysteresis():
    energy = np.array([-9, -2.5, -2, -2.5, -2.7, -3, -2.5, -1, -1])
    assert audio.segments(energy) == [(2, 5), (7, 9)]
    assert audio.segments(np.zeros(0)) == []


def test_patches_have_one_shape(docs):
    found = audio.patches(audio.store_texts(docs)).collect()
    assert {len(r["tensor"]) for r in found} == {audio.PATCH * audio.MELS}
    assert all(r["from_s"] < r["to_s"] for r in found)


def test_features_come_from_written_patches(spark, docs):
    twice = docs.select("doc_id", "text").unionByName(docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text"))
    media = audio.store_texts(twice)
    want = []
    for r in media.collect():
        mel, energy = audio.log_mel(audio.wav_samples(r["media"])[0])
        want.append((r["doc_id"], audio.feature_string(mel, audio.segments(energy))))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{shared}/patches-*"))
    found = audio.summarize(media)
    (path,) = set(glob.glob(f"{shared}/patches-*")) - before
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["feature"])) for r in found.collect())
    stored = spark.read.parquet(path)
    assert stored.select("row").distinct().count() == len(want) and stored.count() > len(want)
    assert stored.selectExpr("size(tensor) AS n").distinct().collect() == [(audio.PATCH * audio.MELS,)]
    parted = audio.features(stored.repartition(7, F.rand(1)))  # patches of one row in many places
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["feature"])) for r in parted.collect())
    louder = stored.withColumn("tensor", F.transform("tensor", lambda x: x + 1))
    assert not {r["feature"] for r in audio.features(louder).collect()} & {x for _, x in want}


# --- 4: quality


def test_quality_is_learned(spark, small):
    d = small.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = queries.quality_classifier(spark, d).collect()
    assert len(out) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == (brute.crc(r["doc_id"]) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out)
    held = [(r["score"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.9


def test_rules_as_columns_equal_rules_in_numpy(docs):
    rng = np.random.default_rng(0)
    x = rng.random((500, len(quality.STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.6)).astype(float)
    model = quality.train(x, y)
    assert model.rules
    stats = quality.with_statistics(docs)
    for r in stats.withColumn("score", quality.score(model)).collect():
        one = np.array([[r[s] for s in quality.STATS]])
        total = model.bias + sum(w for rule, w in model.rules if quality.holds(rule, one)[0])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)))


def test_labels_with_clashing_names_and_texts(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    odd = docs.withColumns({"_quality": F.lit(1), "quality": F.lit("q"), "log_bytes": F.lit(0)})
    want = quality.fit(docs, labels)
    assert quality.fit(odd.union(odd), labels.union(labels)) == want and want.rules
    # of several texts of one id one counts, so a repeated id adds no rows
    more = docs.unionByName(docs.where("doc_id < 20").withColumn("text", F.concat("text", F.lit(" more"))))
    assert quality.fit(more.union(more), labels) == quality.fit(more, labels)


def test_quality_without_labels(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert {r["score"] for r in quality.classify(docs, model).collect()} == {0.5}
    assert quality.classify(nothing, model).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 7)], "doc_id long, quality int")
    assert quality.fit(docs, odd).rules == []


# --- 5: language


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = language_id.start(["a", "b", "c"])
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    strips, labels = rng.integers(0, 256, (4, 9), dtype=np.uint8), np.array([0, 1, 2, 1])
    _, g = language_id.gradients(model, strips, labels)
    for name, weight in model.weights.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), weight.shape)
        old, eps = weight[at], 1e-3
        weight[at] = old + eps
        up = language_id.gradients(model, strips, labels)[0]
        weight[at] = old - eps
        down = language_id.gradients(model, strips, labels)[0]
        weight[at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.02, abs=1e-5)


def test_language_is_learned(spark, small):
    d = small.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    out = queries.identify_language(spark, d).collect()
    assert len(out) == len(truth) and all(r["held_out"] == (brute.crc(r["doc_id"]) % 3 == 1) for r in out)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in out if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean(held) > 0.95


def test_language_of_awkward_texts(docs, rows, nothing):
    model = language_id.train(["the of and is"] * 3 + ["der die und ist"] * 3, ["en"] * 3 + ["de"] * 3, steps=5)
    found = by_id(language_id.predict(docs, model))
    for doc, text, *_ in rows:
        assert (found[doc][1] == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= found[doc][2] <= 1
    assert language_id.predict(nothing, model).count() == 0
    assert {x[1] for x in by_id(language_id.predict(docs, language_id.fit(nothing))).values()} == {"und"}
    assert len(language_id.position_labels(model, "the und")) == 7


# --- 6: decontamination


@pytest.fixture(scope="module")
def planted(rows, spark, small):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    items += [(900, None), (901, "..."), (902, "Short ITEM"), (903, items[0][1]), (None, "null id")]
    top = max(r[0] for r in rows) + 1
    more = [(top, "see: a short, item!", "en", "s", 0), (top + 1, "x " * 300 + items[1][1].upper() + " y" * 10, "en", "s", 0)]
    return rows + more, items


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 2000])
def test_decontamination_matches_brute_force(spark, planted, block_bytes):
    rows, items = planted
    item_df = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.report(decontaminate.scan(brute.frame(spark, rows), item_df, block_bytes=block_bytes))
    got = by_id(out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    assert got == brute.decontaminate(rows, [("" if i is None else i, t) for i, t in items])


def test_decontamination_spans_and_filter(spark, planted, nothing):
    rows, items = planted
    item_df = spark.createDataFrame(items, "item_id long, text string")
    df = brute.frame(spark, rows)
    last = rows[-2]
    span = [r for r in decontaminate.scan(df, item_df, spans=True).collect() if r["doc_id"] == last[0]][0]["spans"]
    assert [last[1][a:b] for a, b in span] == ["short, item"]
    bad = {d for d, x in brute.decontaminate(rows, items).items() if x[-1]}
    kept = decontaminate.decontaminate(df, item_df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - bad
    assert decontaminate.scan(nothing, item_df).count() == 0
    assert decontaminate.decontaminate(df, item_df.where("false")).count() == len(rows)


def test_blocks_keep_repeated_and_null_rows(spark, planted, monkeypatch):
    rows, items = planted
    rows = rows + rows[-2:] + [(None, *r[1:]) for r in rows[-4:]] + [(rows[-1][0], "clean words", "en", "s", 0)] * 2
    items = items + [(None, f"null id with text {k} " * 5) for k in range(40)] + [(7, "one row " * 30)] * 300 + [(2, items[1][1])]
    df, item_df = brute.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, decontaminate.scan(df, item_df, spans=True, block_bytes=n).collect())) for n in (decontaminate.BLOCK_BYTES, 2000))
    assert len(many) == len(rows) and one == many
    sizes, machine = [], decontaminate._scanner
    monkeypatch.setattr(decontaminate, "_scanner", lambda shared, *x: sizes.append(len(shared.value)) or machine(shared, *x))
    decontaminate.scan(df, item_df, block_bytes=2000)
    assert len(sizes) > 1 and max(sizes) < 40
    want = sorted(map(str, decontaminate.decontaminate(df, item_df).collect()))
    monkeypatch.setattr(decontaminate.scan, "__defaults__", (*decontaminate.scan.__defaults__[:2], 2000, *decontaminate.scan.__defaults__[3:]))
    assert want == sorted(map(str, decontaminate.decontaminate(df, item_df).collect()))


# --- 7: sharding


def test_shards_keep_all_rows(spark, docs, rows):
    store = sharding.ShardStore(spark, fresh_path(spark, "store"), target_bytes=60_000, fanout=2, least_bytes=1000)
    assert store.current().shards == ()
    for k in range(6):
        store.append(docs.where(F.col("doc_id") % 6 == k))
    before = store.current()
    after = store.compact()
    assert len(after.shards) < len(before.shards) and not store.plan(after.shards)
    key = lambda df: sorted((r["doc_id"], r["text"] or "", r["sig"]) for r in df.collect())
    assert key(store.read(before)) == key(store.read(after)) == key(docs)
    with pytest.raises(sharding.CommitConflict):
        store.commit(before, ())
    assert store.expire() == 0 and store.expire(grace_seconds=0) > 0 and key(store.read()) == key(docs)


def test_expiry_spares_what_is_not_committed(spark, docs):
    store = sharding.ShardStore(spark, fresh_path(spark, "store"), fanout=2)
    store.append(docs.limit(3))
    late = store._write(docs.limit(5))  # another writer: written, not committed
    assert store.expire() == 0
    base = store.current()
    store.commit(base, base.shards + late)
    assert store.read().count() == 8


def test_two_writers_of_a_store(spark, docs, monkeypatch):
    root = fresh_path(spark, "store")
    one, other = (sharding.ShardStore(spark, root, fanout=2) for _ in range(2))
    one.append(docs.limit(2))
    real, calls = sharding.ShardStore.current, []

    def current(self):
        found = real(self)
        if self is one and len(calls) < 1:
            calls.append(1)
            other.append(docs.limit(3))  # the other one commits between reading and committing
        return found

    monkeypatch.setattr(sharding.ShardStore, "current", current)
    one.append(docs.limit(4))
    assert one.read().count() == 9 and one.compact().version > 3 and one.read().count() == 9


def test_stores_with_odd_rows(spark):
    store = sharding.ShardStore(spark, fresh_path(spark, "store"), fanout=2)
    with pytest.raises(ValueError):
        store.read()
    df = spark.createDataFrame([(1, "a", None, 2.0)] * 2 + [(None, "", "x", None)], "_file int, _group string, `a b` string, _FILE2 double")
    store.append(df.where("false"))
    assert store.read().count() == 0 and store.read().columns == df.columns
    for _ in range(3):
        store.append(df)
    with pytest.raises(ValueError):
        store.append(df.drop("_group"))
    store.compact()
    assert sorted(map(str, store.read().collect())) == sorted(map(str, df.collect() * 3))


# --- 8: token output


def test_tokens_match_whole_texts(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    to = fresh_path(spark, "tokens")
    token_output.write_tokens(docs, to, queries.tokenizer_path(), block_ids=5000)
    got, start = by_id(token_output.read_rows(spark, to)), 0
    for doc, text, *_ in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert got[doc] == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_output.token_output(nothing, queries.tokenizer_path()).count() == 0
    twice = token_output.token_output(docs.union(docs), queries.tokenizer_path()).orderBy("start").collect()
    assert [r["doc_id"] for r in twice] == sorted(2 * [r[0] for r in rows])


def test_tokens_of_rows_without_id(spark):
    rows = [(None, "x y"), (3, "b"), (None, None), (3, "a"), (-1, "c"), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1))
    out = token_output.token_output(df, queries.tokenizer_path(), block_ids=3).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [-1, 3, 3, None, None, None]
    assert [r["start"] for r in out] == np.cumsum([0, *[r["n_tokens"] for r in out[:-1]]]).tolist() and sorted(r["n_tokens"] for r in out) == [1, 2, 2, 2, 3, 3]
    none = token_output.token_output(df.where("doc_id IS NULL"), queries.tokenizer_path()).collect()
    assert [r["doc_id"] for r in none] == [None] * 3


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(1000)), [10**12], sorted(np.random.default_rng(0).integers(0, 10**9, 700).tolist())])
def test_elias_fano(values):
    coded = token_output.EliasFano.encode(np.array(values, dtype=np.uint64))
    assert coded.decode().tolist() == values
    assert [coded.select(i) for i in range(len(values))] == values
    assert [coded.range(i) for i in range(len(values))] == list(zip([0, *values], values))
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_of_many_values_stays_small():
    import tracemalloc

    values = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 300_000)).astype(np.uint64)
    tracemalloc.start()
    coded = token_output.EliasFano.encode(values)
    assert (coded.decode() == values.astype(np.int64)).all()
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


# --- 9: substring dedup


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substrings_match_brute_force(spark, rows, batches):
    passage = " ".join(f"p{k}" for k in range(60))
    top = max(r[0] for r in rows) + 1
    more = [f"before {passage} after", f"{passage} {passage}", passage[:200], "w " * 25, "w " * 19, "w " * 20, " ".join(passage.split()[5:25]), " ".join(passage.split()[5:24])]
    every = rows + [(top + k, x, "en", "s", 0) for k, x in enumerate(more)]
    assert by_id(substring_dedup.substring_dedup(brute.frame(spark, every), batches=batches)) == brute.substring_dedup(every)


def test_index_compacts_and_copes_with_little(spark, rows, docs, nothing):
    index = substring_dedup.FingerprintIndex(spark, buckets=3, fanout=2)
    out = substring_dedup.substring_dedup(docs, batches=4, index=index, texts=True)
    assert all(max(r["tier"] for r in runs) >= 1 for runs in index.runs.values())
    want = brute.substring_dedup(rows)
    for r in out.collect():
        assert tuple(r)[:4] == want[r["doc_id"]] and (r["kept"] is None or brute.sha(r["kept"]) == r["kept_sha256"])
    index.drop()
    assert substring_dedup.substring_dedup(nothing).count() == 0
    twice = [tuple(r) for r in substring_dedup.substring_dedup(docs.union(docs), batches=1).collect()]
    assert sorted(twice) == sorted([*want.values()] * 2)


def test_batches_meet_what_was_indexed_before(spark, rows):
    """Calls on parts, each in an index that is opened anew, remove what one call on all removes; a copy that comes later goes whole."""
    root, want, got = fresh_path(spark, "index"), brute.substring_dedup(rows), {}
    for k in range(3):
        part = [r for i, r in enumerate(sorted(rows)) if i * 3 // len(rows) == k]
        got |= by_id(substring_dedup.add_batch(brute.frame(spark, part), substring_dedup.FingerprintIndex(spark, root, buckets=3, fanout=2)))
    assert got == want
    again = [r for r in rows if len(brute.words(r[1])) >= 20][:3]
    copies = [(10**6 + k, r[1], *r[2:]) for k, r in enumerate(again)] + [(None, again[0][1], "en", "s", 0)]
    out = substring_dedup.add_batch(brute.frame(spark, copies), substring_dedup.FingerprintIndex(spark, root)).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"] == r["n_words"]) for r in out) == [(False, True)] * 3 + [(True, False)]


def test_substrings_of_texts_longer_than_a_slice(spark, monkeypatch):
    rng = np.random.default_rng(0)
    long = " ".join(f"w{x}" for x in rng.integers(0, 900, 4000))
    rows = [(1, long, "en", "s", 0), (2, long[500:9000] + " end", "en", "s", 0), (2, "other " + long[:800], "en", "s", 0)]
    monkeypatch.setattr(substring_dedup, "SLICE", 3000)
    assert by_id(substring_dedup.substring_dedup(brute.frame(spark, rows[:2]), batches=1)) == brute.substring_dedup(rows[:2])
    assert substring_dedup.substring_dedup(brute.frame(spark, rows), batches=2).count() == 3


# --- 10: mixing


def check_mix(out, rows):
    sizes = {}
    for doc, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= above
    target |= share
    taken = {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    return taken, target


def test_mixing(spark, docs, rows, nothing):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    taken, target = check_mix(out, rows)
    for s, x in taken.items():  # the best that any choice of documents can do, from below
        sizes = [len(brute.words(r[1])) for r in rows if r[3] == s]
        copies = int(target[s] // sum(sizes)) if sum(sizes) else 0
        sums = 1
        for n in sizes:
            sums |= sums << n
        budget = int(target[s] + 0.5) - copies * sum(sizes)
        best = (sums & ((1 << budget + 1) - 1)).bit_length() - 1
        assert x == copies * sum(sizes) + best
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(nothing).count() == 0


def test_mixing_with_null_and_repeated_ids(spark, docs, small):
    import corpus_pipeline

    some = docs.where("text IS NOT NULL AND source IS NOT NULL")
    awkward = some.withColumn("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 7L ELSE doc_id END"))
    words = F.sum(F.regexp_count("text", F.lit(mixing.WORD)))
    mixed = corpus_pipeline.mix_sources(spark, awkward, small)
    # the ids decide which documents of a length are taken, not how many
    assert mixed.agg(words).first() == corpus_pipeline.mix_sources(spark, some, small).agg(words).first()
    assert mixed.where("doc_id IS NULL").count() > 0
    assert mixing.mix(awkward).count() == awkward.count()


def test_fit_counts():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.choice(np.arange(1, 60), rng.integers(1, 8), replace=False)
        counts = rng.integers(0, 5, len(sizes))
        budget = int(rng.integers(0, max(1, int(sizes @ counts)) + 5))
        take = mixing.fit_counts(sizes, counts, budget)
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        assert (take >= 0).all() and (take <= counts).all() and int(sizes @ take) <= budget
        assert int(sizes @ take) == max(x for x in sums if x <= budget)
    assert mixing.fit_counts(np.array([3]), np.array([10**9]), 3 * 10**8).tolist() == [10**8]


# --- pipeline


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = corpus_pipeline.STAGES[1][1](spark, docs, small)
    assert one.columns == docs.columns
    want = {d for d, x in brute.near_duplicates([tuple(r) for r in docs.collect()], 5).items() if x[3]}
    assert {r["doc_id"] for r in one.collect()} == want
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, small)
    words = F.regexp_count("text", F.lit(mixing.WORD))
    assert mixed.columns == docs.columns and mixed.agg(F.sum(words)).first()[0] == pytest.approx(1.5 * docs.agg(F.sum(words)).first()[0], rel=0.01)
    out = corpus_pipeline.run(spark, small).orderBy("start").collect()
    ends = np.cumsum([r["n_tokens"] for r in out])
    assert [r["start"] for r in out] == [0, *ends[:-1].tolist()]
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.collect()}


def test_compaction_shuffles_rows_once(spark, monkeypatch):
    store = sharding.ShardStore(spark, fresh_path(spark, "store"), target_bytes=1 << 20, fanout=2, least_bytes=1 << 18)
    for k in range(4):
        store.append(spark.range(k * 1000, k * 1000 + 1000, 1, 1).withColumn("t", F.sha2(F.col("id").cast("string"), 256)))
    real, plans = store._write, []

    def write(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return real(rows)

    monkeypatch.setattr(store, "_write", write)
    former = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.compact()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", former)
    assert plans and all("SortMergeJoin" not in p and p.count("- Exchange") == 1 for p in plans), plans
    assert sorted(r["id"] for r in store.read().collect()) == list(range(4000))
