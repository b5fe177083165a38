"""Whitening, nearest neighbours and hard negatives against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import hard_negatives, nearest, queries, whitening
from storyloom.llm._spark import fresh_path

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
ODD = [(1, None, 1), (2, [], 1), (3, [1.0, None, 2.0, 0.5], 1), (4, [NAN, 1.0, 1.0, 1.0], 2), (5, [INF, 1.0, 1.0, 1.0], 2), (6, [1.0, 2.0], 1)]


def made(n=400, d=4, seed=3):
    """Vectors with ties: every fourth one repeats another one, and vec_ids start at 100."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(2)
    x[3::4] = x[rng.integers(0, n // 8, len(x[3::4]))]
    return [(100 + k, [float(v) for v in row], int(rng.integers(0, 4))) for k, row in enumerate(x)]


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS row", "'x' AS v", "2 AS x", "3 AS n", "'g' AS block", "4 AS shard", "'r' AS rank", "0.5D AS score", "1 AS node")


# --- 11: whitening


def plainly_whitened(rows, components=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in r[1]] for r in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = np.array([[int(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    deviation = [int(sum((n * c - s) ** 2 for c, s in zip(row, sums))) for row in x]
    return centred @ vectors[:, order] / np.sqrt(values[order]), deviation, values[order] / values.sum()


@pytest.mark.parametrize("large", [False, True])
def test_whitening_matches_numpy(spark, small, large):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()] if large else made()
    want, deviation, explained = plainly_whitened(rows)
    got = whitening.whiten(frame(spark, rows + ODD)).collect()
    assert len(got) == want.size
    place = {r[0]: k for k, r in enumerate(rows)}
    found = np.zeros(want.shape)
    for r in got:
        found[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert (r["n"], r["deviation"]) == (len(rows), deviation[place[r["vec_id"]]])
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9) and r["identity_error"] < 1e-9
    signs = np.sign((found * want).sum(axis=0))
    assert np.abs(found - signs * want).max() < 1e-8


def test_whitening_of_awkward_tables(spark):
    assert whitening.whiten(frame(spark, ODD[:5])).count() == 0
    assert whitening.whiten(frame(spark, made(8)).where("false")).count() == 0
    one = whitening.whiten(frame(spark, [(7, [1.0, 2.0], 1)])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    # the second component depends on the first; repeated and null ids stay
    line = whitening.whiten(frame(spark, [(7, [1.0, 1.0], 1), (7, [2.0, 2.0], 1), (None, [3.0, 3.0], None)])).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in line) == [("7", 1), ("7", 1), ("7", 2), ("7", 2), ("None", 1), ("None", 2)]
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line)
    assert sum(r["whitened"] ** 2 for r in line if r["component"] == 1) == pytest.approx(3)


def test_deviations_beyond_a_long_are_null(spark):
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in huge} == {None} and all(np.isfinite(r["whitened"]) for r in huge if r["component"] == 1)


# --- 12: nearest neighbours


def plainly_nearest(rows, queries, k=5):
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    ids, out = np.array([r[0] for r in rows]), {}
    norms = np.sqrt((x * x).sum(axis=1))
    for q in queries:
        score = (x * x[q]).sum(axis=1) / (norms[q] * norms)
        order = [c for c in np.lexsort((ids, -score)) if c != q][:k]
        out[int(ids[q])] = [(int(ids[c]), float(score[c])) for c in order]
    return out


def neighbours(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_neighbours_of_a_small_table_are_exact(spark, shard_rows):
    rows = [r for r in made() if any(r[1])]
    df = frame(spark, rows + ODD + [(8, [0.0] * 4, 1)])
    got = neighbours(nearest.nearest_neighbours(df, df.where("vec_id % 3 = 0"), shard_rows=shard_rows))
    want = plainly_nearest(rows, [k for k, r in enumerate(rows) if r[0] % 3 == 0])
    assert set(got) == set(want)
    for q, pairs in want.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in pairs], rel=1e-12)
        # equal vectors score alike to the last bit, so their ids come in order
        assert [v for v, _ in got[q]] == [v for v, _ in pairs] or sorted(s for _, s in got[q]) == pytest.approx(sorted(s for _, s in pairs))


def test_recall_on_the_query(spark):
    large = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{large}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = plainly_nearest(rows, [k for k, r in enumerate(rows) if r[0] % 50 == 0])
    got = neighbours(queries.nearest_neighbours(spark, large))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in want]) >= 0.95


def test_copies_are_told_apart_by_id(spark):
    rows = [(k, [1.0, 2.0], 0) for k in range(40)] + [(50, [1.0, 0.0], 0), (60, [1.0, 2.0], 0), (60, [1.0, 2.0], 0), (None, [-1.0, 0.0], 0)]
    df = frame(spark, rows)
    got = neighbours(nearest.nearest_neighbours(df, df.where("vec_id IN (0, 3, 50)")))
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[3]] == [0, 1, 2, 4, 5] and [v for v, _ in got[50]] == [0, 1, 2, 3, 4]
    few = frame(spark, [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [0.0, 1.0], 0)])
    # of two equal rows each finds the other; all candidates, if there are fewer
    assert sorted(map(str, map(tuple, nearest.nearest_neighbours(few, few.where("vec_id = 1")).select("query_id", "rank", "vec_id").collect()))) == ["(1, 1, 1)", "(1, 1, 1)", "(1, 2, None)", "(1, 2, None)"]
    for nothing in (df.where("false"), frame(spark, ODD[:5])):
        assert nearest.nearest_neighbours(nothing, nothing).count() == 0
    assert nearest.nearest_neighbours(df, df.where("false")).count() == 0


def test_graphs_are_stored_whole(spark):
    rows = made(300, 8)
    index = nearest.GraphIndex.build(nearest.taking_part(frame(spark, rows), "vec_id", "embedding"), fresh_path(spark, "index"), copies=3, shard_rows=100)
    shards = index.shards().collect()
    assert sum(len(r["node"]) for r in shards) == len({tuple(r[1]) for r in rows}) and len(shards) >= 2
    for r in shards:
        points = nearest.unit(np.array(r["vectors"], np.float32).reshape(len(r["node"]), 8)).astype(np.float32)
        graph = nearest.Graph.of_flat(points, np.array(r["level"], np.int8), np.array(r["neighbours"], np.int32), r["links"])
        assert (graph.flat() == np.array(r["neighbours"])).all()
        found = graph.search(points, 32)
        assert (found[:, 0] == np.arange(len(points))).all()
        assert all(len(ids) <= 3 and ids == sorted(ids) for ids in r["ids"])


# --- 13: hard negatives


def plainly_mined(rows, anchor, positives=5, k=10, low=30, high=90):
    x = [[math.floor(256 * float(np.float32(c))) for c in r[1]] for r in rows]
    out = []
    for a, row in enumerate(rows):
        if not anchor(row):
            continue
        score = [sum(p * q for p, q in zip(x[a], y)) for y in x]
        order = sorted((c for c in range(len(rows)) if c != a), key=lambda c: (-score[c], rows[c][0] is None, rows[c][0] or 0))
        for p in [c for c in order if rows[c][2] == row[2]][:positives]:
            inside = [c for c in order if rows[c][2] != row[2] and low * score[p] <= 100 * score[c] <= high * score[p]][:k]
            out += [(row[0], rows[p][0], n + 1, rows[c][0], score[p], score[c]) for n, c in enumerate(inside)]
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [8192, 37])
def test_negatives_match_brute_force(spark, block):
    rows = made(500) + [(None, [0.5, 0.5, -0.25, 1.0], 2), (700, [0.5, 0.5, -0.25, 1.0], 3)]
    df = frame(spark, rows + ODD + [(9, [1.0, 1.0, 1.0, 1.0], None)])
    got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0, block=block, group=16)
    assert sorted(map(str, map(tuple, got.collect()))) == plainly_mined(rows, lambda r: r[0] is not None and r[0] % 20 == 0)


def test_negatives_of_one_hot_vector(spark):
    """Very many rows of one score: the smallest ids are taken, and no task gathers them all."""
    rows = [(k, [1.0, 0.0], 1) for k in range(6)] + [(1000 - k, [0.5, 0.5], 2) for k in range(300)]
    df = frame(spark, rows)
    got = hard_negatives.mine(df, F.col("vec_id") == 0, positives=2, block=50)
    assert sorted(map(str, map(tuple, got.collect()))) == plainly_mined(rows, lambda r: r[0] == 0, positives=2)


def test_negatives_of_large_and_few_vectors(spark):
    big = [(0, [3e4, 1e4], 0), (1, [2e4, 2e4], 0), (2, [1e4, 1e4], 1), (3, [1.1e4, 1e4], 1), (4, [1e4, 1e4], 2)]
    assert sorted(map(str, map(tuple, hard_negatives.mine(frame(spark, big), F.col("vec_id") == 0).collect()))) == plainly_mined(big, lambda r: r[0] == 0)
    wide = spark.createDataFrame([(0, [1e9, 1.0], 0), (1, [1e9, 2.0], 0), (2, [5e8, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(wide, F.col("vec_id") == 0).count() <= 1
    for nothing in (frame(spark, big).where("false"), frame(spark, ODD[:5])):
        assert hard_negatives.mine(nothing, F.col("vec_id") >= 0).count() == 0
    assert hard_negatives.mine(frame(spark, big), F.col("vec_id") == 77).count() == 0
