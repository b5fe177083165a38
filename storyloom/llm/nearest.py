"""Approximate nearest neighbours by cosine: a navigable small-world graph of several layers for each shard, shard results merged.

Rows with equal vectors are one node. Nodes are dealt to shards by a hash of their number, a shard's graph is built by one task and stored as flat arrays,
and blocks of queries meet every shard. A task holds one shard and one block of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm._spark import Scratch, discard, fresh_path, written
from storyloom.llm._vectors import finite, list_column, matrix, usual_length

#: Nodes of a shard, queries of a block.
SHARD_ROWS, BLOCK = 8192, 2048
#: Links of a node in each upper layer; the lowest layer has twice as many.
LINKS = 16
#: Nodes kept in sight while a node is linked, and while a query is answered.
WIDTH, SEARCH_WIDTH = 64, 96
#: Nodes linked at a time, at most a fourth of those that are there.
BATCH = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by powers of two first, which is exact, so that no square leaves a double."""
    rows = vectors.astype(np.float64)
    scaled = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The cosine of ``one`` and each of ``others``, in double precision on the vectors as they are (scaled by powers of two)."""
    a, b = (np.ldexp(x.astype(np.float64), -np.frexp(np.abs(x.astype(np.float64)).max(axis=1, initial=0.0))[1][:, None]) for x in (one[None], others))
    return (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


class Graph:
    """A hierarchical navigable small-world graph over the rows of ``points`` (unit vectors, float32).

    ``layers[k]`` holds the links of layer k as rows of node numbers, -1 where there is none. Nodes are linked in batches: each searches the graph
    of the nodes before, and meets the others of its batch directly. Distances are of differences, so that near copies are told apart.
    """

    def __init__(self, points: np.ndarray, levels: np.ndarray, layers: list[np.ndarray]):
        self.points, self.levels, self.layers = points, levels, layers

    @property
    def start(self) -> int:
        return int(np.argmax(self.levels))

    @classmethod
    def build(cls, points: np.ndarray, links: int = LINKS, width: int = WIDTH, seed: int = 12) -> Graph:
        n = len(points)
        drawn = -np.log(1.0 - np.random.default_rng(seed).random(n)) / math.log(links)
        levels = np.minimum(drawn, 12).astype(np.int8)
        layers = [np.full((n, links * (1 if k else 2)), -1, np.int32) for k in range(int(levels.max(initial=0)) + 1)]
        graph, done = cls(points, levels, layers), 0
        while done < n:
            # the node of the highest layer so far is where searches start
            batch = np.arange(done, min(n, done + max(1, min(BATCH, done // 4))))
            graph._link(batch, done, links, width)
            done = int(batch[-1]) + 1
        return graph

    def _link(self, batch: np.ndarray, done: int, links: int, width: int) -> None:
        levels, entry = self.levels[batch], None
        if done:
            first = int(np.argmax(self.levels[:done]))
            entry, top = np.full((len(batch), 1), first, np.int32), int(self.levels[first])
        for layer in range(len(self.layers) - 1, -1, -1):
            here = np.flatnonzero(levels >= layer)
            found = np.full((len(batch), 0), -1, np.int32)
            if entry is not None and layer <= top:
                found = np.full((len(batch), width), -1, np.int32)
                above = np.flatnonzero(levels < layer)
                if len(above):
                    found[above, :1] = self._search(self.points[batch[above]], entry[above], layer, 1)[0]
                if len(here):
                    found[here] = self._search(self.points[batch[here]], entry[here], layer, width)[0]
                entry = found
            if len(here):
                self._connect(batch[here], np.concatenate([found[here], self._beside(batch[here], width // 2)], axis=1), layer, width)

    def _beside(self, nodes: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` nearest others among ``nodes`` of each of them."""
        points = self.points[nodes] - self.points[nodes].mean(axis=0)
        squares = (points * points).sum(axis=1)
        far = squares[:, None] + squares[None, :] - 2 * points @ points.T
        np.fill_diagonal(far, np.inf)
        if len(nodes) > most:
            return nodes[np.argpartition(far, most - 1, axis=1)[:, :most]].astype(np.int32)
        return np.where(np.isinf(far), -1, nodes[None, :]).astype(np.int32)

    def _connect(self, nodes: np.ndarray, near: np.ndarray, layer: int, width: int) -> None:
        """Links ``nodes`` with chosen candidates, and these with them."""
        rows, most = self.layers[layer], self.layers[layer].shape[1]
        rows[nodes] = self._chosen(nodes, near, most, width)
        source = np.repeat(nodes, most)
        target = rows[nodes].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.lexsort((((self.points[source] - self.points[target]) ** 2).sum(axis=1), target))
        source, target = source[order], target[order]
        hubs, begin, counts = np.unique(target, return_index=True, return_counts=True)
        # no more than the nearest that fit can be chosen
        coming, place = np.full((len(hubs), most), -1, np.int32), np.arange(len(target)) - np.repeat(begin, counts)
        hub, fits = np.repeat(np.arange(len(hubs)), counts), place < most
        coming[hub[fits], place[fits]] = source[fits]
        # what is linked already stands first and is told apart from what comes
        both = np.concatenate([rows[hubs], np.where((coming[:, :, None] == rows[hubs][:, None, :]).any(axis=2), -1, coming)], axis=1)
        rows[hubs] = self._chosen(hubs, both, most, both.shape[1])

    def _chosen(self, nodes: np.ndarray, near: np.ndarray, most: int, width: int) -> np.ndarray:
        """Of each node's candidates (-1: none) the nearest that lie nearer to it than to one chosen before; what is left over fills free places."""
        out = np.full((len(nodes), most), -1, np.int32)
        for at in range(0, len(nodes), 256):
            part, some = nodes[at : at + 256], near[at : at + 256]
            away = self.points[some] - self.points[part][:, None, :]
            far = np.where(some < 0, np.inf, np.einsum("bcd,bcd->bc", away, away))
            keep = min(width, some.shape[1])
            order = np.argsort(far, axis=1, kind="stable")[:, :keep]
            some, far, away = np.take_along_axis(some, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(away, order[:, :, None], 1)
            there = np.isfinite(far)
            between = far[:, :, None] + far[:, None, :] - 2 * away @ away.transpose(0, 2, 1)
            nearer = between < far[:, :, None]
            taken, hidden = np.zeros(some.shape, bool), ~there
            for k in range(some.shape[1]):
                taken[:, k] = ~hidden[:, k]
                hidden |= taken[:, k, None] & nearer[:, :, k]
            taken &= np.cumsum(taken, axis=1) <= most
            # chosen ones first, then the others, each by distance
            order = np.argsort(np.where(there, np.where(taken, 0, 1), 2), axis=1, kind="stable")[:, :most]
            out[at : at + 256, : order.shape[1]] = np.take_along_axis(some, order, 1)
        return out

    def _search(self, queries: np.ndarray, entry: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances): for each query the ``width`` nearest that a search from its entries meets, nearest first, -1 where there are fewer."""
        rows, n = self.layers[layer], len(queries)
        seen = np.zeros((n, len(self.points)), bool)
        nodes, far = np.full((n, width), -1, np.int32), np.full((n, width), np.inf, np.float32)
        k = min(width, entry.shape[1])
        away = self.points[entry] - queries[:, None, :]
        first = np.where(entry < 0, np.inf, np.einsum("bcd,bcd->bc", away, away))
        order = np.argsort(first, axis=1, kind="stable")[:, :k]
        nodes[:, :k], far[:, :k] = np.take_along_axis(entry, order, 1), np.take_along_axis(first, order, 1)
        nodes[~np.isfinite(far)] = -1
        who, which = np.nonzero(nodes >= 0)
        seen[who, nodes[who, which]] = True
        opened = nodes < 0
        while True:
            live = np.flatnonzero(~opened.all(axis=1))
            if not len(live):
                return nodes, far
            at = np.argmin(opened[live], axis=1)
            opened[live, at] = True
            next_ = rows[nodes[live, at]]
            fresh = (next_ >= 0) & ~seen[live[:, None], next_]
            some = fresh.any(axis=1)
            live, next_, fresh = live[some], next_[some], fresh[some]
            if not len(live):
                continue
            who, which = np.nonzero(fresh)
            seen[live[who], next_[who, which]] = True
            away = self.points[next_[who, which]] - queries[live[who]]
            distance = np.full(next_.shape, np.inf, np.float32)
            distance[who, which] = np.einsum("cd,cd->c", away, away)
            all_far = np.concatenate([far[live], distance], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            far[live] = np.take_along_axis(all_far, order, 1)
            nodes[live] = np.where(np.isfinite(far[live]), np.take_along_axis(np.concatenate([nodes[live], next_], axis=1), order, 1), -1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros(next_.shape, bool)], axis=1), order, 1) | (nodes[live] < 0)

    def search(self, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        """The nodes found for each query, nearest first, -1 where there are fewer than ``width``."""
        entry = np.full((len(queries), 1), self.start, np.int32)
        for layer in range(int(self.levels[self.start]), 0, -1):
            entry = self._search(queries, entry, layer, 1)[0]
        return self._search(queries, entry, 0, width)[0]

    def flat(self) -> np.ndarray:
        """All links in one array: layer by layer, the rows of the nodes that reach it."""
        return np.concatenate([rows[self.levels >= k].reshape(-1) for k, rows in enumerate(self.layers)])

    @classmethod
    def of_flat(cls, points: np.ndarray, levels: np.ndarray, neighbours: np.ndarray, links: int) -> Graph:
        layers, at = [], 0
        for k in range(int(levels.max(initial=0)) + 1):
            own, width = levels >= k, links * (1 if k else 2)
            rows = np.full((len(levels), width), -1, np.int32)
            rows[own] = neighbours[at : at + int(own.sum()) * width].reshape(-1, width)
            at += int(own.sum()) * width
            layers.append(rows)
        return cls(points, levels, layers)


def taking_part(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): rows whose vector is finite, not zero and of the length that most vectors have."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(finite("v")).where(F.exists("v", lambda c: c != 0))
    return rows.where(F.size("v") == usual_length(rows, "v"))


SHARD = "shard int, node array<long>, ids array<array<long>>, level array<tinyint>, links int, neighbours array<int>, vectors {}"


class GraphIndex:
    """An index in a folder of the shared file system: a row for each shard.

    ``node`` are numbers of distinct vectors, ``vectors`` holds these one after another, ``ids`` the ``copies`` smallest vec_ids of each, ``level`` the
    top layer of each, ``neighbours`` the links of all layers. Every distinct vector is in one shard.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def shards(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    @classmethod
    def build(cls, rows: DataFrame, path: str, copies: int, shard_rows: int = SHARD_ROWS, links: int = LINKS, width: int = WIDTH) -> GraphIndex:
        """Indexes all ``rows`` (vec_id, v). Of equal vectors, the ids beyond the ``copies`` smallest are never among that many nearest."""
        scratch, kind = Scratch(), rows.schema["v"].dataType.simpleString()
        # a limit of ranks is applied before the shuffle, so a vector of very many rows sends a few from each task
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last()))).where(F.col("rank") <= copies)
        nodes = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.count_if(F.col("vec_id").isNull()).alias("nulls"))
        ids = F.concat("ids", F.array_repeat(F.lit(None).cast("long"), F.col("nulls").cast("int")))
        nodes = scratch.written(nodes.select(F.monotonically_increasing_id().alias("node"), "v", ids.alias("ids")), "nodes")
        count = max(1, -(-nodes.count() // shard_rows))
        dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(count)).cast("int"))
        value = pa.float32() if kind == "array<float>" else pa.float64()

        def one(table: pa.Table) -> pa.Table:
            table = table.sort_by("node").combine_chunks()
            vectors = matrix(table.column("v"))
            graph = Graph.build(unit(vectors).astype(np.float32), links, width)
            columns = {
                "shard": table.column("shard").slice(0, 1), "node": [table.column("node").to_pylist()], "ids": [table.column("ids").to_pylist()],
                "level": list_column(graph.levels[None]), "links": pa.array([links], pa.int32()), "neighbours": list_column(graph.flat()[None]), "vectors": list_column(vectors.reshape(1, -1)),
            }
            return pa.table([columns[f.name] for f in schema], schema=schema)

        of = {"shard": pa.int32(), "node": pa.list_(pa.int64()), "ids": pa.list_(pa.list_(pa.int64())), "level": pa.list_(pa.int8()), "links": pa.int32(), "neighbours": pa.list_(pa.int32()), "vectors": pa.list_(value)}
        schema = pa.schema(list(of.items()))
        dealt.repartitionById(count, "shard").groupBy("shard").applyInArrow(one, SHARD.format("array<float>" if kind == "array<float>" else "array<double>")).write.parquet(path)
        scratch.close()
        return cls(rows.sparkSession, path)

    def nearest(self, queries: DataFrame, k: int, width: int = SEARCH_WIDTH, block: int = BLOCK) -> DataFrame:
        """(query, node, ids, score): for each of ``queries`` (query, v), distinct numbers, the ``k`` nearest distinct vectors found, by exact cosines.

        Blocks of queries meet every shard: a stated set of queries against all rows. Each shard sends its k best of a query.
        """
        shards, some = self.shards(), max(1, -(-queries.count() // block))
        packed = queries.groupBy(F.pmod(F.xxhash64("query"), F.lit(some)).alias("block")).agg(F.collect_list(F.struct("query", "v")).alias("asked"))
        last = shards.agg(F.max("shard")).first()[0]
        if last is None:
            return self.spark.createDataFrame([], "query long, node long, ids array<long>, score double")
        each = packed.select("block", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"), "asked").repartition(last + 1, "shard")
        met = each.join(shards.repartition(last + 1, "shard").hint("merge"), "shard")

        def one(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            asked = table.column("asked").chunk(0).flatten()
            numbers, vectors = asked.field("query").to_numpy(), matrix(asked.field("v"))
            nodes = np.array(table.column("node")[0].values)
            own = matrix(pa.FixedSizeListArray.from_arrays(table.column("vectors")[0].values, vectors.shape[1]))
            graph = Graph.of_flat(unit(own).astype(np.float32), np.array(table.column("level")[0].values), np.array(table.column("neighbours")[0].values), table.column("links")[0].as_py())
            ids, out = table.column("ids")[0].values, ([], [], [])
            for at in range(0, len(numbers), 256):
                for query, vector, found in zip(numbers[at : at + 256], vectors[at : at + 256], graph.search(unit(vectors[at : at + 256]).astype(np.float32), width)):
                    found = found[found >= 0]
                    score = cosines(vector, own[found])
                    best = np.lexsort((nodes[found], -score))[:k]
                    out[0].append(np.full(len(best), query))
                    out[1].append(found[best])
                    out[2].append(score[best])
            query, node, score = (np.concatenate(x) if x else np.zeros(0) for x in out)
            return pa.table([pa.array(query, pa.int64()), pa.array(nodes[node.astype(int)], pa.int64()), ids.take(pa.array(node, pa.int64())), pa.array(score, pa.float64())], schema=schema)

        schema = pa.schema({"query": pa.int64(), "node": pa.int64(), "ids": pa.list_(pa.int64()), "score": pa.float64()})
        found = met.groupBy("shard", "block").applyInArrow(one, "query long, node long, ids array<long>, score double")
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.get("ids", F.lit(0)).asc_nulls_last(), "node")
        return found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).drop("at")


def nearest_neighbours(df: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (rows of ``df``) the ``k`` nearest other rows found, all if there are fewer.

    The score is the cosine in double precision; of equal scores the smaller vec_id comes first, null ones last. Rows whose vector is null, empty, zero, of another length than
    most or holds null or non-finite components take no part. Rows that repeat a vec_id are rows of their own: each is asked for, and each is found by
    the others. Equal vectors are one node, so copies cost nothing and are told apart by their ids alone. An empty table yields no rows.
    """
    spark, scratch = df.sparkSession, Scratch()
    rows = taking_part(df, vec_id, vector)
    index = GraphIndex.build(rows, fresh_path(spark, "graph-index"), copies=k + 1, shard_rows=shard_rows)
    asked = queries.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).alias("v")).join(rows.limit(1).select(F.size("v").alias("d")).hint("broadcast"), F.size("v") == F.col("d"))
    asked = scratch.written(asked.where(finite("v")).where(F.exists("v", lambda c: c != 0)).select("query_id", "v").withColumn("row", F.monotonically_increasing_id()), "asked")
    distinct = scratch.written(asked.groupBy("v").agg(F.min("row").alias("query")), "queries")
    found = scratch.written(index.nearest(distinct.select("query", "v"), k + 1, width), "found")
    # Of a query's own row, one entry with its id goes: from its own vector, which comes first unless another one's rounding is better.
    same = asked.join(distinct, "v").select("row", "query_id", "query")
    each = same.join(found, "query").select("row", "query_id", "score", F.posexplode("ids").alias("at", "vec_id"))
    own = F.when(F.col("vec_id").eqNullSafe(F.col("query_id")), 0).otherwise(1)
    first = Window.partitionBy("row").orderBy(own, F.desc("score"), "at")
    others = each.withColumn("first", F.row_number().over(first)).where((own == 1) | (F.col("first") > 1))
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = others.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    result = written(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
    scratch.close()
    discard(index.shards())
    return result
