"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Rows are dealt to shards of bounded size, each of which becomes one ball tree.
Queries form blocks; a task takes a block through its shards, one after
another, and the k-th score so far prunes in the next shard what can't beat it:
balls level by level, then leaves, best upper bound first. A block's shards may
be split over several tasks, whose lists of k are merged. All arithmetic on
scores is exact.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affectra.functions.cluster import ship

from .common import column, written

#: Bytes of a shard's and a block's vectors as longs, on average; rows of a leaf at most; tasks that search at once, at least, where there are as many shards.
SHARD_BYTES, BLOCK_BYTES, LEAF_ROWS, TASKS = 4 << 20, 4 << 20, 128, 64
#: Scores below this are exact as doubles, whatever the order of their sums.
EXACT = 2.0**52
_LAST = np.iinfo(np.int64).max


def build(ids: np.ndarray, x: np.ndarray) -> dict:
    """A balanced ball tree: rows in order of leaves, and each level's bounds, centres, radii and least ids.

    A node is halved at the median along the line between two points far apart.
    """
    order, bounds, levels = np.arange(len(x)), np.array([0, len(x)]), []
    f = x.astype(np.float64)
    while True:
        centres = np.stack([f[order[a:b]].mean(axis=0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        radii = np.array([np.sqrt(((f[order[a:b]] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(bounds[:-1], bounds[1:], centres, strict=True)])
        levels.append((bounds, centres, radii, np.array([ids[order[a:b]].min() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])))
        if np.diff(bounds).max() <= LEAF_ROWS:
            return {"ids": ids[order], "x": x[order], "levels": levels}
        halves = [0]
        for a, b, c in zip(bounds[:-1], bounds[1:], centres, strict=True):
            node = order[a:b]
            far = f[node[((f[node] - c) ** 2).sum(axis=1).argmax()]]
            other = f[node[((f[node] - far) ** 2).sum(axis=1).argmax()]]
            order[a:b] = node[np.argsort((f[node] * (other - far)).sum(axis=1), kind="stable")]
            halves += [(a + b) // 2, b]
        bounds = np.array(halves)


class Block:
    """Queries with their k best rows so far: scores downwards, equal scores by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.f = ids, x, x.astype(np.float64)
        self.norm = np.sqrt((self.f**2).sum(axis=1))
        self.scores = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), _LAST)
        self.filled = np.zeros((len(ids), k), dtype=bool)
        self.visits = 0

    def _worth(self, q: np.ndarray, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether balls with these upper bounds and least ids may change the lists of queries q."""
        kth, last = self.scores[q, -1].astype(np.float64), self.found[q, -1]
        return (bound > kth) | ((bound >= kth) & (least < last)) | ~self.filled[q, -1]

    def search(self, tree: dict) -> None:
        """Takes in all rows of a tree but each query's own."""
        every = np.arange(len(self.ids))
        alive = np.ones((len(self.ids), 1), dtype=bool)
        for i, (_, centres, radii, least) in enumerate(tree["levels"]):
            if i:
                alive = np.repeat(alive, 2, axis=1)
            reach = self.norm[:, None] * (np.sqrt((centres**2).sum(axis=1)) + radii)
            bound = np.where(alive, self.f @ centres.T + self.norm[:, None] * radii, -np.inf)
            bound = np.floor(bound + 1e-9 * reach + 1e-6)  # rounding never lowers a bound below a score
            alive &= self._worth(every[:, None], bound, least[None, :])
        bounds, _, _, least = tree["levels"][-1]
        bound = np.where(alive, bound, -np.inf)
        own = self._own(tree)
        rank = np.argsort(-bound, axis=1, kind="stable")
        for j in range(rank.shape[1]):
            leaf = rank[:, j]
            q = np.flatnonzero(alive[every, leaf])
            q = q[self._worth(q, bound[q, leaf[q]], least[leaf[q]])]
            # a later leaf of smaller id may still matter at an equal bound, so queries go on until their leaves end
            order = q[np.argsort(leaf[q], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                if len(part):
                    self._visit(part, tree, bounds[leaf[part[0]]], bounds[leaf[part[0]] + 1], own[part])

    def _own(self, tree: dict) -> np.ndarray:
        """The place of each query's own row in the tree, -1 where it has none."""
        order = np.argsort(tree["ids"], kind="stable")
        ids, out = tree["ids"][order], np.full(len(self.ids), -1)
        first, stop = np.searchsorted(ids, self.ids), np.searchsorted(ids, self.ids, side="right")
        for q in np.flatnonzero(first < stop).tolist():
            for at in order[first[q] : stop[q]].tolist():
                if np.array_equal(tree["x"][at], self.x[q]):
                    out[q] = at
                    break
        return out

    def _visit(self, q: np.ndarray, tree: dict, a: int, b: int, own: np.ndarray) -> None:
        self.visits += len(q)
        x, ids = tree["x"][a:b], tree["ids"][a:b]
        f = x.astype(np.float64)
        if self.norm[q].max() * np.sqrt((f**2).sum(axis=1).max()) < EXACT:
            scores = (self.f[q] @ f.T).astype(np.int64)
        else:
            scores = np.einsum("ij,kj->ik", self.x[q], x.astype(np.int64))
        fresh = np.ones(scores.shape, dtype=bool)
        here = np.flatnonzero((own >= a) & (own < b))
        fresh[here, own[here] - a] = False
        kth, last = self.scores[q, -1:], self.found[q, -1:]
        better = fresh & ((scores > kth) | ((scores == kth) & (ids < last)) | ~self.filled[q, -1:])
        rows = np.flatnonzero(better.any(axis=1))
        if not len(rows):
            return
        at, k = q[rows], self.scores.shape[1]
        s = np.concatenate([self.scores[at], scores[rows]], axis=1)
        i = np.concatenate([self.found[at], np.broadcast_to(ids, (len(rows), b - a))], axis=1)
        ok = np.concatenate([self.filled[at], better[rows]], axis=1)
        best = np.lexsort((i, -s, ~ok), axis=1)[:, :k]
        line = np.arange(len(rows))[:, None]
        self.scores[at], self.found[at], self.filled[at] = s[line, best], i[line, best], ok[line, best]


def _points(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(scale * component) of rows that take part."""
    v = column(vector_col)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(column(id_col).cast("long").alias("id"), v.cast("array<double>").alias("e"))
    return rows.where(F.col("id").isNotNull() & F.col("e").isNotNull() & F.forall("e", number)).select("id", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one length, in order of id and vector, so that a task run again makes the same."""
    ids = table.column("id").to_numpy()
    x = table.column("v").combine_chunks()
    x = np.asarray(x.flatten(), dtype=np.int64).reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids)) if x.shape[1] else np.argsort(ids, kind="stable")
    return ids[order], x[order]


def _small(x: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


PACKED = "width int, p int, data binary"


def _packed(points: DataFrame, by: list[str], parts: int, make) -> DataFrame:
    """One row per width and part of the points by a hash of columns, whose ids and vectors `make` packs."""
    part = F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")

    def run(table: pa.Table) -> pa.Table:
        ids, x = _matrix(table)
        return pa.table({"width": pa.array([x.shape[1]], pa.int32()), "p": pa.array([table.column("p")[0].as_py()], pa.int32()), "data": pa.array([pickle.dumps(make(ids, x))], pa.binary())})

    return points.select(F.size("v").alias("width"), part.alias("p"), "id", "v").groupBy("width", "p").applyInArrow(run, PACKED)


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, tasks: int = TASKS) -> DataFrame:
    """The k rows of greatest inner product for each row that is_query holds for: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x), x as double; scores are their exact
    inner products (as far as these fit a long). Ties go to the smaller id.
    All rows are candidates but the query's own. is_query is a condition on the
    column `id`. A query that has fewer candidates gets all of them. Rows without
    id take no part, as no result could name them, nor do vectors that are null
    or hold null, NaN or infinite components; vectors meet those of their own
    length only. Repeated rows are rows of their own: each is a candidate to the
    other, and each query row has its results. An empty table gives no rows;
    other columns may have any names.

    Of equal vectors the k + 1 smallest ids take part as candidates: no query's
    list can hold more. shard_bytes, block_bytes and tasks bound what a task
    holds and set how work is dealt; results don't depend on them.
    """
    spark = vectors.sparkSession
    ship(spark)
    points = written(_points(vectors, scale, id_col, vector_col), "points")
    code = F.xxhash64("v")
    along = Window.partitionBy("code", "v").orderBy("id")
    # the limit on ranks is applied before the shuffle, so a very common vector leaves each task k + 1 times
    kept = points.withColumn("code", code).withColumn("copy", F.row_number().over(along)).where(F.col("copy") <= k + 1).select("id", "v")
    asked = points.where(is_query).withColumn("copy", F.monotonically_increasing_id())
    size = 8 * (F.size("v") + 1)
    total, part = points.agg(F.sum(size), F.sum(F.when(is_query, size))).first()
    shards, blocks = max(1, -(-(total or 0) // shard_bytes)), max(1, -(-(part or 0) // block_bytes))
    groups = min(shards, -(-tasks // blocks))
    # rows equal in id and vector, k + 1 at most, share a shard, so that a query leaves out one of them; repeated queries are dealt one by one
    trees = written(_packed(kept, ["id", "v"], shards, lambda ids, x: build(ids, _small(x))), "trees")
    queries = written(_packed(asked, ["id", "v", "copy"], blocks, lambda ids, x: (ids, x)), "queries")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # a block goes ahead of its shards
    dealt = queries.select("width", F.col("p").alias("block"), each(groups).alias("g"), F.lit(-1).alias("shard"), "data").unionByName(
        trees.select("width", each(blocks).alias("block"), F.pmod("p", F.lit(groups)).alias("g"), F.col("p").alias("shard"), "data"))
    number = F.col("block") * groups + F.col("g")
    dealt = dealt.repartition(min(blocks * groups, 1 << 16), "width", number).sortWithinPartitions("width", "block", "g", "shard")

    def run(batches):
        key, block = None, None

        def results():
            if block is None:
                return
            q, r = np.nonzero(block.filled)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(q), pa.int32()), pa.array([key[1]] * len(q), pa.int32()), pa.array(q, pa.int32()), pa.array(block.ids[q], pa.int64()), pa.array(block.found[q, r], pa.int64()), pa.array(block.scores[q, r], pa.int64())], names=["width", "block", "q", "query_id", "vec_id", "score"])

        for b in batches:
            for width, number, g, shard, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if shard == -1:
                    yield from results()
                    key, block = (width, number), Block(*pickle.loads(data), k)
                elif (width, number) == key:
                    block.search(pickle.loads(data))
                else:  # trees of a length without queries
                    yield from results()
                    key, block = None, None
        yield from results()

    lists = dealt.mapInArrow(run, "width int, block int, q int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("width", "block", "q").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
