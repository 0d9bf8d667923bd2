"""Nearest neighbours by inner product with vantage-point trees, one per shard.

Vectors of one dimension get one more coordinate that makes all of them equally long; then the
largest inner product is the least Euclidean distance, and the triangle inequality may prune. Rows are
dealt to shards by a hash of their id, so a vector that fills a third of the table is spread
evenly; within a shard equal vectors are one point that keeps its k + 1 least ids, which is all that
any query can need of it. Every shard gets every query of its dimension (the stated query set, in
blocks that are tasks of their own) and returns its k best; a window keeps the k best of all shards.

A branch is left out if its least possible distance times ``relax`` exceeds the k-th distance so
far. ``relax`` = 1 is exact search; more prunes more and may lose neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 20
RELAX = 1.1
SHARD_ROWS = 16384
LEAF = 128
QUERY_ROWS = 65536  # queries that one task searches its shard for
BLOCK = 512  # queries searched together
SLACK = 1e-6  # of rounding: distances come from a difference of squares


class Tree:
    """A vantage-point tree over rows of ``points``; nodes are (point, radius bounds of both sides, children)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.points = points
        self.rng = np.random.default_rng(seed)
        self.leaf = leaf
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (vantage row, inner low, inner high, outer low, outer high, inner node, outer node) or (start, end)
        self.root = self._build(0, len(points)) if len(points) else -1

    def _build(self, start: int, end: int) -> int:
        todo, root = [(start, end, -1, 0)], -1
        while todo:  # a stack instead of recursion: depth does not matter
            a, b, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][5 + side] = at
            else:
                root = at
            if b - a <= self.leaf:
                self.nodes.append([a, b])
                continue
            pick = a + int(self.rng.integers(b - a))
            self.order[[a, pick]] = self.order[[pick, a]]
            rest = self.order[a + 1 : b]
            dist = distances(self.points[self.order[a]][None], self.points[rest])[0]
            by = np.argsort(dist, kind="stable")
            self.order[a + 1 : b], dist = rest[by], dist[by]
            mid = (b - a - 1) // 2
            self.nodes.append([self.order[a], dist[0], dist[mid - 1], dist[mid], dist[-1], -1, -1])
            todo += [(a + 1 + mid, b, at, 1), (a + 1, a + 1 + mid, at, 0)]
        return root

    def search(self, queries: np.ndarray, k: int, relax: float) -> list[np.ndarray]:
        """Rows of ``points`` no farther than the k-th nearest of each query, all that tie with it included (if ``relax`` is 1; else of those met).

        Points and queries of length 1 at most are expected: ``SLACK`` is for their rounding.
        """
        best_d = np.full((len(queries), k), np.inf)
        limit = np.full(len(queries), np.inf)
        if self.root < 0:
            return [np.empty(0, np.int64)] * len(queries)
        met: list[list[np.ndarray]] = [[], [], []]

        def offer(who: np.ndarray, rows: np.ndarray, dist: np.ndarray, keep: bool) -> None:
            d = np.concatenate([best_d[who], dist], axis=1)
            best_d[who] = np.partition(d, k - 1, axis=1)[:, :k]
            limit[who] = np.minimum(limit[who], best_d[who].max(axis=1))
            if keep:
                i, j = np.nonzero(dist <= limit[who][:, None] + SLACK)
                for x, y in zip(met, (who[i], rows[j], dist[i, j])):
                    x.append(y)

        everyone = np.arange(len(queries))
        # First each query alone goes to its own leaf, for a k-th distance to prune by.
        todo = [(self.root, everyone)]
        while todo:
            at, who = todo.pop()
            node = self.nodes[at]
            if len(node) == 2:
                rows = self.order[node[0] : node[1]]
                offer(who, rows, distances(queries[who], self.points[rows]), False)
                continue
            d = distances(queries[who], self.points[node[0]][None])[:, 0]
            near = d < (node[2] + node[3]) / 2
            todo += [(child, who[side]) for child, side in ((node[5], near), (node[6], ~near)) if side.any()]
        best_d[:] = np.inf  # each point is met once from here on
        todo = [(self.root, everyone)]
        while todo:
            at, who = todo.pop()
            node = self.nodes[at]
            if len(node) == 2:
                rows = self.order[node[0] : node[1]]
                offer(who, rows, distances(queries[who], self.points[rows]), True)
                continue
            d = distances(queries[who], self.points[node[0]][None])[:, 0]
            offer(who, np.array([node[0]]), d[:, None], True)
            near = d < (node[2] + node[3]) / 2
            turns = []
            for child, low, high in ((node[5], node[1], node[2]), (node[6], node[3], node[4])):
                least = np.maximum(0, np.maximum(d - high, low - d))
                into = least * relax <= limit[who] + SLACK
                turns.append((child, who[into], (near[into] if child == node[5] else ~near[into]).mean() if into.any() else 0))
            # The side where more queries lie is searched first: it lowers their limits.
            todo += [(child, w) for child, w, _ in sorted(turns, key=lambda x: x[2]) if len(w)]
        who, rows, dist = (np.concatenate(x) for x in met) if met[0] else (np.empty(0, np.int64),) * 3
        ok = dist <= limit[who] + SLACK
        who, rows = who[ok], rows[ok]
        by = np.argsort(who, kind="stable")
        return np.split(rows[by], np.searchsorted(who[by], np.arange(1, len(queries))))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(s, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed from the first component to the last whatever the shape."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Shard:
    """The vectors of one shard and the tree over its different ones, scaled to a length of 1 at most."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by = np.lexsort([ids, *vectors.T[::-1]])
        self.ids, vectors = ids[by], vectors[by]
        new = np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)]
        self.start = np.flatnonzero(new)
        self.count = np.diff(np.r_[self.start, len(ids)])
        self.points = vectors[self.start]
        unit = self.points / np.abs(self.points).max()
        length = (unit * unit).sum(1)
        self.tree = Tree(np.c_[unit, np.sqrt(np.maximum(length.max() - length, 0))] / np.sqrt(length.max()))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float) -> list[np.ndarray]:
        """(query id, vector id, score) of the k best of each query, its own row left out."""
        out: list[list[np.ndarray]] = [[], [], []]
        # One query for each different vector; its answer serves all that hold it.
        uq, which = np.unique(queries, axis=0, return_inverse=True)
        members = np.argsort(which, kind="stable")
        bounds = np.r_[0, np.cumsum(np.bincount(which, minlength=len(uq)))]
        for at in range(0, len(uq), BLOCK):
            q = uq[at : at + BLOCK]
            unit = q / np.abs(q).max(1, keepdims=True)  # the order of a query's neighbours doesn't depend on its length
            unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
            found = self.tree.search(np.c_[unit, np.zeros(len(q))], k + 1, relax)
            for j, rows in enumerate(found):
                score = products(np.broadcast_to(q[j], (len(rows), q.shape[1])), self.points[rows])
                many = np.minimum(self.count[rows], k + 1)  # a point stands for its rows of least id
                first = np.repeat(self.start[rows] - np.r_[0, np.cumsum(many)[:-1]], many)
                vid, sc = self.ids[first + np.arange(many.sum())], np.repeat(score, many)
                order = np.lexsort([vid, -sc])[: k + 1]
                vid, sc = vid[order], sc[order]
                for m in members[bounds[at + j] : bounds[at + j + 1]]:
                    keep = np.flatnonzero(vid != query_ids[m])[:k]
                    out[0].append(np.full(len(keep), query_ids[m]))
                    out[1].append(vid[keep])
                    out[2].append(sc[keep])
        return [np.concatenate(x) if x else np.empty(0) for x in out]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with an id and a vector that is not null or empty, has finite components only, and not all zero."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, relax: float = RELAX, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` rows of largest inner product, ties to the smaller id.

    A query takes no part as its own candidate (by id). Only vectors of one dimension compare. Unusable
    vectors (null, zero, null or non-finite components, null id) take no part on either side. A
    repeated id counts once for each of its different vectors as a candidate; as a query it stands for its
    least vector. Empty tables give an empty result. Other columns are ignored. A task holds one shard of about ``shard_rows``
    vectors and gets its queries, at most about ``query_rows`` of them, as a stream.
    """
    cand = usable(vectors, id_col, vector_col).distinct()
    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    shards = max(1, -(-cand.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_rows))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    cand = cand.withColumn("shard", dealt(shards)).withColumn("block", everywhere(blocks)).withColumn("asks", F.lit(False))
    asked = asked.withColumn("block", dealt(blocks)).withColumn("shard", everywhere(shards)).withColumn("asks", F.lit(True))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = cand.unionByName(asked).repartition(parts, "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "asks", "vec_id")

    def matrix(t) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def run(batches):
        held, key, shard = [], None, None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            keys = np.c_[tuple(batch.column(c).to_numpy() for c in ("dim", "shard", "block"))] if batch.num_rows else np.empty((0, 3))
            turn = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (asks[1:] != asks[:-1])]) if batch.num_rows else []
            for a, b in zip(turn, [*turn[1:], batch.num_rows]):
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if tuple(keys[a]) != key:
                    held, key, shard = [], tuple(keys[a]), None
                if not asks[a]:
                    held.append(part)
                    continue
                if held:  # all candidates of the shard come before its queries
                    whole = pa.concat_tables(held)
                    shard, held = Shard(whole.column("vec_id").to_numpy(), matrix(whole)), []
                if shard is not None:
                    got = shard.search(part.column("vec_id").to_numpy(), matrix(part), k, relax)
                    yield pa.RecordBatch.from_arrays([pa.array(got[0].astype(np.int64)), pa.array(got[1].astype(np.int64)), pa.array(got[2].astype(np.float64))], ["query_id", "vec_id", "score"])

    found = both.select("dim", "shard", "block", "asks", "vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


OP1_SQL = """
with v as (select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null),
ok as (select vec_id, e from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from ok q join ok c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""
