"""Exact top-k by inner product with M-trees.

Vectors become integers and equal ones one object. Objects are dealt to the nearest of sampled pivots; each shard
is an M-tree of pages with covering radii and parent distances, in the space with one more coordinate in which the
nearest object has the largest inner product. A query first searches its home shard; the score found there and the
shards' balls tell which other shards can hold better ones, and only those are searched. Objects are never copied:
queries go to the trees that may hold what they need and stream through them. A shard over the size of a tree is
several trees, so a task's memory has a bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from slabwise.llm.common import bounded_batches, release, written

#: Objects in a shard (about), in a tree (at most, about), in a page; children of a node.
SHARD, TREE, PAGE, FANOUT = 8192, 32_768, 128, 16
#: Pivots that are broadcast, at most. With more objects shards grow, but are cut into trees.
PIVOTS = 2048
_SLACK = 1e-6


class MTree:
    """Bulk-loaded M-tree. Nodes hold routing objects with covering radius and distance to the parent object; pages
    hold objects with their distance to the page's routing object."""

    def __init__(self, x: np.ndarray, seed: int = 5) -> None:
        self.x = x
        f = x.astype(np.float64)
        norm = (f * f).sum(axis=1)
        self.top = float(norm.max()) if len(x) else 0.0
        self.f = np.hstack([f, np.sqrt(np.maximum(self.top - norm, 0))[:, None]])
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.computed = 0
        self.root = self._build(np.arange(len(x)), None)

    def _build(self, at: np.ndarray, parent: np.ndarray | None) -> int:
        if len(at) <= PAGE:
            gap = np.sqrt(((self.f[at] - parent) ** 2).sum(axis=1)) if parent is not None else np.zeros(len(at))
            self.nodes.append(("page", at, gap))
            return len(self.nodes) - 1
        picks = self.rng.choice(at, FANOUT, replace=False)
        centres = self.f[picks]
        near = ((self.f[at] ** 2).sum(axis=1)[:, None] - 2 * self.f[at] @ centres.T + (centres**2).sum(axis=1)[None, :]).argmin(axis=1)
        groups = [(centres[j], at[near == j]) for j in range(FANOUT) if (near == j).any()]
        if len(groups) == 1:  # all as near: cut evenly
            groups = [(centres[0], g) for g in np.array_split(at, -(-len(at) // PAGE))]
        kids = [self._build(g, c) for c, g in groups]
        radius = np.array([np.sqrt(((self.f[g] - c) ** 2).sum(axis=1)).max() for c, g in groups])
        middle = np.array([c for c, _ in groups])
        gap = np.sqrt(((middle - parent) ** 2).sum(axis=1)) if parent is not None else np.zeros(len(groups))
        self.nodes.append(("node", middle, radius, gap, kids))
        return len(self.nodes) - 1

    def search(self, q: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of every object whose score is among the k largest of a query of the block ``q``, ties
        included, and at least the query's ``least`` (-inf: none).

        Nodes are taken in the order of their least possible distance to any query that may still need them. A stored
        distance to the parent rules out a child for a query before its own distance is computed.
        """
        m = len(q)
        qf = np.hstack([q.astype(np.float64), np.zeros((m, 1))])
        own = (qf * qf).sum(axis=1)
        floor = np.full(m, -np.inf) if least is None else least.astype(np.float64)

        def reach(s: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(np.isinf(s), np.inf, np.sqrt(np.maximum(0.0, own[at] + self.top - 2.0 * np.where(np.isinf(s), 0, s)))) * (1 + _SLACK) + _SLACK

        far = reach(floor, np.arange(m))
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * q.shape[1] < 2**53
        best = np.full((m, k), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo: list[tuple] = [(0.0, 0, self.root, np.arange(m), np.zeros(m), None)]
        pushed = 0
        while todo:
            _, _, at, active, low, d_parent = heapq.heappop(todo)
            need = low <= far[active]
            active, d_parent = active[need], d_parent if d_parent is None else d_parent[need]
            if not len(active):
                continue
            node = self.nodes[at]
            if node[0] == "page":
                rows = node[1]
                if d_parent is not None:
                    rows = rows[(np.abs(node[2][:, None] - d_parent[None, :]) <= far[active][None, :]).any(axis=1)]
                if not len(rows):
                    continue
                self.computed += len(rows) * len(active)
                s = (self.f[rows, :-1] @ qf[active, :-1].T).T if exact else (self.x[rows] @ q[active].T).T
                good = s >= floor[active][:, None]
                which, col = np.nonzero(good)
                found.append((active[which], rows[col], s[which, col].astype(np.int64)))
                top = np.partition(np.hstack([best[active], s]), s.shape[1], axis=1)[:, s.shape[1] :]
                best[active] = top
                floor[active] = np.maximum(floor[active], top.min(axis=1))
                far[active] = reach(floor[active], active)
                if sum(len(x[0]) for x in found[1:]) > 1 << 20:
                    found = [self._kept(found, floor)]
                continue
            _, middle, radius, gap, kids = node
            can = np.ones((len(kids), len(active)), bool) if d_parent is None else np.abs(gap[:, None] - d_parent[None, :]) - radius[:, None] <= far[active][None, :]
            for j in np.flatnonzero(can.any(axis=1)).tolist():
                some = active[can[j]]
                self.computed += len(some)
                d = np.sqrt(np.maximum(0.0, own[some] - 2.0 * (qf[some] @ middle[j]) + float(middle[j] @ middle[j])))
                lowest = np.maximum(0.0, d * (1 - _SLACK) - radius[j] - _SLACK)
                keep = lowest <= far[some]
                if keep.any():
                    pushed += 1
                    heapq.heappush(todo, (float(lowest[keep].min()), pushed, kids[j], some[keep], lowest[keep], d[keep]))
        return self._kept(found, floor)

    @staticmethod
    def _kept(found: list[tuple], floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not found:
            return (np.zeros(0, np.int64),) * 3
        q, r, s = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = s >= floor[q]
        return q[keep], r[keep], s[keep]


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): components floor(scale * x); rows that are null or hold null or non-finite components are left out."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, *, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row of ``vectors`` for which ``is_query`` (on column id) holds, the k other
    rows with the largest integer inner product, ties to the smaller id.

    Vectors are compared with those of their own dimension; null ids take no part. Rows that repeat an id and vector
    count once; rows that share an id but not the vector are rows of their own, each asked and each found. Components
    so large that a score could leave 64 bits are an error. Columns besides the two named are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    each = written(integer_vectors(vectors, id_col, vector_col, scale).dropDuplicates(["id", "v"]), "vectors")
    most, width = each.agg(F.max(F.greatest(F.array_max("v"), F.negate(F.array_min("v")))), F.max(F.size("v"))).first()
    if (most or 0) ** 2 * (width or 0) >= 1 << 63:
        raise ValueError("components too large for scores of 64 bits")
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    objects = each.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    grouped = written(objects, "grouped")
    shards = max(1, min(PIVOTS, grouped.count() // SHARD))
    pivots = [(len(r.v), np.array(r.v, np.float64)) for r in grouped.orderBy(F.xxhash64("v"), "v").limit(shards).collect()]
    shared = spark.sparkContext.broadcast(pivots)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array([len(v) for v in b.column(0)])
            shard = np.zeros(b.num_rows, np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                own = [(i, p) for i, (m, p) in enumerate(shared.value) if m == d]
                if own:
                    x = _matrix(b.column(0).take(pa.array(at))).astype(np.float64)
                    c = np.array([p for _, p in own])
                    shard[at] = np.array([i for i, _ in own])[((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard * 65536 + dims)], names=[*b.schema.names, "shard"])

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = b.column(1).to_numpy()
            for s in np.unique(shard):
                x = _matrix(b.column(0).take(pa.array(np.flatnonzero(shard == s)))).astype(np.float64)
                radius = float(np.sqrt(((x - _centre(shared.value, s)) ** 2).sum(axis=1)).max())
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([len(x)]), pa.array([radius])], names=["shard", "n", "radius"])

    homed = written(grouped.select("v", "ids").mapInArrow(home, "v array<long>, ids array<long>, shard long"), "objects")
    sizes = homed.select("v", "shard").mapInArrow(balls, "shard long, n long, radius double").groupBy("shard").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()
    known = spark.sparkContext.broadcast({r.shard: r.radius for r in sizes})
    trees = F.broadcast(spark.createDataFrame([(r.shard, -(-r.n // TREE)) for r in sizes], "shard long, trees long"))
    objects = homed.join(trees, "shard").select("shard", F.pmod(F.xxhash64("v"), "trees").alias("tree"), "v", "ids")
    asked = each.where(is_query)
    classes = asked.select("v").distinct().mapInArrow(home, "v array<long>, shard long")
    classes = written(classes.select("v", "shard", F.monotonically_increasing_id().alias("q")), "queries")

    def searched(asked: DataFrame) -> DataFrame:
        """asked: (shard, q, v, least) to (q, score, ids, same)."""
        right = asked.join(trees, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("tree"), F.lit(1).alias("side"), "q", "v", F.array().cast("array<long>").alias("ids"), "least")
        left = objects.select("shard", "tree", F.lit(0).alias("side"), F.lit(0).cast("long").alias("q"), "v", "ids", F.lit(None).cast("long").alias("least"))
        return left.unionByName(right).repartition("shard", "tree").sortWithinPartitions("shard", "tree", "side").mapInArrow(lambda b: _searching(b, k + 1), "q long, score long, ids array<long>, same boolean")

    first = written(searched(classes.select("shard", "q", "v", F.lit(None).cast("long").alias("least"))), "first")
    kth = _best(first, ["q"], k + 1).groupBy("q").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("low"))
    bound = classes.join(kth, "q", "left").select("q", "v", "shard", F.when(F.col("c") > k, F.col("low")).alias("least"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(known.value)
        for b in batches:
            if not b.num_rows:
                continue
            dims, mine, least = np.array([len(v) for v in b.column(1)]), b.column(2).to_numpy(), b.column(3).to_pylist()
            floor = np.array([-np.inf if x is None else float(x) for x in least])
            for s in names:
                at = np.flatnonzero((dims == s % 65536) & (mine != s))
                if not len(at):
                    continue
                x = _matrix(b.column(1).take(pa.array(at))).astype(np.float64)
                most = x @ _centre(shared.value, s) + np.sqrt((x * x).sum(axis=1)) * known.value[s]
                at = pa.array(at[most * (1 + np.sign(most) * _SLACK) + _SLACK >= floor[at]])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), b.column(0).take(at), b.column(1).take(at), b.column(3).take(at)], names=["shard", "q", "v", "least"])

    second = written(searched(bound.mapInArrow(others, "shard long, q long, v array<long>, least long")), "second")
    best = _best(first.unionByName(second), ["q"], k + 1)
    named = asked.select(F.col("id").alias("query_id"), "v").join(classes.select("v", "q"), "v").select("query_id", "q")
    out = named.join(best, "q").where(~(F.col("same") & (F.col("query_id") == F.col("id"))))
    order = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "id"))
    out = written(out.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score"), "top")
    release(each, grouped, homed, classes, first, second)
    return out


def _centre(pivots: list[tuple[int, np.ndarray]], shard: int) -> np.ndarray:
    dim, at = int(shard) % 65536, int(shard) // 65536
    return pivots[at][1] if at < len(pivots) and pivots[at][0] == dim else np.zeros(dim)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each query: (q, score, id, same)."""
    each = found.select("q", "score", "same", F.explode("ids").alias("id"))
    return each.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "same"))).where(F.col("r") <= k).drop("r")


def _searching(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and tree, objects before queries; queries run in blocks of an Arrow batch."""
    key, held, ids, tree = None, [], [], None
    for b in batches:
        if not b.num_rows:
            continue
        shard, number, side, q = (b.column(i).to_numpy() for i in range(4))
        least = b.column(6).to_numpy(zero_copy_only=False).astype(np.float64)
        least = np.where(np.isnan(least), -np.inf, least)
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(number) != 0) | (np.diff(side) != 0)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if (shard[a], number[a]) != key:
                key, held, ids, tree = (shard[a], number[a]), [], [], None
            x = _matrix(b.column(4).slice(a, z - a))
            if side[a] == 0:
                held.append(x)
                ids += b.column(5).slice(a, z - a).to_pylist()
                continue
            if not held:
                continue
            tree = tree or MTree(np.concatenate(held))
            who, rows, scores = tree.search(x, k, least[a:z])
            if len(who):
                same = (tree.x[rows] == x[who]).all(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(q[a:z][who]), pa.array(scores), pa.array([ids[r] for r in rows.tolist()], pa.list_(pa.int64())), pa.array(same)], names=["q", "score", "ids", "same"])
