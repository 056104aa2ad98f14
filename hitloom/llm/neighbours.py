"""Approximate nearest neighbours by low-dimensional stable projections (operator 10).

Vectors are projected by a fixed Gaussian matrix to a few dimensions; squared
projected distances divided by squared true ones then follow a chi-square
law.  The projections are indexed by a kd-tree in two levels.  The upper one
is fitted to at most ``sample`` rows (those with the smallest hashes of their
ids); its leaves are boxes that cover all of space, and every row is dealt to
its leaf.  A leaf with more than ``block`` rows (equal vectors, say) is dealt
in parts, and each part has a tree of its own.

Queries go to the leaves whose boxes are nearest to their projections, in
rounds: some leaves, then four times as many, and so on.  A leaf, and a box of
a part's tree, is only looked at while the chi-square test lets it: a vector nearer
than the query's k-th best so far would lie closer in the projection with
probability ``confidence``.  Vectors that are looked at are verified by their
true distances.  A round ends for a query once no leaf is left that the test
lets through, so that candidates travel to no query that has stopped, and are
copied only for each ``query_block`` queries that ask for one leaf.

Defined cases: vectors that are null, zero, hold a null or non-finite
component, or differ in length from the most frequent length take no part;
rows repeating a query's id are one query (with the smaller vector) and no
candidates of it; other rows that repeat an id are candidates each; equal
distances rank by vec_id; a table with fewer than k candidates gives them all;
empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import batch_rows, lean, written

SCHEMA = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, dof: int) -> float:
    """Quantile for an even number of degrees of freedom."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        x = (lo + hi) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))
        lo, hi = (x, hi) if 1 - tail < p else (lo, x)
    return (lo + hi) / 2


class Tree:
    """A kd-tree with leaves of equal size: members, and the box of each leaf."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            at = todo.pop()
            if len(at) <= leaf:
                self.leaves.append(at)
                continue
            own = points[at]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = np.argpartition(own[:, axis], len(at) // 2)
            todo += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
        self.low = np.stack([points[x].min(axis=0) for x in self.leaves])
        self.high = np.stack([points[x].max(axis=0) for x in self.leaves])

    def squared(self, q: np.ndarray) -> np.ndarray:
        """Least squared distance of a point to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(axis=1)


class Space:
    """The upper tree: leaves whose boxes cover all of space, cut at the sample's medians."""

    def __init__(self, points: np.ndarray, leaves: int):
        dims = points.shape[1]
        self.nodes: list[tuple[int, float, int, int]] = []  # axis (-1: a leaf), cut, lower child or leaf, upper child
        low, high = [], []
        todo = [(np.arange(len(points)), np.full(dims, -np.inf), np.full(dims, np.inf), leaves, -1, 0)]
        while todo:
            at, lo, hi, want, parent, side = todo.pop()
            own, me = points[at], len(self.nodes)
            if parent >= 0:
                axis, cut, *children = self.nodes[parent]
                children[side] = me
                self.nodes[parent] = (axis, cut, *children)
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(at) else 0
            cut = float(np.median(own[:, axis])) if len(at) else 0.0
            upper = own[:, axis] >= cut if len(at) else np.zeros(0, dtype=bool)
            if want < 2 or len(at) < 2 or upper.all() or not upper.any():
                self.nodes.append((-1, 0.0, len(low), 0))
                low.append(lo)
                high.append(hi)
                continue
            self.nodes.append((axis, cut, 0, 0))
            mid_hi, mid_lo = hi.copy(), lo.copy()
            mid_hi[axis] = mid_lo[axis] = cut
            todo += [(at[~upper], lo, mid_hi, want // 2, me, 0), (at[upper], mid_lo, hi, want - want // 2, me, 1)]
        self.low, self.high = np.array(low), np.array(high)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out, todo = np.zeros(len(points), dtype=np.int32), [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            axis, cut, lower, upper = self.nodes[node]
            if axis < 0:
                out[at] = lower
                continue
            up = points[at, axis] >= cut
            todo += [(lower, at[~up]), (upper, at[up])]
        return out

    def squared(self, q: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(axis=1)


def search(queries: np.ndarray, query_ids: np.ndarray, far: np.ndarray, vectors: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, stop: float):
    """The k nearest found of each query, none beyond what it has (far): positions of queries, ids, distances."""
    tree = Tree(vectors @ matrix)
    projected = queries @ matrix
    out = []
    for n, q in enumerate(queries):
        bound = tree.squared(projected[n])
        order = np.argsort(bound, kind="stable")
        best_d, best_i = np.zeros(0), np.zeros(0, dtype=np.int64)
        at, step = 0, 4
        while at < len(order):
            reach = min(far[n], best_d[-1] if len(best_d) == k else np.inf)
            take = order[at : at + step]
            take = take[bound[take] <= stop * reach * reach] if np.isfinite(reach) else take
            if not len(take):
                break
            rows = np.concatenate([tree.leaves[x] for x in take])
            rows = rows[ids[rows] != query_ids[n]]
            d = np.sqrt(((vectors[rows] - q) ** 2).sum(axis=1))
            best_d, best_i = np.concatenate([best_d, d]), np.concatenate([best_i, ids[rows]])
            keep = np.lexsort((best_i, best_d))[:k]
            best_d, best_i = best_d[keep], best_i[keep]
            at += step
            step *= 2
        use = best_d <= far[n]
        out.append((np.full(int(use.sum()), query_ids[n]), best_i[use], best_d[use]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _matrix(column, rows: int, width: int = -1) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(rows, width)


def nearest(table: DataFrame, k: int = 10, every: int = 100, dims: int = 8, confidence: float = 0.99, leaf: int = 4096, block: int = 16_384, query_block: int = 512, first: int = 4, sample: int = 65_536, seed: int = 7) -> DataFrame:
    """The k nearest candidates of each query: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    batch_rows(spark, 2500)
    vectors = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    vectors = vectors.where(F.col("vec_id").isNotNull() & sound)
    sizes = vectors.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    length, rows = sizes[0] if sizes else (1, 0)
    vectors = vectors.where(F.size("embedding") == length)
    matrix = np.random.default_rng(seed).normal(size=(length, dims))
    stop = chi_square_quantile(confidence, dims)

    def project(batches):
        for b in batches:
            p = _matrix(b.column(1), b.num_rows, length) @ matrix
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(p), pa.list_(pa.float64()))], names=["vec_id", "p"])

    some = vectors.mapInArrow(lean(project), "vec_id long, p array<double>").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    space = Space(_matrix(some["p"], some.num_rows, dims), max(1, min(rows // leaf, sample // 16)))
    shared = spark.sparkContext.broadcast(space)  # at most sample / 16 leaves
    leaves = len(space.low)

    def deal(batches):
        for b in batches:
            at = shared.value.leaf(_matrix(b.column(1), b.num_rows, length) @ matrix)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at)], names=["vec_id", "embedding", "leaf"])

    dealt = written(vectors.mapInArrow(lean(deal), "vec_id long, embedding array<double>, leaf int"), "leaves")
    parts = written(dealt.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "parts")  # a row for each leaf
    part = F.pmod(F.xxhash64("vec_id", F.hash("embedding")), F.col("parts")).cast("int")
    candidates = dealt.join(F.broadcast(parts), "leaf").select("leaf", part.alias("part"), "vec_id", "embedding")
    queries = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    state = written(queries.withColumn("far", F.lit(float("inf"))), "queries")
    best = spark.createDataFrame([], SCHEMA)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v = _matrix(left["embedding"], left.num_rows), _matrix(right["embedding"], right.num_rows)
        found = search(q, left["vec_id"].to_numpy(), left["far"].to_numpy(), v, right["vec_id"].to_numpy(), matrix, k, stop)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    def router(done: int, upto: int):
        def route(batches):
            for b in batches:
                p, far = _matrix(b.column(1), b.num_rows, length) @ matrix, b.column(2).to_numpy()
                which, at = [], []
                for n in range(b.num_rows):
                    bound = shared.value.squared(p[n])
                    own = np.argsort(bound, kind="stable")[done:upto]
                    own = own[bound[own] <= stop * far[n] * far[n]] if np.isfinite(far[n]) else own
                    which.append(np.full(len(own), n))
                    at.append(own)
                if which:
                    taken = b.take(pa.array(np.concatenate(which)))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(at), pa.int32())], names=["vec_id", "embedding", "far", "leaf"])

        return route

    done, upto = 0, first
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    while done < leaves and not (asked := written(state.mapInArrow(lean(router(done, upto)), "vec_id long, embedding array<double>, far double, leaf int"), "asked")).isEmpty():
        blocks = asked.groupBy("leaf").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))  # a row for each leaf
        of = asked.join(F.broadcast(blocks), "leaf").join(F.broadcast(parts), "leaf")
        of = of.select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("qb"), "vec_id", "embedding", "far")
        to = candidates.join(F.broadcast(blocks), "leaf").select("leaf", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qb"), "vec_id", "embedding")
        found = of.groupBy("leaf", "part", "qb").cogroup(to.groupBy("leaf", "part", "qb")).applyInArrow(run, SCHEMA)
        best = written(best.unionByName(found).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "vec_id", "score"), "best")
        reached = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("far_"))
        done, upto = upto, 5 * upto
        if done < leaves:
            state = written(state.join(reached, state["vec_id"] == reached["query_id"], "left").select("vec_id", "embedding", F.coalesce("far_", "far").alias("far")), "queries")
    return best.withColumn("rank", F.row_number().over(own)).select("query_id", "rank", "vec_id", "score")
