"""Connected components of a link table, by alternating stars.

Each round hangs every node's larger neighbours on its smallest one (large
star), then the smaller ones as well (small star), until nothing changes; the
number of rounds grows with the logarithm of the longest chain.  Minima are
pre-aggregated and brought back by joins, which Spark can split, so that a
hub with very many links needs no task of its own.  A link table of at most
``LOCAL_LINKS`` rows is handled in one task by a union-find instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import erase, written


LOCAL_LINKS = 2_000_000


def _union_find(batches):
    a, b = [], []
    for x in batches:
        a.append(x.column(0).to_numpy())
        b.append(x.column(1).to_numpy())
    if not a:
        return
    names, place = np.unique(np.concatenate(a + b), return_inverse=True)
    left, right = np.split(place, 2)
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["node", "root"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = both.join(least, "u").where(F.col("v") > F.col("u") if large else F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for each node of links (a, b)."""
    if links.limit(LOCAL_LINKS + 1).count() <= LOCAL_LINKS:
        return written(links.select("a", "b").repartition(1).mapInArrow(_union_find, "node long, root long"), "roots")
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    mark = None
    while True:
        new = written(_star(_star(edges, True), False), "edges")
        erase(edges.sparkSession, edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
