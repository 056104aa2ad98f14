"""Largest similarity of each query to a set of anchors, and related joins.

A join with an anchor set is all queries against a stated set: anchors are
broadcast when there are at most ``MAX_BROADCAST`` of them (checked), and
otherwise dealt into blocks that meet the queries block by block, the maxima
being combined afterwards.  Nothing but one maximum for each query and block
is kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import similarity as kernels
from ..functions.lineage import settled
from .bit_sets import mean_similarities

C = F.col
MAX_BROADCAST = 10_000


def _anchors(anchors: DataFrame) -> int:
    n = anchors.count()
    if not n:
        raise ValueError("no anchors")
    return n


def max_similarity(queries: DataFrame, anchors: DataFrame, kernel: Callable[[Column, Column], Column], vector: str = "vector", row: str = "row_idx") -> DataFrame:
    """row and similarity: the largest over all anchors; 0 where the query has no vector."""
    n = _anchors(anchors)
    a = anchors.select(C(vector).alias("anchor_"))
    if n <= MAX_BROADCAST:
        pairs = queries.select(row, vector).crossJoin(F.broadcast(a))  # at most MAX_BROADCAST anchors
    else:
        blocks = -(-n // MAX_BROADCAST)
        dealt = a.withColumn("block_", F.pmod(F.xxhash64("anchor_"), F.lit(blocks)))
        pairs = queries.select(row, vector, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).cast("long").alias("block_")).join(dealt, "block_")
    return pairs.groupBy(row).agg(F.coalesce(F.max(kernel(C(vector), C("anchor_"))), F.lit(0.0)).alias("similarity"))


def generalized_tanimoto(queries: DataFrame, anchors: DataFrame, **names) -> DataFrame:
    return max_similarity(queries, anchors, kernels.generalized_tanimoto, **names)


def bit_tanimoto(queries: DataFrame, anchors: DataFrame, **names) -> DataFrame:
    return max_similarity(queries, anchors, kernels.bit_tanimoto, **names)


def shape(queries: DataFrame, anchors: DataFrame, **names) -> DataFrame:
    return max_similarity(queries, anchors, kernels.shape_similarity, **names)


def bit_words(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of on-bits (null: none) as 64-bit words."""
    lists = lists.fill_null([]) if lists.null_count else lists
    size = np.diff(lists.offsets.to_numpy())
    x = np.zeros((len(lists), -(-width // 64) * 64), dtype=np.uint8)
    flat = lists.flatten().to_numpy()
    if len(flat) and (flat.min() < 0 or flat.max() >= width):
        raise ValueError(f"a bit beyond the width of {width}")
    x[np.repeat(np.arange(len(lists)), size), flat] = 1
    return np.packbits(x, axis=1, bitorder="little").view(np.uint64)


class BitIndex:
    """Bitsets by their number of set bits, in blocks, for the largest Tanimoto similarity.

    Sets of p and q bits are at most min(p, q) / max(p, q) alike, so blocks are
    met in the order of this bound, and a query is done when no bound is above
    what it has found.
    """

    def __init__(self, words: np.ndarray, block: int = 512):
        count = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        order = np.argsort(count, kind="stable")
        self.words, self.count = words[order], count[order]
        self.cut = np.append(np.arange(0, len(words), block), len(words))
        self.low, self.high = self.count[self.cut[:-1]], self.count[self.cut[1:] - 1]

    def nearest(self, queries: np.ndarray, best: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The largest similarity of each query (``best``: known beforehand), and with how many sets it was compared."""
        count = np.bitwise_count(queries).sum(axis=1, dtype=np.int64)
        best = np.zeros(len(queries)) if best is None else best.copy()
        met = np.zeros(len(queries), dtype=np.int64)
        order = np.argsort(count, kind="stable")
        for at in range(0, len(order), 64):
            group = order[at : at + 64]
            q = count[group][:, None]
            bound = np.minimum(1.0, np.minimum(self.high / np.maximum(q, 1), q / np.maximum(self.low, 1)))
            for k in np.argsort(-bound.max(axis=0), kind="stable").tolist():
                live = group[bound[:, k] > best[group]]
                if not len(live):
                    if bound[:, k].max() <= best[group].min():
                        break
                    continue
                a, b = self.cut[k], self.cut[k + 1]
                both = np.bitwise_count(queries[live][:, None, :] & self.words[None, a:b, :]).sum(axis=2, dtype=np.int64)
                union = count[live][:, None] + self.count[None, a:b] - both
                best[live] = np.maximum(best[live], (both / np.maximum(union, 1)).max(axis=1))
                met[live] += b - a
        return best, met


#: bytes of an index that is sent whole
MAX_INDEX = 64 << 20
#: sets in a block that travels
BLOCK = 4096
_NEAREST = "row_idx long, similarity double, n_compared long"


def _with_index(pool: DataFrame, words: np.ndarray, width: int) -> DataFrame:
    shared = pool.sparkSession.sparkContext.broadcast(BitIndex(words))

    def run(batches):
        for b in batches:
            best, met = shared.value.nearest(bit_words(b.column(1), width))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best), pa.array(met)], names=["row_idx", "similarity", "n_compared"])

    return pool.select("row_idx", C("bits").cast("array<int>").alias("bits")).mapInArrow(run, _NEAREST)


def _by_blocks(pool: DataFrame, positives: DataFrame, width: int, block: int, spread: int = 8) -> DataFrame:
    """The same for an index of any size: rows go to the blocks of their own number of bits first, then only to those that may hold more.

    A block travels ``spread`` times, so that rows of one number of bits are
    several tasks' work; a task holds one block.
    """
    n_bits = F.size("bits").cast("long").alias("n")
    sets = positives.where("bits is not null").select(C("bits").cast("array<int>").alias("bits"), n_bits)
    held = {r["n"]: r["k"] for r in sets.groupBy("n").agg(F.count("*").alias("k")).collect()}  # at most width + 1 rows
    parts = {n: -(-k // block) for n, k in held.items()}
    numbers = sorted(parts)
    spark = pool.sparkSession
    known = spark.createDataFrame([(n, p) for n, p in parts.items()], "n long, parts long")
    dealt = sets.join(F.broadcast(known), "n").withColumn("part", F.pmod(F.xxhash64("bits", F.monotonically_increasing_id()), C("parts")))
    stored = settled(dealt.select("n", "part", "bits"), "index")

    def meet(rows: DataFrame) -> DataFrame:
        """rows: row_idx, bits, best, n, part."""
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("row_idx"), F.lit(spread)))
        copies = stored.select(F.lit(None).cast("long").alias("row_idx"), "bits", F.lit(None).cast("double").alias("best"), "n", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("salt"))

        def run(batches):
            key, pieces, index = None, [], None
            for b in batches:
                keys = list(zip(*(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True))
                words = bit_words(b.column(1), width)
                stored_row = b.column(0).is_null().to_numpy(zero_copy_only=False)
                edge = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or stored_row[i] != stored_row[i - 1]), len(keys)]
                for lo, hi in zip(edge, edge[1:], strict=False):
                    if keys[lo] != key:
                        key, pieces, index = keys[lo], [], None
                    if stored_row[lo]:
                        pieces.append(words[lo:hi])
                        continue
                    if index is None:
                        index = BitIndex(np.concatenate(pieces)) if pieces else None
                    if index is not None:
                        best, met = index.nearest(words[lo:hi], b.column(2).slice(lo, hi - lo).to_numpy())
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(best), pa.array(met)], names=["row_idx", "similarity", "n_compared"])

        both = copies.unionByName(salted.select(*copies.columns))
        order = both.repartition("n", "part", "salt").sortWithinPartitions("n", "part", "salt", C("row_idx").asc_nulls_first())
        return order.mapInArrow(run, _NEAREST)

    all_numbers = F.array(*(F.lit(n).cast("long") for n in numbers))
    rows = pool.select("row_idx", C("bits").cast("array<int>").alias("bits"), F.coalesce(n_bits, F.lit(0)).alias("q"))
    own = F.array_min(F.transform(all_numbers, lambda n: F.struct(F.abs(n - C("q")).alias("far"), n.alias("n"))))["n"].alias("n")
    near = rows.select("*", own).join(F.broadcast(known), "n").select("row_idx", "bits", F.lit(0.0).alias("best"), "n", F.explode(F.sequence(F.lit(0).cast("long"), C("parts") - 1)).alias("part"))
    first = settled(meet(near).groupBy("row_idx").agg(F.max("similarity").alias("similarity"), F.sum("n_compared").alias("n_compared")), "nearest")
    again = rows.join(first, "row_idx").select("row_idx", "bits", C("similarity").alias("best"), "q", own.alias("own"))
    bound = F.least(C("q"), C("n")) / F.greatest(C("q"), C("n"), F.lit(1))
    more = again.join(F.broadcast(known), (C("n") != C("own")) & (bound > C("best"))).select("row_idx", "bits", "best", "n", F.explode(F.sequence(F.lit(0).cast("long"), C("parts") - 1)).alias("part"))  # width + 1 rows are sent
    return first.unionByName(meet(more)).groupBy("row_idx").agg(F.max("similarity").alias("similarity"), F.sum("n_compared").alias("n_compared"))


def nearest_positive(pool: DataFrame, positives: DataFrame, width: int, max_index: int = MAX_INDEX, block: int = BLOCK) -> DataFrame:
    """row_idx, similarity of on-bit sets to the nearest positive, and n_compared, the positives that it was compared with; positives are 1.

    positives are rows of pool (row_idx, bits); a row without bits is at 0.
    The pool is scanned once, against an index of packed words by number of
    bits: sent whole while it is at most max_index bytes, otherwise block by
    block.
    """
    n = _anchors(positives)
    if n * (-(-width // 64)) * 8 <= max_index:
        best = _with_index(pool, bit_words(positives.select(C("bits").cast("array<int>").alias("bits")).toArrow()["bits"].combine_chunks(), width), width)
    else:
        best = _by_blocks(pool, positives, width, block)
    mark = positives.select("row_idx").distinct().withColumn("p_", F.lit(True))
    return best.join(mark, "row_idx", "left").select("row_idx", F.when(C("p_"), F.lit(1.0)).otherwise(C("similarity")).alias("similarity"), "n_compared")


def pairwise(rows: DataFrame, kernel: Callable[[Column, Column], Column], vector: str = "bits", most: int = MAX_BROADCAST) -> DataFrame:
    """a, b and similarity for all pairs a < b: one side is sent while it is at most ``most`` rows, otherwise blocks of so many meet one another."""
    n = rows.count()
    a, b = (rows.select(C("row_idx").alias(n), C(vector).alias(f"v{n}")) for n in "ab")
    if n <= most:
        met = a.join(F.broadcast(b), C("a") < C("b"))
    else:
        k = -(-n // most)
        own = lambda s: F.pmod(F.xxhash64(s), F.lit(k)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        met = a.select("*", own("a").alias("i"), every.alias("j")).join(b.select("*", every.alias("i"), own("b").alias("j")), ["i", "j"]).where("a < b")
    return met.select("a", "b", kernel(C("va"), C("vb")).alias("similarity"))


def mean_pairwise(rows: DataFrame, kernel=kernels.bit_tanimoto, vector: str = "bits") -> DataFrame:
    """The mean over all pairs; null for fewer than two rows.  On-bits are compared block by block, other vectors pair by pair."""
    if kernel is not kernels.bit_tanimoto:
        return pairwise(rows, kernel, vector).agg(F.avg("similarity").alias("mean_similarity"))
    one = rows.select(F.lit(0).alias("all_"), "row_idx", C(vector).alias("bits"))
    return mean_similarities(one, "all_", rows.count()).agg(F.max("value").alias("mean_similarity"))
