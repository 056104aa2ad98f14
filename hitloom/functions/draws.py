"""Counter-based draws without replacement: each draw from its own counters, the same on any layout.

Floyd's method: for j from n - size to n - 1 a number up to j is drawn; it is
taken unless it has been, and j is taken then.  Whether it has been follows
from the drawn numbers alone: it was drawn before, or it is the j of an
earlier step that was itself taken.  So a draw needs no loop over its steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def places(draw: int, n: int, size: int, seed: int) -> np.ndarray:
    """size different numbers from 0 to n - 1, ascending."""
    base = n - size
    step = np.arange(base, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        key = mixed(np.array([(seed << 32) + draw], dtype=np.uint64))
        drawn = mixed(key + step) % (step + np.uint64(1))
    order = np.argsort(drawn, kind="stable")
    again = np.zeros(size, dtype=bool)
    again[order[1:]] = drawn[order[1:]] == drawn[order[:-1]]
    earlier = (drawn >= base) & (drawn < step)
    of = np.where(earlier, drawn - np.uint64(base), np.uint64(0)).astype(np.int64)
    while True:
        more = earlier & ~again & again[of]
        if not more.any():
            return np.sort(np.where(again, step, drawn)).astype(np.int64)
        again |= more


def distinct_draws(spark: SparkSession, n: int, size: int, draws: int, seed: int) -> DataFrame:
    """draw, place (from 0) and k (its rank in the draw, from 1): draws * size rows, whatever n is."""
    if not 0 <= size <= n:
        raise ValueError(f"{size} of {n} rows")

    def run(batches):
        for b in batches:
            for draw in b.column(0).to_pylist():
                own = places(draw, n, size, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, draw, dtype=np.int32)), pa.array(own), pa.array(np.arange(1, size + 1))], names=["draw", "place", "k"])

    tasks = max(1, min(draws, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, draws, 1, tasks).mapInArrow(run, "draw int, place long, k long")
