"""All pairs of on-bit sets, block by block, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.functions import similarity as kernels
from hitloom.functions.draws import places
from hitloom.operators import bit_sets, sampling, similarity_join

SCHEMA = "row_idx long, bits array<int>"


def alike(a, b):
    a, b = set(a or []), set(b or [])
    return len(a & b) / len(a | b) if a | b else 0.0


def plain(rows):
    s = [alike(p[1], q[1]) for p in rows for q in rows if p[0] < q[0]]
    return sum(s) / len(s)


def sets(seed, n, width=40):
    rng = random.Random(seed)
    rows = [(k, sorted(rng.sample(range(width), rng.randint(1, 12)))) for k in range(n)]
    return [*rows, (n, []), (n + 1, []), (n + 2, None), (3, [1, 2]), (3, [2])]  # empty, missing, and one row_idx three times


def test_mean_of_more_rows_than_are_sent(spark):
    """more than MAX_BROADCAST rows are no error."""
    n = similarity_join.MAX_BROADCAST + 500
    rows = spark.range(n).select(F.col("id").alias("row_idx"), F.array((F.col("id") % 7).cast("int"), (7 + F.col("id") % 5).cast("int")).alias("bits"))
    of = np.arange(n)
    same = lambda m: sum(c * (c - 1) // 2 for c in np.bincount(of % m))
    both, one = same(35), same(7) + same(5) - 2 * same(35)
    assert similarity_join.mean_pairwise(rows).first()[0] == pytest.approx((both + one / 3) / (n * (n - 1) / 2), abs=1e-12)


@pytest.mark.parametrize("most", [3, 10_000])
def test_mean_and_pairs(spark, most):
    rows = sets(1, 40)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((r.a, r.b, round(r.similarity, 9)) for r in similarity_join.pairwise(df, kernels.bit_tanimoto, most=most).collect())
    assert got == sorted((p[0], q[0], round(alike(p[1], q[1]), 9)) for p in rows for q in rows if p[0] < q[0])
    assert similarity_join.mean_pairwise(df).first()[0] == pytest.approx(plain(rows), abs=1e-12)
    assert similarity_join.mean_pairwise(df.limit(1)).first()[0] is None


@pytest.mark.parametrize("block", [7, 4096])
def test_groups_in_blocks(spark, block, monkeypatch):
    """a group is dealt into blocks, positions into slices, rows into chunks; a group of one row has no pairs."""
    monkeypatch.setattr(bit_sets, "CHUNK", 5)
    groups = {1: sets(2, 50), 2: sets(3, 20, 5000), 3: [(9, [1])]}
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], f"draw int, {SCHEMA}").repartition(3)
    got = {r.draw: r.value for r in bit_sets.mean_similarities(df, "draw", 50, block).collect()}
    assert got == pytest.approx({g: plain(groups[g]) for g in (1, 2)}, abs=1e-12)


def test_wide_sets(spark):
    """More positions than are held at once."""
    rng = np.random.default_rng(4)
    rows = [(k, np.unique(rng.integers(0, 20_000, 3000)).tolist()) for k in range(12)]
    assert similarity_join.mean_pairwise(spark.createDataFrame(rows, SCHEMA)).first()[0] == pytest.approx(plain(rows), abs=1e-12)


def test_null_of_large_subsets(spark):
    """subsets of thousands of rows."""
    n, size = 6000, 5000
    rows = spark.range(n).select(F.col("id").alias("row_idx"), F.array((F.col("id") % 7).cast("int"), (7 + F.col("id") % 5).cast("int")).alias("bits"))
    got = {r.draw: r.value for r in sampling.clustering_null(rows, size, 4, 42).collect()}
    for draw, value in got.items():
        of = places(draw, n, size, 42)
        same = lambda m: sum(c * (c - 1) // 2 for c in np.bincount(of % m))  # noqa: E731, B023
        both, one = same(35), same(7) + same(5) - 2 * same(35)
        assert value == pytest.approx((both + one / 3) / (size * (size - 1) / 2), abs=1e-12)
    assert sorted(got) == [0, 1, 2, 3]
