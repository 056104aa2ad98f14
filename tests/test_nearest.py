"""Nearest positive by a bit index, sent whole or block by block."""

import random

import numpy as np
import pyarrow as pa
import pytest

from hitloom.operators import similarity_join as sj


def rows_of(n=260, width=130):
    rng = random.Random(2)
    return [(i, None if i % 50 == 49 else sorted(rng.sample(range(width), rng.choice([0, 1, 5, 9, 10, 11, 30, 31, 60, 120])))) for i in range(n)]


@pytest.mark.parametrize("max_index,block", [(1 << 20, 512), (0, 4096), (0, 3)])
def test_nearest_positive(spark, max_index, block):
    rows = rows_of()
    df = spark.createDataFrame(rows, "row_idx long, bits array<int>").repartition(3)
    positives = [(i, b) for i, b in rows if i % 5 == 0]

    def best(i, b):
        if i % 5 == 0:
            return 1.0
        a = set(b or [])
        return max(len(a & set(p)) / max(1, len(a | set(p))) for _, p in positives if p is not None)

    got = sj.nearest_positive(df, df.where("row_idx % 5 = 0"), 130, max_index, block).collect()
    assert len(got) == len(rows)
    assert {r.row_idx: r.similarity for r in got} == pytest.approx({i: best(i, b) for i, b in rows})
    assert max_index or sum(r.n_compared for r in got) < 0.8 * len(rows) * len(positives)  # the bound on sizes leaves blocks out


def test_one_scan(spark, tmp_path):
    spark.createDataFrame(rows_of(), "row_idx long, bits array<int>").write.parquet(str(tmp_path / "pool"))
    pool = spark.read.parquet(str(tmp_path / "pool"))
    plan = sj.nearest_positive(pool, pool.where("row_idx < 9"), 130)._jdf.queryExecution().executedPlan().toString()
    # one scan of the pool with its bits, and one of the positives' ids
    assert sum("bits" in line for line in plan.splitlines() if "Scan parquet" in line) == 1


def test_index():
    rng = np.random.default_rng(0)
    bits = [sorted(rng.choice(256, rng.integers(0, 200), replace=False).tolist()) for _ in range(500)]
    words = sj.bit_words(pa.array(bits, pa.list_(pa.int32())), 256)
    best, met = sj.BitIndex(words[:300], 16).nearest(words[300:])
    for k, b in enumerate(bits[300:]):
        assert best[k] == pytest.approx(max(len(set(b) & set(p)) / max(1, len(set(b) | set(p))) for p in bits[:300]))
    assert met.mean() < 250
    with pytest.raises(ValueError):
        sj.bit_words(pa.array([[256]], pa.list_(pa.int32())), 256)
