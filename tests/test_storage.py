"""Stores, results block by block, paged sources, footers."""

import pytest
from pyspark.sql import functions as F

from hitloom.sources import paged, readers, store


def bits(spark, n=200):
    return spark.range(n).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 50 != 7, F.array((F.col("id") % 64).cast("int"), (64 + F.col("id") % 60).cast("int"))).alias("bits"))


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.save_store(bits(spark), "prints_a", path, 130, 4) == 4
    spark.sql("DROP TABLE prints_a")
    table = store.open_store(spark, "prints_b", path, 4)
    assert table.count() == 200 and len(table.first().words) == 3
    keys = spark.range(0, 400, 3).select(F.col("id").alias("row_idx"), F.lit(1).alias("k"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.gather(table, keys)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the keys' side alone
        rows = {r.row_idx: r.words for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(rows) == set(range(0, 200, 3))
    assert rows[57] == [0, 0, 0] and rows[63] == [-(1 << 63), 1 << 3, 0] and rows[3] == [1 << 3, 1 << 3, 0]
    with pytest.raises(Exception, match="beyond the width"):
        store.save_store(bits(spark), "prints_c", str(tmp_path / "c"), 100, 4)


def test_blocks_survive_a_stop(spark, tmp_path):
    path, ran = str(tmp_path / "blocks"), []

    def run(rows):
        if len(ran) == 3 and "stopped" not in ran:
            ran.append("stopped")
            raise KeyboardInterrupt
        ran.append(len(ran))
        return rows.select("row_idx", (F.col("row_idx") * 2).alias("twice"))

    rows = spark.range(100).withColumnRenamed("id", "row_idx")
    with pytest.raises(KeyboardInterrupt):
        store.run_blocks(rows, path, run, 6)
    assert store.finished(spark, f"{path}/done") == {0, 1, 2}
    out = store.run_blocks(rows, path, run, 6)
    assert len(ran) == 3 + 1 + 3
    assert sorted(map(tuple, out.collect())) == [(k, 2 * k) for k in range(100)]
    again = store.run_blocks(rows, path, run, 6)
    assert len(ran) == 7 and again.count() == 100


def pages(n, fail=()):
    """A service of n rows that fails once at some offsets."""
    left = set(fail)

    def fetch(offset, limit):
        if offset in left:
            left.discard(offset)
            raise OSError("busy")
        return [(f"s{k}" if k % 5 else "", float(k)) for k in range(offset, min(offset + limit, n))]

    return fetch


@pytest.mark.parametrize("n", [0, 1, 3, 9, 10, 11, 64, 100])
def test_paged_end(n):
    calls = []

    def fetch(offset, limit):
        calls.append(offset)
        return pages(n)(offset, limit)

    r = paged._Reader(fetch, None, 3)
    assert sorted(x[0] for p in r.partitions() for x in r.read(p)) == sorted(f"s{k}" for k in range(n) if k % 5)
    assert len(calls) <= -(-n // 3) + 16


def test_paged_tries():
    r = paged._Reader(pages(20, fail=(0, 6)), 20, 3, tries=2)
    assert len([x for p in r.partitions() for x in r.read(p)]) == 16
    r = paged._Reader(pages(20, fail=(6,)), 20, 3, tries=1)
    with pytest.raises(OSError):
        [x for p in r.partitions() for x in r.read(p)]


def test_pages_go_on(spark, tmp_path):
    path = str(tmp_path / "pages")

    def broken(offset, limit):
        if offset >= 12:
            raise OSError("gone")
        return [(f"s{k}", float(k)) for k in range(offset, offset + limit)]

    paged.register_fetcher("t", broken)
    with pytest.raises(Exception, match="gone"):
        paged.load_pages(spark, path, "t", pages=2, limit=3, tries=1)
    assert store.finished(spark, path) == {0, 1}
    asked = []

    def whole(offset, limit):
        asked.append(offset)
        return [(f"s{k}", float(k)) for k in range(offset, min(offset + limit, 25))]

    paged.register_fetcher("t", whole)
    got = paged.load_pages(spark, path, "t", pages=2, limit=3)
    assert min(asked) == 12
    assert sorted(r.value for r in got.collect()) == [float(k) for k in range(25)]


def test_describe_files(spark, tmp_path):
    rows = spark.range(50).select("id", F.when(F.col("id") > 3, F.col("id").cast("int")).alias("i"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), (F.col("id") / 4).alias("x"), F.lit("2024-01-02").cast("date").alias("day"))
    path = str(tmp_path / "t.parquet")
    rows.write.parquet(path)
    got = readers.describe_files(spark, path)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, readers.describe(spark.read.parquet(path)).collect()))


def test_order_and_inputs(spark, tmp_path):
    from hitloom.functions.ranks import ordered
    from hitloom.sources import sinks

    rows = spark.range(500).select(F.md5((F.col("id") % 400).cast("string").cast("binary")).alias("name"), "id")
    got = ordered(rows, "name", slices=7).collect()
    assert sorted(r.rn for r in got) == list(range(1, 501))
    by = sorted(got, key=lambda r: r.rn)
    assert [r.name for r in by] == sorted(r.name for r in got)
    (tmp_path / "good.a3m").write_text(">q\nAA\n")
    (tmp_path / "bad.a3m").write_bytes(b">q\nA\x00A\n")
    table = spark.createDataFrame([("a", "CC", True, 3), ("b", "C(", False, None), ("c", "CCC", True, 99), ("d", "C", True, None)], "id string, smiles string, ok boolean, n_atoms int")
    made, skipped = sinks.cofold_inputs(table, "smiles: %s", "smiles", readable="ok", max_size=50, alignment=str(tmp_path / "good.a3m"))
    assert [(r.id, r.content) for r in made.collect()] == [("a", "smiles: CC")]
    assert sorted(map(tuple, skipped.collect())) == [("b", "unparseable"), ("c", "99 heavy atoms > 50"), ("d", "no size")]
    with pytest.raises(readers.NulBytes):
        sinks.cofold_inputs(table, "smiles: %s", "smiles", readable="ok", max_size=50, alignment=str(tmp_path / "bad.a3m"))
    one = sinks.coverage(spark.createDataFrame([(0.5,), (None,), (float("nan"),)], "score double")).first()
    assert tuple(one) == (3, 1, 0.5, 0.5, True)
