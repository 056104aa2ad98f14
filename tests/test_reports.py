"""Whole reports on small tables."""

import pytest
from pyspark.sql import functions as F

from hitloom.functions import similarity
from hitloom.operators import clustering
from hitloom.plans import fixtures as fx
from hitloom.plans import reports

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def selection(spark):
    return fx.selection(spark, SMALL)


def test_audit_and_yields(spark, selection):
    got = reports.audit_report(selection, fx.supplement(spark, SMALL), fx.enumeration(spark, SMALL), {"t": selection.select("smiles").limit(5)})
    assert got["zero_rows"]["n_rows"] == 6000 and got["overlap_t"] == 5 and got["supplement"]["overlapping"] >= 0
    yields = {r.recipe: r.n_positives for r in reports.recipe_yields(selection, 2.0, {"qDOS0": 4, "qDOS1": 3, "qDOS2": 3, "qDOS3": 3, "qDOS4": 3, "qDOS5": 2}, 2.0, 60.0).collect()}
    assert yields == {"l0": 807, "l1": 711, "l2": 684, "l3": 743, "l4": 347, "l5": 1235, "l6": 741, "l7": 507, "l8": 1757}
    floors = {r.library: r.floor for r in reports.derive_thresholds(selection)["floors"].collect()}
    assert floors == {"qDOS0": 4, "qDOS1": 3, "qDOS2": 3, "qDOS3": 3, "qDOS4": 3, "qDOS5": 2}
    rows, about = reports.labels(selection, "l8", 60.0)
    assert rows.count() == about["n_positives"] == 1757 and about["version"] == "v1_t60.0"


def test_null_of_counts(spark):
    got = {r.metric: r for r in reports.empirical_null(spark, ["a:1500:9"], n_perm=1000).collect()}
    assert got["log_auc"].mean == pytest.approx(0.1358, abs=0.01)  # published
    assert (got["ef_50"].p50, got["ef_50"].p95) == (0.0, pytest.approx(3.3333, abs=1e-3))


def test_fused_submission(spark, tmp_path):
    n = 80
    template = spark.range(n).select(F.col("id").alias("row_idx"), F.concat(F.lit("D"), F.col("id").cast("string")).alias("CatalogID"))
    for name in ("a", "b"):
        spark.range(n).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id", F.lit(name)), F.lit(1000)).cast("double")).alias("score")).write.parquet(str(tmp_path / name))
    prints = spark.range(n).select(F.col("id").alias("row_idx"), F.array((F.col("id") % 9).cast("int"), (F.col("id") % 5 + 20).cast("int")).alias("bits"))
    specs = [f"a:{tmp_path}/a", f"b:{tmp_path}/b:2.0"]
    assert reports.fuse_channels(spark, template, specs, prints, str(tmp_path)) == []
    table = spark.read.csv(str(tmp_path / "test"), header=True, inferSchema=True)
    assert table.agg(F.sum("Sel_50")).first()[0] == 50
    assert reports.dry_run(table).first().hits <= 50


def test_training_set(spark):
    pool = spark.range(400).select(F.col("id").alias("row_idx"), F.array((F.col("id") % 16).cast("int"), (F.col("id") % 3 + 16).cast("int")).alias("bits"))
    got = reports.stratified_training_set(pool, pool.where("row_idx < 4"), 32)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {1: 4, 0: 8}
    scores = reports.rank_by_similarity(pool, pool.where("row_idx = 0"), similarity.bit_tanimoto, "bits")
    assert scores.where("row_idx = 0").first().score == 1.0
    clusters = clustering.bisecting_clusters(pool.withColumn("vector", F.col("bits").cast("array<double>")), 4)
    sizes = [r["count"] for r in clusters.groupBy("cluster").count().orderBy("cluster").collect()]
    assert sizes == sorted(sizes, reverse=True) and sum(sizes) == 400
