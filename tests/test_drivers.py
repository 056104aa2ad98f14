"""Entry points over a pool, end to end on small tables."""

import pytest
from pyspark.sql import functions as F

from hitloom.plans import drivers


@pytest.fixture(scope="module")
def pool(spark):
    rows = spark.range(300).select(F.col("id").alias("row_idx"), F.array(*((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(9 if k < 2 else 30)) + (0 if k < 2 else 9)).cast("int") for k in range(5))).alias("bits"))
    rows = rows.withColumn("bits", F.when(F.col("row_idx") % 97 == 96, None).otherwise(F.array_distinct(F.when(F.col("row_idx") < 20, F.concat(F.array(F.lit(40), F.lit(41), F.lit(42)), "bits")).otherwise(F.col("bits")))))
    path = rows.sparkSession  # the rows are the same whenever they are read
    assert path is spark
    return rows.withColumn("label", (F.col("row_idx") < 20).cast("int"))


def test_follow_ups(pool):
    one = drivers.hit_clustering_report(pool, 100).first()
    assert one.n_hits == 20 and one.n_library == 300 and one.percentile == 100.0 and one.observed > one.p99 >= one.p50 >= one.p5
    near = drivers.anchor_report(pool, pool.where("row_idx = 3").select("row_idx", "bits"), 100).first()
    assert near.n_hits == 20 and near.percentile == 100.0 and near.p5 <= near.null_mean <= near.p99


def test_pool_to_submission(spark, pool, tmp_path):
    made = drivers.fingerprint_pool(pool.select("row_idx", F.col("bits").alias("b")), F.col("b"), "prints_d", str(tmp_path / "prints"), 64)
    assert made["n_compounds"] == 300 and made["n_invalid"] == 3
    positives = pool.where("label = 1 and row_idx < 10")
    strata, report = drivers.similarity_strata(pool, positives, 64, str(tmp_path / "strata"), ratio=1.0, blocks=4)
    assert report["n_pool"] == 300 and report["n_positives"] == 10 and report["needed"] == 8 and 0 < report["compared_share"] <= 1
    assert strata.where("flag = 1").count() == report["n_similar_stratum"] >= 40
    clusters, sizes = drivers.cluster_pool(pool, 64, 0.3)
    assert clusters.count() == 300 and sizes["n_clusters"] == clusters.select("cluster").distinct().count()
    rows = pool.join(strata.select("row_idx", "flag"), "row_idx").select("row_idx", "bits", (F.col("row_idx") < 10).alias("positive"), "flag", (F.col("row_idx") % 12).alias("block"))
    model, trained = drivers.train_baseline(rows, 64, ratio=2.0, folds=2, rounds=2, depth=2)
    assert trained["n_positives"] == 10 and trained["n_train"] == 30 and len(trained["cv"]) == 2
    template = pool.select("row_idx", F.concat(F.lit("C"), F.col("row_idx").cast("string")).alias("CatalogID"), F.lit("CC").alias("SMILES"))
    add = lambda t: t.join(pool.select("row_idx", "bits"), "row_idx")
    report = drivers.score_splits(model, {"validation": (template, add), "test": (template, add)}, 64, str(tmp_path))
    assert all(r["n_compounds"] == 300 and r["n_invalid"] == 3 and not r["format_problems"] for r in report.values())
    assert len((tmp_path / "baseline_validation.txt").read_text().splitlines()) == 50
