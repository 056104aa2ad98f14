"""Readers, shortlists and evaluation where order, nulls and counts matter."""

import json

import pytest
from pyspark.sql import functions as F

from hitloom.operators import featurizers, fusion, models, thresholds
from hitloom.plans import fixtures as fx
from hitloom.plans import reports
from hitloom.sources import readers

SMALL = "/root/testdata/sf0.001"


def test_template_keeps_the_order_of_its_file(spark, tmp_path):
    rows = [("D9", "CC"), ("D1", "CCC"), ("D5", "C"), ("D2", "CCCC")]
    (tmp_path / "t.csv").write_text("CatalogID,SMILES\n" + "".join(f"{a},{b}\n" for a, b in rows))
    got = readers.split_template(spark, str(tmp_path / "t.csv")).orderBy("row_idx").collect()
    assert [(r.CatalogID, r.SMILES, r.row_idx) for r in got] == [(*r, i) for i, r in enumerate(rows)]
    (tmp_path / "many").mkdir()
    for k in range(2):
        (tmp_path / "many" / f"{k}.csv").write_text("CatalogID,SMILES\nD1,C\n")
    with pytest.raises(ValueError, match="one file"):
        readers.split_template(spark, str(tmp_path / "many"))


def test_affinities_skip_files_without_the_field(spark, tmp_path):
    field = "affinity_probability_binary"
    files = [("a", "x", {field: 0.25}), ("b", "x", {"other": 1}), ("a", "y", {"other": 1}), ("a", "z", {field: 0.5}), ("b", "z", {field: 0.75}), ("b", "unknown", {field: 0.1})]
    for folder, name, content in files:
        (tmp_path / folder / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "deep" / f"affinity_{name}.json").write_text(json.dumps(content))
    ids = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "id string")
    scores, counts = readers.affinities(spark, [str(tmp_path / "a"), str(tmp_path / "b")], ids, field)
    assert {r.id: r.score for r in scores.collect()} == {"x": 0.25, "y": None, "z": 0.75, "w": None}
    assert tuple(counts.first()) == (3, 2, 1)


def test_shortlist_has_a_number_for_each_channel(spark):
    rows = [(i, c, float(s)) for i in range(10) for c, s in (("a", i), ("b", -i), ("c", i % 3))] + [(11, "a", None)]
    short = fusion.shortlist(spark.createDataFrame(rows, "row_idx long, channel string, score double"), {"a": 3, "b": 1})
    assert {r.row_idx: (r.n_sources, r.sources) for r in short.collect()} == {9: (1, "a"), 8: (1, "a"), 7: (1, "a"), 0: (1, "b")}
    assert {r.channel: r.n for r in fusion.channel_members(short).collect()} == {"a": 3, "b": 1}
    template = spark.range(12).select(F.col("id").alias("row_idx"), F.concat(F.lit("D"), (20 - F.col("id")).cast("string")).alias("CatalogID"))
    assert [r.CatalogID for r in fusion.shortlist_table(short, template).collect()] == ["D11", "D12", "D13", "D20"]


def test_evaluation_modes(spark):
    gold = spark.createDataFrame([(f"m{i}", int(i < 3)) for i in range(10)], "id string, hit int")
    team = spark.createDataFrame([(f"m{i}", float(-i), int(i < 4), int(i % 2)) for i in range(10)], "id string, Score double, Sel_4 int, Sel_odd int")
    one = models.evaluate_modes(gold, team, "id", "hit", ["Sel_4", "Sel_odd"], "hits_only").first()
    assert (one.mode, one.ROCAUC, one.PRAUC, one.Hits_Sel_4, one.Hits_Sel_odd) == ("hits_only", 1.0, 1.0, 3, 1)
    clusters = spark.createDataFrame([("m0", 1), ("m1", 2), ("m2", 1)], "id string, cluster int")
    two = models.evaluate_modes(gold, team, "id", "hit", ["Sel_4"], "proxy", clusters=clusters).first()
    assert (two.Hits_Sel_4, two.PROXY_Clusters_Sel_4) == (3, 2)
    with pytest.raises(ValueError, match="Cluster"):
        models.evaluate_modes(gold.withColumn("Cluster", F.lit(1)), team, "id", "hit", ["Sel_4"], "hits_only")
    models.evaluate_modes(gold.withColumn("Cluster", F.lit(None).cast("int")), team, "id", "hit", ["Sel_4"], "hits_only")
    for mode, own in (("proxy", None), ("hits_only", clusters), ("other", None)):
        with pytest.raises(ValueError):
            models.evaluate_modes(gold, team, "id", "hit", ["Sel_4"], mode, clusters=own)


def test_size_sweep_of_the_report_uses_the_joint_criteria(spark):
    selection = fx.selection(spark, SMALL)
    got = reports.derive_thresholds(selection, sizes=[20, 80])["size_sweep"].collect()
    rows = reports.recipes.deduplicated(selection).where("count_target >= 3 and count_inhibitor < 0.1D * count_target and historic_hits < 5").select("zscore").toPandas()["zscore"].sort_values(ascending=False)
    assert [(r.target_size, r.z_cutoff) for r in got] == [(n, rows.iloc[n - 1]) for n in (20, 80)]
    assert thresholds.falls(spark.createDataFrame([(r.target_size, r.z_cutoff) for r in got], "n long, z double"), "n", "z").first().monotone


def test_featurizers_say_what_is_missing(spark):
    for name, f in featurizers.REGISTRY.items():
        if not f.available():
            with pytest.raises(featurizers.MissingDependency, match="rdkit"):
                featurizers.require(name)
    with pytest.raises(KeyError, match="no featurizer"):
        featurizers.require("unknown")
