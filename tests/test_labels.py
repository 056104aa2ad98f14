"""Cleaning, deduplication and recipes: results computed by hand."""

import math

import pytest
from pyspark.sql import functions as F

from hitloom.functions.cleaning import is_valid_id, with_compound_parts
from hitloom.operators import audit, disynthon, recipes
from hitloom.operators.dedup import dedup, dedup_selection, stouffer_by

S = "compound string, smiles string, count_target long, count_inhibitor double, count_ntc long, historic_hits long, zscore double"
C12 = "C" * 12


def rows(spark, *data):
    return spark.createDataFrame([(f"qDOS1-{i}-2-3", s, c, float(a), n, h, z) for i, (s, c, a, n, h, z) in enumerate(data)], S)


def one(df):
    return df.first()


def test_valid_ids(spark):
    df = spark.createDataFrame([("",), ("CC",), ("N" * 12,), (C12,), (None,)], "s string")
    assert [r[0] for r in df.select(is_valid_id(F.col("s"))).collect()] == [False, False, False, True, False]


def test_compound_parts(spark):
    df = with_compound_parts(spark.createDataFrame([("qDOS11-34-486-863",), ("qDOS18_3-1-2-3",), ("bad",), (None,)], "compound string"))
    assert [(r.library, r.bb1, r.bb2, r.bb3) for r in df.collect()] == [("qDOS11", "34", "486", "863"), ("qDOS18_3", "1", "2", "3"), (None,) * 4, (None,) * 4]


def test_empty_ids_vanish(spark):
    df = spark.createDataFrame([("", 2000)] * 3 + [(C12, 8), (C12 + "O", 1)], "smiles string, n long")
    assert sorted(r.n for r in dedup(df, ["n"]).collect()) == [1, 8]


def test_guards(spark):
    df = spark.createDataFrame([(C12, 1, 2.0)], "smiles string, n long, zscore_a double")
    with pytest.raises(ValueError, match="role"):
        dedup(df, ["n"])
    with pytest.raises(ValueError, match="z-score"):
        dedup(df, ["n", "zscore_a"])


def test_first_is_first_non_null(spark):
    df = spark.createDataFrame([(C12, None, 0), (C12, "b", 1), (C12, "a", 2)], "smiles string, compound string, k long")
    assert one(dedup(df, firsts=["compound"], order="k")).compound == "b"
    assert one(dedup(df.drop("k"), firsts=["compound"])).compound == "a"


def test_stouffer(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", float("nan")), ("c", 4.0), (None, 1.0)], "smiles string, zscore double")
    got = {r.smiles: r.zscore for r in stouffer_by(df).collect()}
    assert got == {"a": pytest.approx(4 / math.sqrt(2)), "b": 5.0, "c": pytest.approx(4 / math.sqrt(2))}


@pytest.mark.parametrize(
    ("predicate", "data", "want"),
    [
        (recipes.base, [(3, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 1, 0, 0, 0), (3, 0, 1, 0, 0), (3, 0, 0, 5, 0)], [1, 0, 0, 0, 0]),
        (recipes.strict, [(10, 0.5, 0, 0, 0), (11, 0, 1, 0, 0), (3, 0, 0, 0, 0), (10, 1, 0, 0, 0), (10, 0, 1, 0, 0)], [1, 1, 0, 0, 0]),
        (recipes.count_ge_10, [(10, 0, 0, 0, 0), (9, 0, 0, 0, 0)], [1, 0]),
        (recipes.no_competition, [(3, 99, 0, 0, 0), (3, 0, 1, 0, 0)], [1, 0]),
        (lambda: recipes.zscore(0.3), [(1, 0, 0, 0, 0.3), (9, 0, 0, 0, 0.2), (9, 0, 1, 0, 1), (9, 0, 0, 0, float("nan")), (9, 0, 0, 0, None)], [1, 0, 0, 0, 0]),
        (lambda: recipes.joint_zscore(0.3), [(3, 0, 0, 0, 0.3), (2, 0, 0, 0, 1), (3, 1, 0, 0, 1), (3, 0, 0, 0, 0.2), (3, 0, 7, 0, 1)], [1, 0, 0, 0, 1]),
    ],
)
def test_predicates(spark, predicate, data, want):
    df = rows(spark, *[(C12, c, a, n, h, None if z is None else float(z)) for c, a, n, h, z in data])
    assert [int(r[0]) for r in df.select(predicate()).collect()] == want


def test_per_library(spark):
    df = spark.createDataFrame([("libA1-1-1-1", 3, 0.0, 0, 0), ("libB1-1-1-1", 3, 0.0, 0, 0), ("libC1-1-1-1", 99, 0.0, 0, 0), ("bad", 99, 0.0, 0, 0)], "compound string, count_target long, count_inhibitor double, count_ntc long, historic_hits long")
    assert [r[0] for r in df.select(recipes.per_library({"libA1": 3, "libB1": 10})).collect()] == [True, False, False, False]


def test_dedup_comes_first(spark):
    df = rows(spark, (C12, 2, 0, 0, 0, 1.0), (C12, 2, 0, 0, 0, 1.0), (C12 + "N", 1, 0, 0, 0, 0.0))
    got = recipes.label(df, "l0").rows
    assert got.count() == 2
    assert [r.count_target for r in got.where("positive").collect()] == [4]
    assert recipes.label(df, "l2").rows.where("positive").count() == 0
    assert recipes.label(df, "l3", 1.25).version == "v1_z1.2500"
    assert one(audit.only_from_summing(df)).n_only_from_summing == 1


def test_pairs(spark):
    df = spark.createDataFrame([("libA1-1-2-3", C12, 10, 0, 0, 0), ("libA1-1-2-4", C12 + "N", 10, 0, 0, 9), ("bad", C12 + "O", 99, 0, 0, 0)], "compound string, smiles string, count_target long, count_inhibitor long, count_ntc long, historic_hits long")
    pooled = disynthon.aggregate(disynthon.melt(df))
    assert {r.disynthon_id: r.count_target for r in pooled.collect()}["AB:libA1:1:2"] == 20
    assert pooled.count() == 5
    hits = disynthon.classify(pooled, 15).where("hit")
    assert [r.disynthon_id for r in hits.collect()] == ["AB:libA1:1:2"]
    assert {r.smiles: r.positive for r in disynthon.propagate(df, hits).collect()} == {C12: True, C12 + "N": True, C12 + "O": False}
    assert recipes.disynthon_labels(df, 15).where("positive").count() == 1
    assert disynthon.propagate(df, hits.limit(0)).where("positive").count() == 0


def test_slopes(spark):
    data = [(f"lib{k}-1-1-{i}", 10 + i, float((10 + i) * s)) for k, s in ((1, 1.0), (2, 5.0)) for i in range(1, 16)]
    df = spark.createDataFrame(data, "compound string, count_target long, zscore double")
    got = {r.library: r for r in audit.z_count_slopes(df).collect()}
    assert got["lib1"].slope == pytest.approx(1) and got["lib2"].slope == pytest.approx(5) and got["lib1"].r2 == pytest.approx(1)
    assert one(audit.z_count_summary(df)).slope_ratio == pytest.approx(5)


def test_overlap_and_gap(spark):
    main = spark.createDataFrame([("a", 1), ("b", 0), ("c", 2)], "smiles string, count_ntc long")
    more = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), ("", 5), ("d", 0)], "smiles string, count_ntc long")
    assert tuple(one(audit.supplement_overlap(main, more))) == (1, 1, 2, 1, 1)
    sel = spark.createDataFrame([("x", 1), ("y", 10)], "compound string, count_target long")
    got = one(audit.enumeration_gap(sel, sel.where("compound = 'x'").select("compound")))
    assert (got.rate_all, got.missing_eq_1, got.missing_ge_10) == (0.5, 0, 1)
    g = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), ("c",), ("c",)] + [(f"k{i}",) for i in range(3)], "smiles string")
    assert {r.n_rows: r.n_groups for r in audit.group_size_histogram(g).collect()} == {3: 1, 1: 4, 2: 1}
    assert one(audit.group_size_enrichment(g, g.where("smiles = 'a'"))).enrichment == pytest.approx(3.0)


def test_streamed_counts_match(spark, tmp_path):
    from hitloom.streaming import incremental

    df = rows(spark, (C12, 2, 0, 0, 0, 1.0), (C12, 2, 0, 0, 1, 3.0), (C12 + "N", 1, 0, 0, 0, 0.0)).withColumn("count_inhibitor", F.col("count_inhibitor").cast("long"))
    a, b = df.limit(1), df.subtract(df.limit(1))
    merged = incremental.finished(incremental.merge(incremental.partial(a), incremental.partial(b)))
    want = dedup_selection(df, recipes.raw_evidence(), zscore=True)
    names = sorted(want.columns)
    assert sorted(map(tuple, merged.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    incremental.keep_up(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/v0")).count() == 2
