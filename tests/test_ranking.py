"""Fusion, early recognition, sampling, similarity, clustering and files: small cases with known answers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.functions import similarity as sim
from hitloom.operators import clustering, featurizers, fusion, models, ranking, sampling, similarity_join, spatial, validation
from hitloom.sources import readers, sinks

NAN = float("nan")


def channels(spark, **scores):
    return spark.createDataFrame([(i, c, v) for c, vs in scores.items() for i, v in enumerate(vs)], "row_idx long, channel string, score double")


def test_min_max(spark):
    got = {(r.channel, r.row_idx): r.score for r in fusion.min_max(channels(spark, a=[1.0, NAN, 3.0, 2.0], b=[5.0, 5.0, 5.0, None])).collect()}
    assert [got["a", i] for i in range(4)] == [0.0, None, 1.0, 0.5]
    assert [got["b", i] for i in range(4)] == [0.0, 0.0, 0.0, None]


def test_rrf(spark):
    ch = channels(spark, a=[3.0, 2.0, NAN], b=[NAN, 1.0, 5.0], c=[NAN, NAN, NAN])
    got = {r.row_idx: r.rrf for r in fusion.reciprocal_rank(ch, 10, {"b": 2.0}).collect()}
    assert got == {0: pytest.approx(1 / 61), 1: pytest.approx(1 / 62 + 2 / 62), 2: pytest.approx(2 / 61)}
    assert {r.row_idx for r in fusion.reciprocal_rank(ch, 1).collect()} == {0, 2}


def test_greedy(spark):
    pool = spark.createDataFrame([(10, 5.0, 0), (11, 4.0, 0), (12, 3.0, 1), (13, 2.0, 1), (14, 1.0, 2)], "row_idx long, rrf double, series long")
    assert [r.row_idx for r in fusion.greedy_diverse(pool, 4).orderBy("pick").collect()] == [10, 12, 14, 11]
    with pytest.raises(RuntimeError):
        fusion.need_picks(fusion.greedy_diverse(pool, 6), 6)


def brute_log_auc(scores, labels, least=None):
    order = np.lexsort((np.arange(len(scores)), -np.asarray(scores)))
    y = np.asarray(labels)[order]
    p, n = y.sum(), len(y) - y.sum()
    tpr, fpr = np.append(0, y.cumsum() / p), np.append(0, (1 - y).cumsum() / n)
    least = 1 / n if least is None else least
    ok = fpr >= least
    x, t = np.log10(np.clip(fpr, least, 1))[ok], tpr[ok]
    if x[0] > np.log10(least):
        x, t = np.append(np.log10(least), x), np.append(0, t)
    return np.trapezoid(t, x) / -np.log10(least)


@pytest.mark.parametrize("least", [None, 0.05, 0.013])
def test_log_auc_matches_the_curve(spark, least):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 40, 150).astype(float), (rng.random(150) < 0.1).astype(int)
    df = ranking.scored(spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "row_idx long, score double, label int"))
    assert ranking.log_auc(df, least).first()[0] == pytest.approx(brute_log_auc(s, y, least))


def test_perfect_and_worst(spark):
    good = ranking.scored(spark.range(1000).select(F.col("id").alias("row_idx"), (-F.col("id")).cast("double").alias("score"), (F.col("id") < 10).cast("int").alias("label")))
    assert ranking.enrichment(good, 50).first()[0] == pytest.approx((10 / 50) / (10 / 1000))
    assert ranking.log_auc(good).first()[0] == pytest.approx(1.0)
    assert ranking.roc_auc(good).first()[0] == pytest.approx(1.0)
    assert ranking.average_precision(good).first()[0] == pytest.approx(1.0)
    bad = good.withColumn("score", -F.col("score"))
    assert ranking.log_auc(bad).first()[0] == pytest.approx(0.0, abs=1e-3)
    assert ranking.log_auc(good.where("label = 1")).first()[0] is None
    s = ranking.summarize(good).first()
    assert (s.n_total, s.n_hits) == (1000, 10)


def test_null_is_random(spark):
    null = ranking.permutation_null(ranking.labels_from_counts(spark, 300, 9), 200)
    got = {r.metric: r for r in ranking.summarize_null(null).collect()}
    assert got["ef_50"].mean == pytest.approx(1.0, abs=0.2)
    n_neg = 291
    assert got["log_auc"].mean == pytest.approx(1 / math.log(10) / math.log10(n_neg), abs=0.03)
    obs = spark.createDataFrame([("log_auc", 2.0), ("ef_50", -1.0)], "metric string, observed double")
    assert {r.metric: r.percentile for r in ranking.percentiles(obs, null).collect()} == {"log_auc": 100.0, "ef_50": 0.0}


def test_kernels(spark):
    df = spark.createDataFrame([([1.0, 1.0], [1.0, 1.0], [0, 1], [1, 2]), ([0.0, 0.0], [0.0, 0.0], [], [])], "a array<double>, b array<double>, x array<int>, y array<int>")
    assert [r[0] for r in df.select(sim.generalized_tanimoto(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
    assert [round(r[0], 6) for r in df.select(sim.bit_tanimoto(F.col("x"), F.col("y"))).collect()] == [0.333333, 0.0]
    usr = spark.createDataFrame([([0.0, 0.0], [1.0, 3.0])], "a array<double>, b array<double>")
    assert usr.select(sim.shape_similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 / 3)
    words = spark.createDataFrame([([3, 1], [1, 1])], "a array<long>, b array<long>")
    assert words.select(sim.word_tanimoto(F.col("a"), F.col("b"))).first()[0] == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="anchors"):
        similarity_join.bit_tanimoto(df, df.limit(0), vector="x", row="a")


def test_samples(spark):
    pool = spark.createDataFrame([(i, i == 0, 0 if i < 4 else 1) for i in range(8)], "row_idx long, positive boolean, cluster long")
    near = sampling.similar_by_cluster(pool)
    got = sampling.sample_negatives(near, 2.0, share=1.0)
    assert got.count() == 2 and got.where("cluster != 0 or positive").count() == 0
    short = sampling.sample_negatives(near, 12.0, share=1.0)
    assert sampling.sample_summary(near, short, 12.0, share=1.0).first().shortfall == 9
    assert sampling.sample_random(pool, 4.0).count() == 4
    with pytest.raises(Exception, match="isn't 0 or 1"):
        sampling.similar_by_flag(pool.withColumn("flag", F.lit(2))).collect()


def test_clusters(spark):
    rng = np.random.default_rng(0)
    d = rng.random((12, 12))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    groups = [{i} for i in range(12)]
    while len(groups) > 1:
        best = min(((np.mean([d[i, j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y))
        if best[0] > 0.45:
            break
        groups[best[1]] |= groups.pop(best[2])
    labels = clustering.linkage_labels(d, 0.45)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)}
    pool = spark.createDataFrame([(0, 5.0, [1, 2], "s"), (1, 4.0, [1, 2], "s"), (2, 3.0, [7], "t"), (3, 2.0, [7, 8], None)], "row_idx long, score double, bits array<int>, scaffold string")
    assert [r.row_idx for r in clustering.butina_select(pool, 4, 3).orderBy("pick").collect()] == [0, 2, 3]
    assert [r.row_idx for r in clustering.maxmin_select(pool, 4, 2).orderBy("pick").collect()] == [0, 2]
    bad = spark.createDataFrame([(0, [1]), (1, None), (2, None)], "row_idx long, bits array<int>")
    assert {r.row_idx: r.cluster for r in clustering.average_linkage(bad).collect()} == {0: 0, 1: 1, 2: 2}


def pdb(record, name, res, chain, x, y, z, element, alt=" ", number=1):
    return f"{record:<6}{1:>5} {name:<4}{alt}{res:>3} {chain}{number:>4}    {x:>8.3f}{y:>8.3f}{z:>8.3f}{'':>22}{element:>2}"


def test_waters(spark):
    lines = [pdb("HETATM", "O1", "LIG", "A", 0, 0, 0, "O"), pdb("ATOM", "N", "ALA", "A", 6, 0, 0, "N"), pdb("HETATM", "O", "HOH", "W", 3, 0, 0, "O"), pdb("HETATM", "O", "HOH", "W", -3, 0, 0, "O"), pdb("HETATM", "C1", "LIG", "A", 9, 9, 9, "C", "B")]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = spatial.bridging_waters(spatial.parse_atoms(df), "LIG").collect()
    assert [(r.x, r.y, r.z) for r in got] == [(3.0, 0.0, 0.0)]
    assert spatial.ligand_lines(df, "LIG", "A").count() == 1
    with pytest.raises(ValueError):
        spatial.ligand_lines(df, "LIG", "Z")


def test_flat_centre(spark):
    flat = [[1.0, 0.0, 0.0], [-0.5, 0.866, 0.0], [-0.5, -0.866, 0.0]]
    tetra = [[1.0, 1.0, 1.0], [-1.0, -1.0, 1.0], [-1.0, 1.0, -1.0]]
    df = spark.createDataFrame([(c, i, v) for c, vs in ((1, flat), (2, tetra)) for i, v in enumerate(vs)], "centre long, neighbour long, v array<double>")
    assert [r.centre for r in spatial.flat_centres(df).collect()] == [1]


def test_submission_rules(spark):
    template = spark.createDataFrame([(f"D{i}",) for i in range(60)], "CatalogID string")
    good = template.select("CatalogID", (F.substring("CatalogID", 2, 9).cast("int") < 50).cast("int").alias("Sel_50"), F.lit(1.0).alias("Score"))
    assert validation.scored_list_problems(good, template).count() == 0
    bad = good.where("CatalogID != 'D0'").unionByName(good.where("CatalogID = 'D1'").withColumn("Score", F.lit(None).cast("double")))
    assert validation.scored_list_problems(bad, template).count() >= 3
    assert validation.scored_list_problems(good.select("Score", "CatalogID", "Sel_50"), template).count() == 1
    assert validation.id_list_problems(template.limit(50), template).count() == 0
    assert validation.id_list_problems(template.limit(49).unionByName(template.limit(2)), template).count() == 2


def test_affinities(spark, tmp_path):
    for d, i, v in (("one", "a", 0.1), ("two", "a", 0.3), ("one", "b", None), ("two", "x", 0.5)):
        p = tmp_path / d / "deep"
        p.mkdir(parents=True, exist_ok=True)
        (p / f"affinity_{i}.json").write_text(json.dumps({} if v is None else {"affinity_probability_binary": v}))
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    rows, counts = readers.affinities(spark, [str(tmp_path / "one"), str(tmp_path / "two")], ids)
    assert {r.id: r.score for r in rows.collect()} == {"a": 0.3, "b": None, "c": None}
    assert tuple(counts.first()) == (2, 1, 1)  # of files: a was found twice


def test_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"a\x00b\x00\x00")
    assert readers.nul_bytes(spark, str(tmp_path / "x.bin")).first().n_nul == 3
    with pytest.raises(readers.NulBytes):
        readers.check_alignment(spark, str(tmp_path / "x.bin"))
    names = spark.createDataFrame([(f"f{i}",) for i in range(10)], "name string")
    chunks = [r.chunk for r in sinks.in_chunks(names, 3).orderBy("name").collect()]
    assert chunks == [0] * 4 + [1] * 4 + [2] * 2
    (tmp_path / "a.csv").write_text("smiles,source,detail\nC,x,p\nN,y,q\n")
    assert readers.anchors(spark, str(tmp_path / "a.csv"), ["x"], ["p"]).count() == 1
    with pytest.raises(ValueError, match="detail"):
        readers.anchors(spark, str(tmp_path / "a.csv"), ["x"], ["q"])
    with pytest.raises(ValueError, match="missing"):
        readers.query_table(spark, str(tmp_path / "a.csv"), "nope")
    (tmp_path / "p.json").write_text(json.dumps([{"name": "r", "type": "odd", "xyz": [0.0, 0.0, 0.0], "cutoff": 1.0}]))
    with pytest.raises(ValueError, match="odd"):
        readers.reference_points(spark, str(tmp_path / "p.json"))
    assert readers.channel_spec("a:b:2") == ("a", "b", 2.0)
    out = sinks.write_report(str(tmp_path), "t", {"k": 1})
    assert json.loads((out / "report.json").read_text())["k"] == 1
    sinks.write_files(spark.createDataFrame([("i", "text")], "id string, content string"), str(tmp_path / "y"))
    assert (tmp_path / "y" / "i.yaml").read_text() == "text"


def test_paged_source(spark):
    from hitloom.sources.paged import PagedSource, _Reader

    r = _Reader(lambda o, n: [(f"s{k}" if k != 3 else "", float(k)) for k in range(o, min(o + n, 7))], 7, 3)
    assert len([x for p in r.partitions() for x in r.read(p)]) == 6
    assert PagedSource.name() == "hitloom_paged"


def test_featurizers(spark):
    df = spark.createDataFrame([("CC",), (None,)], "smiles string")
    with pytest.raises(featurizers.MissingDependency):
        featurizers.featurize(df, "ecfp4")
    featurizers.register(featurizers.Featurizer("length", "math", lambda: lambda t: [float(len(t))], 1))
    got = featurizers.featurize(df, "length")
    assert [r.vector for r in got.collect()] == [[2.0], None]
    assert featurizers.invalid_count(got).first().n_invalid == 1


def test_model(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(v) for v in rng.normal(size=4) + (4 if i % 2 else 0)], i % 2) for i in range(120)]
    df = spark.createDataFrame(data, "row_idx long, features array<double>, label int")
    held = models.score(models.train(df.where("row_idx < 80"), rounds=5), df.where("row_idx >= 80"))
    assert ranking.roc_auc(ranking.scored(held)).first()[0] > 0.95
    folds = sampling.grouped_folds(df.withColumn("g", F.col("row_idx") % 10), "g", 3)
    assert folds.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_draws(spark):
    """Draws are sets of the right size, the same on any layout, and follow the hypergeometric law."""
    from hitloom.functions import draws

    for n, m in ((1, 0), (1, 1), (10, 10), (50, 7), (1000, 999)):
        for k in range(30):
            own = draws.places(k, n, m, 5)
            assert len(set(own.tolist())) == m and (m == 0 or (own[0] >= 0 and own[-1] < n))
    plain = []
    for j in range(40, 60):  # Floyd's method step by step
        with np.errstate(over="ignore"):
            t = int(draws.mixed(draws.mixed(np.array([(3 << 32) + 9], dtype=np.uint64)) + np.uint64(j))[0] % np.uint64(j + 1))
        plain.append(j if t in plain else t)
    assert sorted(plain) == draws.places(9, 60, 20, 3).tolist()
    n, m, k = 400, 60, 50
    rows = draws.distinct_draws(spark, n, m, 4000, 1)
    top = rows.groupBy("draw").agg(F.count_if(F.col("place") < k).alias("h")).agg(F.avg("h"), F.var_samp("h")).first()
    mean, var = k * m / n, k * (m / n) * (1 - m / n) * (n - k) / (n - 1)
    assert abs(top[0] - mean) < 4 * (var / 4000) ** 0.5 and abs(top[1] - var) < 0.1 * var
    null = ranking.null_from_counts(spark, n, m, 200)
    assert "Window" not in null._jdf.queryExecution().executedPlan().toString()


def test_folds(spark):
    from hitloom.operators.sampling import deal_sizes

    import random

    rng = random.Random(1)
    for _ in range(300):
        folds = rng.randint(1, 6)
        sizes = [(s, rng.randint(1, 40)) for s in rng.sample(range(1, 30), rng.randint(1, 6))]
        load, want = [0] * folds, {}
        for s, k in sorted(sizes, reverse=True):
            want[s] = [0] * folds
            for _ in range(k):
                f = load.index(min(load))
                load[f] += s
                want[s][f] += 1
        assert deal_sizes(sizes, folds) == want
    rows = spark.range(3000).select((F.col("id") % 137 % (F.col("id") % 11 + 1)).alias("g"), F.lit(1).alias("n_"), F.lit(2).alias("fold_x"))
    dealt = sampling.grouped_folds(rows, "g", 4)
    assert dealt.count() == 3000
    assert dealt.groupBy("g").agg(F.countDistinct("fold").alias("k")).where("k > 1").count() == 0
