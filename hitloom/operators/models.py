"""A boosted-tree classifier over fingerprints, its scores, grouped cross-validation and evaluation."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from . import ranking
from .sampling import grouped_folds

C = F.col


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features_", array_to_vector(C("features").cast("array<double>")))


def train(rows: DataFrame, rounds: int = 40, depth: int = 4, rate: float = 0.1, seed: int = 0, validation: str | None = None) -> GBTClassificationModel:
    """Fit to rows (features array, label 0/1); a validation flag column turns early stopping on."""
    gbt = GBTClassifier(featuresCol="features_", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=1.0)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(_vectors(rows))


def score(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """rows with score: the probability of label 1."""
    out = model.transform(_vectors(rows)).withColumn("score", vector_to_array("probability")[1])
    return out.drop("features_", "rawPrediction", "probability", "prediction")


def save(model: GBTClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(path)


def grouped_cv(rows: DataFrame, group: str, folds: int = 5, **options) -> DataFrame:
    """fold, roc_auc and average_precision, groups never being split; the test fold also stops the training early."""
    dealt = grouped_folds(rows, group, folds).withColumn("row_idx", F.coalesce(C("row_idx"), F.lit(0)))
    out = None
    for k in range(folds):
        model = train(dealt.withColumn("test_", C("fold") == k), validation="test_", **options)
        held = ranking.scored(score(model, dealt.where(C("fold") == k)))
        one = ranking.roc_auc(held).crossJoin(ranking.average_precision(held)).select(F.lit(k).alias("fold"), "roc_auc", "average_precision")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def evaluate_modes(gold: DataFrame, team: DataFrame, key: str, label: str, selections: list[str], mode: str, score_column: str = "Score", clusters: DataFrame | None = None) -> DataFrame:
    """One row: mode, ROCAUC, PRAUC and Hits_<selection> for each selection column.

    Both modes are for a gold table without clusters of its own; one with a
    real Cluster column is an error.  hits_only gives the above; proxy adds
    PROXY_Clusters_<selection>, the different clusters (key and cluster, of hits)
    among the selected hits.
    """
    if mode not in ("hits_only", "proxy"):
        raise ValueError(f"unknown mode {mode}: hits_only or proxy")
    if (mode == "proxy") != (clusters is not None):
        raise ValueError("clusters of the hits are needed in proxy mode, and in no other")
    if "Cluster" in gold.columns and not gold.where("Cluster is not null").isEmpty():
        raise ValueError("the gold table has a Cluster column; its own clusters are to be used")
    both = gold.select(key, C(label).cast("int").alias("label_")).join(team.select(key, C(score_column).alias("score_"), *selections), key)
    rows = ranking.scored(both.withColumn("row_idx", F.xxhash64(key)), "score_", "label_")
    picked = lambda c: (C(c) == 1) & (C("label_") == 1)
    if clusters is not None:
        both = both.join(clusters.select(key, C("cluster").alias("cluster_")), key, "left")
    found = [F.count_if(picked(c)).alias(f"Hits_{c}") for c in selections]
    found += [F.countDistinct(F.when(picked(c), C("cluster_"))).alias(f"PROXY_Clusters_{c}") for c in selections if clusters is not None]
    out = ranking.roc_auc(rows).crossJoin(ranking.average_precision(rows)).crossJoin(both.agg(*found))  # one row each
    return out.withColumnsRenamed({"roc_auc": "ROCAUC", "average_precision": "PRAUC"}).withColumn("mode", F.lit(mode))


def evaluate_team(gold: DataFrame, team: DataFrame, key: str, label: str, selection: str, score_column: str = "Score") -> DataFrame:
    """One row: ROC-AUC, average precision and hits among the selected rows, gold and team joined on key.

    Measures whose formulas aren't public (a P-value, a cluster PR-AUC) are
    left out; join further columns to the result to add them.
    """
    both = gold.select(key, C(label).alias("label")).join(team.select(key, C(score_column).alias("score"), C(selection).alias("picked")), key)
    rows = ranking.scored(both.withColumn("row_idx", F.xxhash64(key)))
    hits = both.agg(F.count_if((C("picked") == 1) & (C("label") == 1)).alias("hits"))
    return ranking.roc_auc(rows).crossJoin(ranking.average_precision(rows)).crossJoin(hits)  # one row each
