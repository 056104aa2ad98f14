"""Entry points over a pool: fingerprints, strata, clusters, the baseline model, and structure follow-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import settled
from ..operators import clustering, fusion, models, ranking, sampling, similarity_join, validation
from ..operators.bit_sets import packed
from ..sources import sinks, store

C = F.col


def _against(observed: DataFrame, null: DataFrame, metric: str) -> DataFrame:
    """One row: the observed value, its percentile in the null, and the null's mean and quantiles."""
    q = F.percentile("value", [0.05, 0.5, 0.95, 0.99])
    spread = null.agg(F.avg("value").alias("null_mean"), q.alias("q")).select("null_mean", *(C("q")[k].alias(n) for k, n in enumerate(("p5", "p50", "p95", "p99"))))
    own = observed.select(F.lit(metric).alias("metric"), "observed")
    share = ranking.percentiles(own, null.select(F.lit(metric).alias("metric"), "value"))
    return share.crossJoin(spread)  # one row each


def hit_clustering_report(library: DataFrame, n_draws: int = 1000, seed: int = 42) -> DataFrame:
    """Whether the hits of a library (row_idx, bits, label) are more alike than random subsets of their number."""
    known = library.where("bits is not null").select("row_idx", "bits", "label")
    n_hits, n = library.agg(F.count_if(C("label") == 1), F.count("*")).first()
    hits = known.where("label = 1")
    observed = similarity_join.mean_pairwise(hits).withColumnRenamed("mean_similarity", "observed")
    null = settled(sampling.clustering_null(known.select("row_idx", "bits"), int(n_hits), n_draws, seed), "null")
    return _against(observed, null, "mean_pairwise_similarity").select(F.lit(n_hits).alias("n_hits"), F.lit(n).alias("n_library"), "*")


def anchor_report(library: DataFrame, anchors: DataFrame, n_draws: int = 1000, seed: int = 42) -> DataFrame:
    """Whether the hits of a library are more like the nearest anchor than random subsets of their number."""
    known = library.where("bits is not null")
    n_hits = library.where("label = 1").count()
    near = settled(similarity_join.bit_tanimoto(known, anchors, vector="bits").join(known.select("row_idx", "label"), "row_idx"), "near")
    null = sampling.random_draws(near, n_hits, n_draws, seed).groupBy("draw").agg(F.avg("similarity").alias("value"))
    observed = near.where("label = 1").agg(F.avg("similarity").alias("observed"))
    return _against(observed, settled(null, "null"), "mean_anchor_similarity").select(F.lit(n_hits).alias("n_hits"), "*")


def fingerprint_pool(deduplicated: DataFrame, bits: Column, name: str, path: str, width: int, sample: int | None = None, seed: int = 0) -> dict:
    """Fingerprints of a deduplicated pool (row_idx and what ``bits`` needs) as a store; sample: a dry run on so many rows."""
    rows = deduplicated if sample is None else sampling.subsample(deduplicated, min(sample, deduplicated.count()), seed)
    rows = rows.select("row_idx", bits.alias("bits"))
    invalid = store.save_store(rows, name, path, width)
    return {"n_compounds": rows.sparkSession.table(name).count(), "n_invalid": invalid, "sample": sample, "seed": seed, "width": width}


def similarity_strata(pool: DataFrame, positives: DataFrame, width: int, path: str, ratio: float = 2.0, share: float = 0.8, surplus: float = 5.0, blocks: int = 32) -> tuple[DataFrame, dict]:
    """row_idx, similarity and flag (the stratum most like the positives), and a report.

    Similarities are kept block by block under path: a run that was stopped
    goes on where it was.
    """
    index = positives.select("row_idx", "bits")
    near = store.run_blocks(pool.select("row_idx", "bits"), path, lambda rows: similarity_join.nearest_positive(rows, index, width), blocks)
    n_positives = positives.count()
    flagged = settled(sampling.stratum_flag(near, n_positives, ratio, share, surplus), "strata")
    n, similar, cut, met = flagged.agg(F.count("*"), F.sum("flag"), F.min(F.when(C("flag") == 1, C("similarity"))), F.sum("n_compared")).first()
    report = {"n_pool": n, "n_positives": n_positives, "n_similar_stratum": similar, "threshold": cut, "needed": share * ratio * n_positives, "compared_share": met / (n * n_positives) if n else None}
    return flagged.drop("n_compared"), report


def cluster_pool(pool: DataFrame, width: int, threshold: float, branching: int = 50) -> tuple[DataFrame, dict]:
    """Tree clusters of a whole pool, the largest first, and their sizes."""
    found = settled(clustering.tree_clusters(pool, threshold, width, branching), "clusters")
    return found, clustering.cluster_sizes(found).first().asDict() | {"threshold": threshold, "branching": branching}


def features(bits: Column, width: int) -> Column:
    """On-bits as an array of 0.0 and 1.0; a missing fingerprint has none."""
    words = F.coalesce(packed(bits, width), F.array_repeat(F.lit(0).cast("long"), -(-width // 64)))
    bit = lambda i: F.element_at(words, (F.floor(i / 64) + 1).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (bit(i) != 0).cast("double"))


def train_baseline(pool: DataFrame, width: int, ratio: float = 2.0, share: float = 0.8, seed: int = 0, folds: int | None = 5, **options) -> tuple[object, dict]:
    """A boosted-tree model of positives against negatives drawn mostly from the similar stratum, and a report.

    pool: row_idx, bits, positive, flag and block, the group that a fold never
    splits; folds: None leaves cross-validation out.
    """
    marked = sampling.similar_by_flag(pool)
    negatives = sampling.sample_negatives(marked, ratio, share, seed)
    drawn = sampling.sample_summary(marked, negatives, ratio, share).first().asDict()
    rows = marked.where("positive").unionByName(negatives)
    rows = settled(rows.select("row_idx", features(C("bits"), width).alias("features"), C("positive").cast("int").alias("label"), "block"), "training")
    report = {"n_positives": rows.where("label = 1").count(), "n_train": rows.count(), "negatives": drawn, "seed": seed}
    if folds:
        cv = models.grouped_cv(rows, "block", folds, **options)
        report["cv"] = [r.asDict() for r in cv.orderBy("fold").collect()]
    return models.train(rows, seed=seed, **options), report


def score_splits(model, splits: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]], width: int, folder: str, prefix: str = "baseline", n: int = 50) -> dict:
    """Score each split's template (row_idx, CatalogID, SMILES), pick the best n and write its submission.

    splits: name to template and a function that adds bits.  "validation"
    writes a list of ids, any other name the full table; the report has what
    is wrong with each.
    """
    report = {}
    for name, (template, fingerprint) in splits.items():
        rows = fingerprint(template).select("row_idx", "CatalogID", C("bits").isNull().alias("invalid"), features(C("bits"), width).alias("features"))
        scored = settled(models.score(model, rows).select("row_idx", "CatalogID", "invalid", "score"), "scores")
        picks = fusion.naive_top(scored, n).select("row_idx", "CatalogID", "score").withColumn("pick", F.row_number().over(sampling.Window.orderBy(F.desc("score"), "row_idx")))  # n rows
        if name == "validation":
            out = f"{folder}/{prefix}_validation.txt"
            problems = sinks.write_ids(picks, out, n) + [r[0] for r in validation.id_list_problems(picks.select("CatalogID"), template, n).collect()]
        else:
            out = f"{folder}/{prefix}_{name}"
            table = sinks.submission_rows(template, picks, scored)
            sinks.write_submission(table, out)
            problems = [r[0] for r in validation.scored_list_problems(table, template, n).collect()]
        count, invalid = scored.agg(F.count("*"), F.count_if("invalid")).first()
        report[name] = {"n_compounds": count, "n_invalid": invalid, "output": out, "format_problems": problems}
    return report
