"""The entry points: whole reports composed of the operators, as small DataFrames or dicts for a report file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.lineage import settled
from ..operators import audit, fusion, models, ranking, recipes, sampling, similarity_join, thresholds, validation
from ..sources import readers, sinks

C = F.col


def _row(df: DataFrame) -> dict:
    return df.first().asDict(recursive=True)


def audit_report(selection: DataFrame, supplement: DataFrame | None = None, enumeration: DataFrame | None = None, templates: dict[str, DataFrame] | None = None) -> dict:
    """All measurements of a selection table; every value is a count, a ratio or a row for each library."""
    out = {
        "columns": [r.asDict() for r in readers.describe(selection).collect()],
        "zero_rows": _row(audit.zero_target_rows(selection)),
        "singletons": _row(audit.singleton_fraction(selection)),
        "totals": _row(audit.read_totals(selection, supplement)),
        "libraries": [r.asDict() for r in audit.library_row_counts(selection).collect()],
        "invalid_share": _row(audit.invalid_share(selection)),
        "group_sizes": [r.asDict() for r in audit.group_size_histogram(selection).orderBy("n_rows").collect()],
        "only_from_summing": _row(audit.only_from_summing(selection)),
    }
    if "zscore" in selection.columns:
        out["z_slopes"] = [r.asDict() for r in audit.z_count_slopes(selection).collect()]
        out["z_summary"] = _row(audit.z_count_summary(selection))
    if supplement is not None:
        out["supplement"] = _row(audit.supplement_overlap(selection, supplement))
    if enumeration is not None:
        out["enumeration"] = _row(audit.enumeration_gap(selection, enumeration))
    for name, t in (templates or {}).items():
        out[f"overlap_{name}"] = template_overlap(t, selection).first()["n"]
    return out


def template_overlap(template: DataFrame, selection: DataFrame) -> DataFrame:
    """One row: how many rows of a template are structures of the selection."""
    return template.join(selection.select("smiles").distinct(), "smiles", "left_semi").agg(F.count("*").alias("n"))


def recipe_yields(selection: DataFrame, z: float | None = None, floors: dict[str, int] | None = None, joint_z: float | None = None, pair_threshold: float | None = None) -> DataFrame:
    """recipe, n_unique, n_positives, rate; recipes whose parameter isn't given are left out."""
    chosen: dict = {"l0": None, "l1": None, "l2": None, "l4": None, "l5": None}
    chosen |= {k: v for k, v in (("l3", z), ("l6", floors), ("l7", joint_z)) if v is not None}
    rows = recipes.label_many(selection, **chosen)
    if pair_threshold is not None:
        found = recipes.disynthon_labels(rows, pair_threshold).select("smiles", C("positive").alias("is_l8"))
        rows, chosen = rows.join(found, "smiles"), chosen | {"l8": None}
    one = rows.agg(F.count("*").alias("n_unique"), *(F.count_if(f"is_{k}").alias(k) for k in sorted(chosen)))
    return one.unpivot("n_unique", sorted(chosen), "recipe", "n_positives").withColumn("rate", F.try_divide(C("n_positives").cast("double"), C("n_unique").cast("double")))


def derive_thresholds(selection: DataFrame, largest_floor: int = 50, sizes: list[int] | None = None, pair_thresholds: list[float] | None = None) -> dict[str, DataFrame]:
    """Matched z cutoff and library floors; and sweeps over sizes and pair thresholds where asked for."""
    rows = settled(recipes.deduplicated(selection), "deduplicated")
    out = {
        "z_cutoff": thresholds.z_cutoff_for_size(thresholds.other_criteria(rows), rows.where(recipes.base()).count()),
        "floors": thresholds.library_floors(rows, largest_floor),
    }
    if sizes:
        out["size_sweep"] = thresholds.size_sweep(thresholds.joint_criteria(rows), sizes)
    if pair_thresholds:
        out["pair_sweep"] = thresholds.pair_threshold_sweep(rows, pair_thresholds)
    return out


def empirical_null(spark: SparkSession, specs: list[str], observed: DataFrame | None = None, n_perm: int = 1000, seed: int = 42) -> DataFrame:
    """Null summaries for NAME:N_TOTAL:N_HITS, with percentiles of observed values (name, metric, observed) if given."""
    out = None
    for spec in specs:
        name, n, hits = spec.rsplit(":", 2)
        null = ranking.null_from_counts(spark, int(n), int(hits), n_perm, seed)
        one = ranking.summarize_null(null)
        if observed is not None:
            own = observed.where(C("name") == name).select("metric", "observed")
            one = one.join(ranking.percentiles(own, null), "metric", "left")
        one = one.withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def rank_by_similarity(query: DataFrame, anchors: DataFrame, kernel: Callable, vector: str = "vector") -> DataFrame:
    """Scores of a query table against anchors by any kernel: row_idx and score."""
    return similarity_join.max_similarity(query, anchors, kernel, vector).withColumnRenamed("similarity", "score")


def fuse_channels(spark: SparkSession, template: DataFrame, specs: list[str], fingerprints: DataFrame, folder: str, n: int = 50, per_channel: int = 500) -> list[str]:
    """Read channels (name:file[:weight]), fuse, pick, write both submission files; returns what is wrong with them."""
    rows = template.count()
    parsed = [readers.channel_spec(s) for s in specs]
    channels = None
    for name, path, _ in parsed:
        one = readers.channel(spark, path, name, rows)
        channels = one if channels is None else channels.unionByName(one)
    picks, scores = fusion.fuse_and_select(channels, fingerprints, rows, n, per_channel, {name: w for name, _, w in parsed})
    table = sinks.submission_rows(template, picks, scores)
    sinks.write_submission(table, f"{folder}/test")
    named = picks.join(template.select("row_idx", "CatalogID"), "row_idx")
    problems = sinks.write_ids(named, f"{folder}/validation.txt", n)
    return problems + [r[0] for r in validation.scored_list_problems(table, template, n).collect()]


def dry_run(table: DataFrame, key: str = "CatalogID") -> DataFrame:
    """A submission against a made-up gold table in which its first 50 ids are hits: shows that the columns fit."""
    gold = table.select(key).withColumn("LABEL", C(key).isin([r[0] for r in table.select(key).orderBy(key).limit(50).collect()]).cast("int"))
    return models.evaluate_team(gold, table, key, "LABEL", "Sel_50")


def stratified_training_set(pool: DataFrame, positives: DataFrame, width: int, ratio: float = 2.0, seed: int = 0) -> DataFrame:
    """Positives (label 1) and negatives drawn mostly from what is most like them (label 0); pool: row_idx, bits."""
    near = similarity_join.nearest_positive(pool, positives, width)
    flagged = sampling.stratum_flag(near, positives.count(), ratio)
    known = positives.select("row_idx").distinct().withColumn("p_", F.lit(True))
    marked = sampling.similar_by_flag(flagged).join(known, "row_idx", "left").withColumn("positive", F.coalesce("p_", F.lit(False))).drop("p_")
    negatives = sampling.sample_negatives(marked, ratio, seed=seed).select("row_idx", F.lit(0).alias("label"))
    return marked.where("positive").select("row_idx", F.lit(1).alias("label")).unionByName(negatives)


def labels(selection: DataFrame, key: str, *args) -> tuple[DataFrame, dict]:
    """Positives of a recipe and its name, version and yield."""
    found = recipes.label(selection, key, *args)
    n, k = found.rows.agg(F.count("*"), F.count_if("positive")).first()
    return found.rows.where("positive"), {"name": found.name, "version": found.version, "n_unique": n, "n_positives": k}


__all__ = ["audit_report", "derive_thresholds", "dry_run", "empirical_null", "fuse_channels", "labels", "rank_by_similarity", "recipe_yields", "template_overlap", "stratified_training_set"]
