"""Measurements of a selection table and of the labels made from it.

Each function returns a small DataFrame made by one or two aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.cleaning import compound_part, finite, is_blank, is_valid_id, ratio
from . import recipes

C = F.col


def zero_target_rows(selection: DataFrame) -> DataFrame:
    return selection.agg(F.count_if(C("count_target") == 0).alias("n_zero"), F.count("*").alias("n_rows"))


def singleton_fraction(selection: DataFrame) -> DataFrame:
    return selection.agg(ratio(F.count_if(C("count_target") == 1), F.count("*")).alias("singleton_fraction"))


def read_totals(selection: DataFrame, supplement: DataFrame | None = None) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c.removeprefix('count_')}")
    out = selection.agg(total("count_target"), total("count_inhibitor"), total("count_ntc"))
    if supplement is None:
        return out
    more = supplement.agg(F.coalesce(F.sum("count_ntc"), F.lit(0)).alias("more_"))
    return out.crossJoin(F.broadcast(more)).withColumn("total_ntc_combined", C("total_ntc") + C("more_")).drop("more_")  # one row each


def library_row_counts(selection: DataFrame) -> DataFrame:
    """Rows by library; library null counts the ids that don't parse."""
    return selection.groupBy(compound_part(C("compound"), 1).alias("library")).agg(F.count("*").alias("n_rows"))


def supplement_overlap(selection: DataFrame, supplement: DataFrame) -> DataFrame:
    """Blank ids, repeated ids, ids shared with the main table, and whether their counts agree."""
    blank = is_blank(C("smiles"))
    sizes = supplement.where(~blank).groupBy("smiles").agg(F.count("*").alias("n"), F.sum("count_ntc").alias("supp"))
    main = selection.where("smiles is not null").groupBy("smiles").agg(F.sum("count_ntc").alias("main"))
    both = main.join(sizes, "smiles").agg(F.count("*").alias("overlapping"), F.count_if(C("main") == C("supp")).alias("agreements"))
    empty = supplement.agg(F.count_if(blank).alias("blank_rows"))
    repeated = sizes.agg(F.count_if(C("n") > 1).alias("repeated_groups"))
    return empty.crossJoin(repeated).crossJoin(both).withColumn("disagreements", C("overlapping") - C("agreements"))  # one row each


def z_count_slopes(selection: DataFrame, min_count: int = 10, min_rows: int = 10) -> DataFrame:
    """For each library: slope and R2 of z on count through the origin, over rows above min_count."""
    x, y = C("count_target").cast("double"), finite(C("zscore"))
    rows = selection.where(C("count_target") > min_count).select(compound_part(C("compound"), 1).alias("library"), x.alias("x"), y.alias("y")).where("library is not null")
    sums = rows.groupBy("library").agg(F.count("*").alias("n"), F.sum(C("x") * C("y")).alias("xy"), F.sum(C("x") * C("x")).alias("xx"), F.sum(C("y") * C("y")).alias("yy")).where(C("n") >= min_rows)
    slope = ratio(C("xy"), C("xx"))
    left = C("yy") - 2 * C("slope") * C("xy") + C("slope") * C("slope") * C("xx")
    return sums.withColumn("slope", slope).withColumn("r2", 1 - ratio(left, C("yy"))).select("library", "n", "slope", "r2")


def z_count_summary(selection: DataFrame, min_count: int = 10) -> DataFrame:
    """One row: non-positive z-scores, their range, the ratio of the extreme positive slopes, the least R2."""
    z = finite(C("zscore"))
    overall = selection.agg(F.count_if(z <= 0).alias("n_nonpositive"), F.min(z).alias("z_min"), F.max(z).alias("z_max"))
    up = F.when(C("slope") > 0, C("slope"))
    slopes = z_count_slopes(selection, min_count).agg(ratio(F.max(up), F.min(up)).alias("slope_ratio"), F.min("r2").alias("min_r2"))
    return overall.crossJoin(slopes)  # one row each


def invalid_share(selection: DataFrame) -> DataFrame:
    """Raw rows that pass the base recipe, and how many of them have no valid id."""
    passing = selection.where(recipes.base())
    out = passing.agg(F.count("*").alias("n_passing"), F.count_if(~is_valid_id(C("smiles"))).alias("n_invalid"))
    return out.withColumn("n_valid", C("n_passing") - C("n_invalid")).withColumn("fraction_invalid", ratio(C("n_invalid"), C("n_passing")))


def missing_from(compounds: DataFrame, enumeration: DataFrame, column: str = "compound") -> DataFrame:
    """compounds with a column missing: not in the enumeration; both sides may be large."""
    known = enumeration.select(column).distinct().withColumn("known_", F.lit(True))
    return compounds.join(known, column, "left").withColumn("missing", C("known_").isNull()).drop("known_")


def enumeration_gap(selection: DataFrame, enumeration: DataFrame, order: str | None = None) -> DataFrame:
    """Distinct compounds absent from an enumeration, over all and by bands of their count."""
    if order is None:
        unique = selection.groupBy("compound").agg(F.max("count_target").alias("count_target"))
    else:
        first = Window.partitionBy("compound").orderBy(order)
        unique = selection.withColumn("k_", F.row_number().over(first)).where("k_ = 1").select("compound", "count_target")
    marked = missing_from(unique.where("compound is not null"), enumeration)
    bands = {"all": F.lit(True), "eq_1": C("count_target") == 1, "ge_3": C("count_target") >= 3, "ge_10": C("count_target") >= 10}
    counts = [x for k, b in bands.items() for x in (F.count_if(b).alias(f"n_{k}"), F.count_if(b & C("missing")).alias(f"missing_{k}"))]
    out = marked.agg(*counts)
    return out.withColumns({f"rate_{k}": ratio(C(f"missing_{k}"), C(f"n_{k}")) for k in bands})


def group_sizes(rows: DataFrame, key: str = "smiles") -> DataFrame:
    return rows.where(C(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"))


def group_size_histogram(rows: DataFrame, key: str = "smiles") -> DataFrame:
    return group_sizes(rows, key).groupBy("n_rows").agg(F.count("*").alias("n_groups"))


def group_size_enrichment(rows: DataFrame, positives: DataFrame, key: str = "smiles") -> DataFrame:
    """Share of structures made of several rows, among all and among positives, and the ratio."""
    sizes = group_sizes(rows, key)
    marked = sizes.join(positives.select(key).distinct().withColumn("p_", F.lit(True)), key, "left")
    several, hit = C("n_rows") > 1, C("p_").isNotNull()
    out = marked.agg(ratio(F.count_if(several), F.count("*")).alias("fraction_all"), ratio(F.count_if(several & hit), F.count_if(hit)).alias("fraction_positives"))
    return out.withColumn("enrichment", ratio(C("fraction_positives"), C("fraction_all")))


def only_from_summing(selection: DataFrame, threshold: Callable[[], Column] = recipes.base) -> DataFrame:
    """Positives of which no raw row passes by itself; any threshold over the raw columns."""
    own = F.max(F.coalesce(threshold(), F.lit(False)).cast("int")).alias("own_")
    from .dedup import dedup_selection

    rows = dedup_selection(selection, own, zscore="zscore" in selection.columns)
    out = rows.where(threshold()).agg(F.count("*").alias("n_positives"), F.count_if(C("own_") == 0).alias("n_only_from_summing"))
    return out.withColumn("fraction", ratio(C("n_only_from_summing"), C("n_positives")))


def dedup_order(selection: DataFrame) -> DataFrame:
    """What thresholding before deduplication would lose."""
    from .dedup import dedup_selection

    raw = selection.agg(F.count_if(recipes.base() & is_valid_id(C("smiles"))).alias("n_raw_passing"))
    rows = dedup_selection(selection, recipes.raw_evidence())
    first = rows.agg(F.count_if(recipes.base()).alias("n_dedup_first"), F.count_if(C("own_evidence") == 1).alias("n_threshold_first"))
    return raw.crossJoin(first)  # one row each
