"""Parameters of the recipes, derived from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cleaning import compound_part, finite
from ..functions.lineage import settled
from . import disynthon
from .recipes import I, MAX_HISTORIC, N, H, base


def z_cutoff_for_size(scores: DataFrame, n: int, column: str = "zscore") -> DataFrame:
    """One row: the n-th largest value (the least if there are fewer), how many reach it, and the surplus."""
    z = scores.select(finite(F.col(column)).alias("z")).where("z is not null")
    cut = z.orderBy(F.desc("z")).limit(n).agg(F.min("z").alias("z_cutoff"))
    return z.crossJoin(F.broadcast(cut)).groupBy("z_cutoff").agg(F.count_if(F.col("z") >= F.col("z_cutoff")).alias("n_at_cutoff")).withColumn("delta", F.col("n_at_cutoff") - n)


def other_criteria(rows: DataFrame) -> DataFrame:
    """Structures that meet all base criteria but the count floor."""
    tenth = F.lit(0.1) * F.col("count_target")
    return rows.where((F.col(I) < tenth) & (F.col(N) == 0) & (F.col(H) < MAX_HISTORIC))


def joint_criteria(rows: DataFrame) -> DataFrame:
    """Structures that meet the count, inhibitor and history criteria; the joint z cutoff takes the place of the control count."""
    tenth = F.lit(0.1) * F.col("count_target")
    return rows.where((F.col("count_target") >= 3) & (F.col(I) < tenth) & (F.col(H) < MAX_HISTORIC))


def library_floors(rows: DataFrame, largest: int) -> DataFrame:
    """library and floor: the smallest count floor whose yield in the library is nearest to the overall base yield.

    Only the histogram of counts by library is expanded by the floors, not the
    structures, and the overall rate comes from it too: one scan.
    """
    t = rows.select(compound_part(F.col("compound"), 1).alias("library"), F.least("count_target", F.lit(largest)).alias("c"), _others().alias("ok"), base().alias("base"))
    every = settled(t.groupBy("library", "c").agg(F.count("*").alias("n"), F.count_if("ok").alias("k"), F.count_if("base").alias("b")), "histogram")
    overall = every.agg(F.try_divide(F.sum("b").cast("double"), F.sum("n").cast("double")).alias("rate"))
    histogram = every.where("library is not null")
    total = histogram.groupBy("library").agg(F.sum("n").alias("n_library"))
    floors = histogram.select("library", "c", "k", F.explode(F.sequence(F.lit(1), F.lit(largest))).alias("floor"))
    passed = floors.groupBy("library", "floor").agg(F.sum(F.when(F.col("c") >= F.col("floor"), F.col("k")).otherwise(0)).alias("k"))
    error = F.abs(F.col("k") / F.col("n_library") - F.col("rate"))
    scored = passed.join(total, "library").crossJoin(F.broadcast(overall)).withColumn("error", error)  # overall has one row
    return scored.groupBy("library").agg(F.min_by("floor", F.struct("error", "floor")).alias("floor"))


def _others():
    tenth = F.lit(0.1) * F.col("count_target")
    return F.coalesce((F.col(I) < tenth) & (F.col(N) == 0) & (F.col(H) < MAX_HISTORIC), F.lit(False))


def size_sweep(scores: DataFrame, sizes: list[int], column: str = "zscore") -> DataFrame:
    """z_cutoff_for_size for several sizes: the ranks above the largest size aren't kept."""
    out = None
    for n in sorted(sizes):
        one = z_cutoff_for_size(scores, n, column).select(F.lit(n).cast("long").alias("target_size"), "z_cutoff", "n_at_cutoff")
        out = one if out is None else out.unionByName(one)
    return out


def pair_threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Hit pairs and positive structures for each threshold, over one pooled aggregate."""
    pooled = disynthon.aggregate(disynthon.melt(rows))
    grid = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    tenth = F.lit(0.1) * F.col("count_target")
    hits = pooled.where((F.col("count_inhibitor") < tenth) & (F.col("count_ntc") < tenth)).select("disynthon_id", "count_target", grid).where("count_target >= threshold").select("threshold", "disynthon_id")
    n_hits = hits.groupBy("threshold").agg(F.count("*").alias("n_hit_disynthons"))
    members = rows.where(F.col(H) < MAX_HISTORIC).select("smiles", F.explode(disynthon.pair_ids()).alias("disynthon_id"))
    n_rows = hits.join(members, "disynthon_id").select("threshold", "smiles").distinct().groupBy("threshold").agg(F.count("*").alias("n_positives"))
    return n_hits.join(n_rows, "threshold", "left").withColumn("n_positives", F.coalesce("n_positives", F.lit(0)))


def count_percentiles(pooled: DataFrame, at: tuple[float, ...] = (50, 75, 90, 95, 99, 99.9)) -> DataFrame:
    """Exact percentiles of pair counts, one row each."""
    q = pooled.agg(F.percentile("count_target", [p / 100 for p in at]).alias("q"))
    return q.select(F.posexplode("q").alias("k", "value")).select(F.element_at(F.array(*(F.lit(float(p)) for p in at)), F.col("k") + 1).alias("percentile"), "value")


def falls(sweep: DataFrame, order: str, value: str) -> DataFrame:
    """One row: whether value never rises along the sweep (a driver-sized table)."""
    from pyspark.sql import Window

    step = F.col(value) - F.lag(value).over(Window.orderBy(order))
    return sweep.select(step.alias("d")).agg(F.coalesce(F.bool_and(F.col("d") <= 0), F.lit(True)).alias("monotone"))
