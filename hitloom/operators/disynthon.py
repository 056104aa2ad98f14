"""Building-block pairs: unpivot, pool, classify, and carry hits back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cleaning import compound_part
from .dedup import COUNTS

PAIRS = (("AB", 2, 3), ("AC", 2, 4), ("BC", 3, 4))


def pair_ids(compound: str = "compound"):
    """Array of the three pair keys TAG:library:bbX:bbY; null entries if the id doesn't parse."""
    c = F.col(compound)
    key = lambda tag, x, y: F.concat(F.lit(f"{tag}:"), compound_part(c, 1), F.lit(":"), compound_part(c, x), F.lit(":"), compound_part(c, y))
    return F.array(*(key(*p) for p in PAIRS))


def melt(rows: DataFrame) -> DataFrame:
    """Three rows for each row, in one pass over the table."""
    return rows.select(F.explode(pair_ids()).alias("disynthon_id"), *COUNTS)


def aggregate(melted: DataFrame) -> DataFrame:
    return melted.where("disynthon_id is not null").groupBy("disynthon_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS))


def classify(pooled: DataFrame, threshold: float) -> DataFrame:
    tenth = F.lit(0.1) * F.col("count_target")
    return pooled.withColumn("hit", F.coalesce((F.col("count_target") >= threshold) & (F.col("count_inhibitor") < tenth) & (F.col("count_ntc") < tenth), F.lit(False)))


def propagate(rows: DataFrame, hits: DataFrame, max_historic: int | None = None) -> DataFrame:
    """rows with positive: whether one of the row's pairs is among hits.

    The pairs of each structure are joined to the hits and the structures
    found are joined back; neither side is assumed to be small.
    """
    found = rows.select("smiles", F.explode(pair_ids()).alias("disynthon_id")).join(hits.select("disynthon_id").distinct(), "disynthon_id", "left_semi").select("smiles").distinct().withColumn("found_", F.lit(True))
    positive = F.coalesce("found_", F.lit(False))
    if max_historic is not None:
        positive = positive & F.coalesce(F.col("historic_hits") < max_historic, F.lit(False))
    return rows.join(found, "smiles", "left").withColumn("positive", positive).drop("found_")
