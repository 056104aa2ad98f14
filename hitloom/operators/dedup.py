"""One row for each structure: counts summed, histories maximised, z-scores combined.

Always before any threshold.  All aggregates are associative, so that tasks
combine them before the one shuffle on the structure.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cleaning import finite, is_valid_id, require_columns

COUNTS = ("count_target", "count_inhibitor", "count_ntc")


def filter_valid(df: DataFrame, key: str = "smiles") -> DataFrame:
    return df.where(is_valid_id(F.col(key)))


def first_by(column: str, order: str | None) -> Column:
    """The first non-null value in the given order; without one the smallest value, which any layout gives."""
    if order is None:
        return F.min(column)
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def dedup(df: DataFrame, sums: Iterable[str] = (), maxima: Iterable[str] = (), firsts: Iterable[str] = (), key: str = "smiles", order: str | None = None, extra: Iterable[Column] = ()) -> DataFrame:
    """Valid rows grouped by key.

    Each column has to be named in one role, and z-scores can be neither
    summed nor maximised.
    """
    sums, maxima, firsts = list(sums), list(maxima), list(firsts)
    require_columns(df, key, *sums, *maxima, *firsts)
    left = set(df.columns) - {key, order, *sums, *maxima, *firsts}
    if left:
        raise ValueError(f"columns without a role: {sorted(left)}")
    if bad := [c for c in sums + maxima if "zscore" in c.lower()]:
        raise ValueError(f"z-scores don't add up; use stouffer for {bad}")
    types = dict(df.dtypes)
    whole = lambda c: F.coalesce(F.sum(finite(F.col(c)) if types[c] in ("double", "float") else F.col(c)), F.lit(0)).alias(c)
    aggs = [*map(whole, sums), *(F.max(c).alias(c) for c in maxima), *(first_by(c, order).alias(c) for c in firsts), *extra]
    return filter_valid(df, key).groupBy(key).agg(*aggs)


def stouffer(z: str = "zscore") -> Column:
    """Sum of z over the root of the number of rows, rows without z included."""
    return (F.coalesce(F.sum(finite(F.col(z))), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias(z)


def stouffer_by(df: DataFrame, key: str = "smiles", z: str = "zscore") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(stouffer(z))


def dedup_selection(selection: DataFrame, *extra: Column, zscore: bool = False, order: str | None = None) -> DataFrame:
    """The usual roles for a selection table; zscore adds the combined z in the same aggregate.

    extra: further aggregates over the raw rows of a structure.
    """
    require_columns(selection, "smiles", "compound", *COUNTS, "historic_hits", *(["zscore"] if zscore else []))
    aggs = [*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS), F.max("historic_hits").alias("historic_hits"), first_by("compound", order).alias("compound"), *([stouffer()] if zscore else []), *extra]
    return filter_valid(selection).groupBy("smiles").agg(*aggs)
