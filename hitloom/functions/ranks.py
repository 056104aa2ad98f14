"""Ranks over a whole table without a single-task window.

``numbered`` cuts the score axis at approximate quantiles (a bounded number
of cuts held by the driver), numbers the rows of each slice in a window of
its own, and adds the counts of the slices above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import settled


def sliced(df: DataFrame, score: str, slices: int | None = None) -> DataFrame:
    """df with slice_: 0 holds the highest scores; equal scores share a slice."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = df.agg(F.percentile_approx(score, [k / n for k in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    above = sum([F.when(F.col(score) < F.lit(c), 1).otherwise(0) for c in cuts], F.lit(0)) if len(cuts) <= 16 else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col(score)))
    return df.withColumn("slice_", above)


def numbered(df: DataFrame, score: str, tie: str, out: str = "rn", slices: int | None = None) -> DataFrame:
    """Rows with a non-null score, numbered from 1 by score descending, then tie ascending."""
    rows = sliced(df.where(F.col(score).isNotNull()), score, slices)
    counts = rows.groupBy("slice_").agg(F.count("*").alias("n_"))
    before = counts.withColumn("before_", F.sum("n_").over(Window.orderBy("slice_")) - F.col("n_")).drop("n_")  # one row for each slice
    own = Window.partitionBy("slice_").orderBy(F.desc(score), tie)
    return rows.withColumn("own_", F.row_number().over(own)).join(F.broadcast(before), "slice_").withColumn(out, (F.col("own_") + F.col("before_")).cast("long")).drop("slice_", "own_", "before_")


def ordered(df: DataFrame, *columns: str, out: str = "rn", slices: int | None = None) -> DataFrame:
    """Rows numbered from 1 in ascending order of any columns (nulls first; equal rows in any order).

    Rows are dealt by range and written, so that the slices are the same for
    their counts and for their numbers; equal keys share a slice.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = settled(df.repartitionByRange(n, *columns).withColumn("slice_", F.spark_partition_id()), "ordered")
    counts = dealt.groupBy("slice_").agg(F.count("*").alias("n_"))
    before = counts.select("slice_", (F.sum("n_").over(Window.orderBy("slice_")) - F.col("n_")).alias("before_"))  # one row for each slice
    own = F.row_number().over(Window.partitionBy("slice_").orderBy(*columns))
    return dealt.withColumn("own_", own).join(before, "slice_").withColumn(out, F.col("own_") + F.col("before_")).drop("slice_", "own_", "before_")


def seeded(seed: int, key: str | Column) -> Column:
    """A draw for each key: the md5 of seed and key, the same on any partitioning."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")).cast("binary"))
