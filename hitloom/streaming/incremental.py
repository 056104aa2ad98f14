"""An extra: the shared aggregate of the recipes kept up to date over a stream of raw rows.

Counts, maxima, least names and (sum of z, number of rows) are associative,
so that each micro-batch is deduplicated by itself and merged into the table
so far; labels are then any recipe over the merged table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.cleaning import finite
from ..operators.dedup import COUNTS, filter_valid
from ..operators.recipes import base

C = F.col


def partial(rows: DataFrame) -> DataFrame:
    """Sufficient statistics of a batch."""
    z = finite(C("zscore"))
    own = F.max(F.coalesce(base(), F.lit(False)).cast("int"))
    return filter_valid(rows).groupBy("smiles").agg(*(F.sum(c).alias(c) for c in COUNTS), F.max("historic_hits").alias("historic_hits"), F.min("compound").alias("compound"), F.coalesce(F.sum(z), F.lit(0.0)).alias("z_sum"), F.count("*").alias("n_rows"), own.alias("own_evidence"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    sums = [*COUNTS, "z_sum", "n_rows"]
    return a.unionByName(b).groupBy("smiles").agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in ("historic_hits", "own_evidence")), F.min("compound").alias("compound"))


def finished(merged: DataFrame) -> DataFrame:
    """The table that the recipes read."""
    return merged.withColumn("zscore", C("z_sum") / F.sqrt(C("n_rows"))).drop("z_sum", "n_rows")


def keep_up(stream: DataFrame, folder: str, checkpoint: str):
    """Start a query that merges each micro-batch into folder/v<batch>; the last version is complete.

    A batch that is run again rewrites its own version from the one before.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        new = partial(batch)
        if number:
            new = merge(spark.read.parquet(f"{folder}/v{number - 1}"), new)
        new.write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
