"""A store of fingerprints gathered by key, and results kept block by block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.lineage import filesystem
from ..operators.bit_sets import packed

C = F.col
BUCKETS = 64


def save_store(rows: DataFrame, name: str, path: str, width: int, buckets: int = BUCKETS) -> int:
    """Write rows (row_idx, bits) as packed 64-bit words, bucketed and sorted by row_idx, and register the table; how many had no bits.

    Those are stored with no bit set.  Rows are dealt by bucket once, so each
    bucket is one file.
    """
    seen = Observation()
    zeros = F.array_repeat(F.lit(0).cast("long"), -(-width // 64))
    words = rows.select(C("row_idx").cast("long").alias("row_idx"), F.coalesce(packed(C("bits"), width), zeros).alias("words"), C("bits").isNull().alias("none_"))
    words = words.observe(seen, F.count_if("none_").alias("n_invalid")).drop("none_")
    words.repartition(buckets, "row_idx").write.mode("overwrite").bucketBy(buckets, "row_idx").sortBy("row_idx").option("path", path).format("parquet").saveAsTable(name)
    return int(seen.get["n_invalid"])


def open_store(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The table of a store that another session wrote."""
    quoted = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (row_idx BIGINT, words ARRAY<BIGINT>) USING parquet CLUSTERED BY (row_idx) SORTED BY (row_idx) INTO {buckets} BUCKETS LOCATION '{quoted}'")
    return spark.table(name)


def gather(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The store's rows for the given row_idx, with the keys' other columns; only the keys are shuffled."""
    return store.join(keys, "row_idx")


def finished(spark: SparkSession, path: str) -> set[int]:
    """Numbers of the blocks under path that were committed whole."""
    folder, fs = filesystem(spark, path)
    if not fs.exists(folder):
        return set()
    made = (f.getPath() for f in fs.listStatus(folder))
    return {int(p.getName().split("=")[1]) for p in made if p.getName().startswith("block=") and fs.exists(p.suffix("/_SUCCESS"))}


def run_blocks(rows: DataFrame, path: str, run: Callable[[DataFrame], DataFrame], blocks: int = 32, key: str = "row_idx") -> DataFrame:
    """The result of run over rows, worked off block by block and kept under path; a second call runs only what a stop left undone.

    Rows are dealt to blocks by key and written once, so that each block reads
    its own files.  A block counts when its job has committed; what a stopped
    job left is overwritten.  run has to work on each block alone.
    """
    spark = rows.sparkSession
    root = path.rstrip("/")
    if not _committed(spark, f"{root}/input"):
        dealt = rows.withColumn("block_", F.pmod(F.xxhash64(key), F.lit(blocks)))
        dealt.repartition("block_").write.mode("overwrite").partitionBy("block_").parquet(f"{root}/input")
    source = spark.read.schema(rows.schema.add("block_", "long")).parquet(f"{root}/input")
    done = finished(spark, f"{root}/done")
    out = None
    for k in range(blocks):
        if k not in done:
            out = run(source.where(C("block_") == k).drop("block_"))
            out.write.mode("overwrite").parquet(f"{root}/done/block={k}")
    kept = spark.read.schema(out.schema).parquet(f"{root}/done") if out is not None else spark.read.parquet(f"{root}/done")
    return kept.drop("block")


def _committed(spark: SparkSession, path: str) -> bool:
    folder, fs = filesystem(spark, path)
    return bool(fs.exists(folder.suffix("/_SUCCESS")))
