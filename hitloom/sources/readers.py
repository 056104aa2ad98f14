"""Scans: typed Parquet, CSV, JSON, text and binary readers with their guards."""

from __future__ import annotations

import os
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.cleaning import require_columns

C = F.col
ROOTS = {"data": "HITLOOM_DATA", "results": "HITLOOM_RESULTS", "tools": "HITLOOM_TOOLS"}


def root(kind: str) -> str:
    """A configured folder, looked up when it is asked for."""
    path = os.environ.get(ROOTS[kind])
    if not path:
        raise KeyError(f"set {ROOTS[kind]}")
    return path


def selection(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table of which only the named columns are read."""
    df = spark.read.parquet(path)
    return require_columns(df, *columns).select(*columns) if columns else df


supplement = selection


def query_table(spark: SparkSession, path: str, *needed: str, schema: str | None = None) -> DataFrame:
    """Parquet or CSV by suffix, with the columns that are needed."""
    suffix = PurePosixPath(path.rstrip("/")).suffix
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix == ".parquet":
        df = reader.parquet(path)
    elif suffix == ".csv":
        df = reader.csv(path, header=True, inferSchema=schema is None)
    else:
        raise ValueError(f"neither .parquet nor .csv: {path}")
    return require_columns(df, *needed)


def labelled_library(spark: SparkSession, path: str, smiles: str = "SMILES", label: str = "LABEL") -> DataFrame:
    df = query_table(spark, path, smiles, label)
    if not df.agg(F.sum(C(label).cast("long"))).first()[0]:
        raise ValueError(f"{path} has no hits")
    return df


def split_template(spark: SparkSession, path: str) -> DataFrame:
    """Ids and structures, with row_idx: the place in the file, which is what channels go by; several files are an error."""
    from pyspark.sql import Window

    df = spark.read.csv(path, header=True, schema="CatalogID string, SMILES string")
    if (n := df.select(C("_metadata.file_path")).distinct().count()) > 1:
        raise ValueError(f"a template is one file, {path} has {n}")
    placed = df.select("*", C("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("in_block_"))
    order = Window.orderBy("block_", "in_block_")  # a template of a few thousand rows
    return placed.withColumn("row_idx", F.row_number().over(order) - 1).select("CatalogID", "SMILES", "row_idx")


def anchors(spark: SparkSession, path: str, sources: list[str] | None = None, details: list[str] | None = None) -> DataFrame:
    """Anchor structures, filtered by source and then by detail; a value that isn't there is an error."""
    df = query_table(spark, path, "smiles")
    for column, wanted in (("source", sources), ("detail", details)):
        if wanted:
            require_columns(df, column)
            there = {r[0] for r in df.where(C(column).isin(*wanted)).select(column).distinct().collect()}
            if missing := sorted(set(wanted) - there):
                raise ValueError(f"no {column} {missing}")
            df = df.where(C(column).isin(*wanted))
    return df


def channel(spark: SparkSession, path: str, name: str, n_rows: int) -> DataFrame:
    """A score channel (row_idx, score) as long rows; one entry for each of n_rows."""
    df = require_columns(spark.read.parquet(path), "row_idx", "score")
    if (n := df.count()) != n_rows:
        raise ValueError(f"{name} has {n} scores, not {n_rows}")
    return df.select("row_idx", F.lit(name).alias("channel"), C("score").cast("double").alias("score"))


def channel_spec(text: str) -> tuple[str, str, float]:
    """name:file[:weight]."""
    parts = text.split(":")
    if len(parts) not in (2, 3):
        raise ValueError(f"not name:file[:weight]: {text}")
    return parts[0], parts[1], float(parts[2]) if len(parts) == 3 else 1.0


def reference_points(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("aromatic", "hbond")) -> DataFrame:
    df = spark.read.json(path, schema="name string, type string, xyz array<double>, cutoff double", multiLine=True)
    bad = [r[0] for r in df.where(~C("type").isin(*kinds) | C("type").isNull()).select("type").distinct().collect()]
    if bad:
        raise ValueError(f"types {bad} aren't among {kinds}")
    return df


def affinities(spark: SparkSession, folders: list[str], ids: DataFrame, field: str = "affinity_probability_binary") -> tuple[DataFrame, DataFrame]:
    """id and score for each id, null where there is none, and one row of counts.

    Files are affinity_<id>.json anywhere under the folders.  Files without the
    field are skipped; of several scores of an id the one in the last folder
    counts.  The counts are of files.
    """
    parts = None
    for k, folder in enumerate(folders):
        one = spark.read.schema(f"`{field}` double").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "affinity_*.json").json(folder)
        one = one.select(F.regexp_extract(C("_metadata.file_name"), r"affinity_(.*)\.json$", 1).alias("id"), C(field).alias("score"), F.lit(k).alias("k"))
        parts = one if parts is None else parts.unionByName(one)
    last = parts.where("score is not null").groupBy("id").agg(F.max_by("score", "k").alias("score"))
    known = ids.select("id").distinct()
    counts = parts.join(known.withColumn("known_", F.lit(True)), "id", "left").agg(F.count_if(C("known_") & C("score").isNotNull()).alias("n_found"), F.count_if(C("known_") & C("score").isNull()).alias("n_missing_field"), F.count_if(C("known_").isNull()).alias("n_unmatched"))
    return ids.join(last, "id", "left"), counts


def describe(df: DataFrame) -> DataFrame:
    """column, type, n_rows, n_null, null_rate, least and largest (as text), in one pass."""
    kinds = dict(df.dtypes)
    aggs = [F.count("*").alias("n_")]
    for k, c in enumerate(df.columns):
        aggs += [F.count_if(C(c).isNull()).alias(f"z{k}"), F.min(c).cast("string").alias(f"l{k}"), F.max(c).cast("string").alias(f"h{k}")]
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), C("n_").alias("n_rows"), C(f"z{k}").alias("n_null"), F.try_divide(C(f"z{k}").cast("double"), C("n_").cast("double")).alias("null_rate"), C(f"l{k}").alias("least"), C(f"h{k}").alias("largest")) for k, c in enumerate(df.columns)))
    return df.agg(*aggs).select(F.inline(rows))


#: types whose least and largest values Parquet keeps exactly in a file's footer
FOOTER_TYPES = ("tinyint", "smallint", "int", "bigint", "boolean", "date")


def describe_files(spark: SparkSession, path: str) -> DataFrame:
    """The same for Parquet files, from their footers: counts of all columns, and least and largest where footers keep them exactly.

    Only the columns of other types (texts, which footers cut short, and
    floating point, whose NaN they leave out) are scanned for these.  The plan
    belongs to a session of its own, with pushed aggregates switched on.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    df = own.read.parquet(path)
    kinds = dict(df.dtypes)
    ends = lambda k, c: [F.min(c).alias(f"l{k}"), F.max(c).alias(f"h{k}")]
    footer = [F.count("*").alias("n_"), *(F.count(c).alias(f"c{k}") for k, c in enumerate(df.columns))]
    footer += [a for k, c in enumerate(df.columns) if kinds[c] in FOOTER_TYPES for a in ends(k, c)]
    scan = [a for k, c in enumerate(df.columns) if kinds[c] not in FOOTER_TYPES for a in ends(k, c)]
    one = df.agg(*footer)
    if scan:
        one = one.crossJoin(df.agg(*scan))  # one row each
    null = lambda k: C("n_") - C(f"c{k}")
    rows = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), C("n_").alias("n_rows"), null(k).alias("n_null"), F.try_divide(null(k).cast("double"), C("n_").cast("double")).alias("null_rate"), C(f"l{k}").cast("string").alias("least"), C(f"h{k}").cast("string").alias("largest")) for k, c in enumerate(df.columns)]
    return one.select(F.inline(F.array(*rows)))


def nul_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path and n_nul of binary files."""
    hexed = F.hex("content")
    pairs = F.regexp_replace(hexed, "(..)", "$1 ")
    return spark.read.format("binaryFile").load(path).select("path", (F.length(pairs) - F.length(F.replace(pairs, F.lit("00 "), F.lit("")))).alias("n3")).select("path", (C("n3") / 3).cast("long").alias("n_nul"))


class NulBytes(ValueError):
    """An alignment file that holds NUL bytes."""


def check_alignment(spark: SparkSession, path: str) -> None:
    bad = nul_bytes(spark, path).where("n_nul > 0").limit(5).collect()
    if bad:
        raise NulBytes(", ".join(f"{r['path']}: {r['n_nul']}" for r in bad))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
