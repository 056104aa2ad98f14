"""Sharding by extendible hashing (operator 2), with DataFrame functions only.

Each document has 60 hash bits.  The directory is indexed by prefixes of these
bits; a bucket is the shortest prefix under which all documents together stay
within the byte limit, so only oversized buckets are split on a further bit.
Sums are taken for the cells of a depth a little beyond what the total asks
for, and rolled up to the shorter prefixes; only the documents of cells that
are still too large come into the next, deeper round.  Documents that share
all 60 bits (repeated ids) can't be told apart by hash; where such a bucket is
too large it is cut into parts by running size.

Sums are pre-aggregated before each shuffle and the shuffled rows hold no
text.  Rows that are cut by running size are summed in slices, one for each
task that read them, and slices are moved on by the sums of those before, so
that an id that a third of all rows repeat needs no task of its own.

Defined cases: a null text has no bytes, and a text of any length counts in
full; a null id is hashed as the empty string and shares a bucket with the
other null ids; repeated rows count each, and which of equal rows comes into
which part is open; a document over the limit gets a shard to itself; an empty
table gives no rows; other columns are ignored or, in ``write_shards``, written,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .common import written

BITS = 60


def _hash(column):
    """The first 60 bits of the md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _resolve(rows: DataFrame, least: int, depth: int, limit: int) -> DataFrame:
    """For each cell of the depth: the smallest depth from ``least`` on whose bucket fits (null: none)."""
    cells = rows.groupBy(F.shiftright("h", BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    up = cells.select("*", F.explode(F.sequence(F.lit(least), F.lit(depth))).alias("d")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - d)"))
    buckets = up.groupBy("d", "prefix").agg(F.sum("b").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fit = buckets.where((F.col("total") <= limit) | (F.col("lo") == F.col("hi"))).select("d", "prefix", F.col("total").alias("shard_bytes"))
    best = up.select("cell", "d", "prefix").join(fit, ["d", "prefix"]).groupBy("cell").agg(F.min(F.struct("d", "prefix", "shard_bytes")).alias("m"))
    return cells.select("cell").join(best, "cell", "left").select("cell", "m.*")


def _sizes(docs: DataFrame) -> dict:
    """The columns that a plan needs of each document."""
    sizes = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    return {"n_bytes": sizes, "h": _hash(F.col("doc_id").cast("long")), "slice": F.spark_partition_id()}


def _plan(rows: DataFrame, limit: int) -> DataFrame:
    """Written rows with n_bytes, h and slice: their depth, prefix, part and shard_bytes beside all else."""
    names = rows.columns
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, least, done = min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + 3), 0, []
    while True:
        found = rows.withColumn("cell", F.shiftright("h", BITS - depth)).join(_resolve(rows, least, depth, limit), "cell")
        done.append(found.where(F.col("d").isNotNull()))
        if depth == BITS:
            break
        rows = written(found.where(F.col("d").isNull()).select(*names), "oversized")
        if rows.isEmpty():
            break
        least, depth = depth + 1, min(BITS, depth + 8)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select(*names, F.col("d").cast("int").alias("depth"), "prefix", F.col("shard_bytes").cast("long").alias("shard_bytes"))
    fits = out.where(F.col("shard_bytes") <= limit).withColumn("part", F.lit(0).cast("long"))
    cut = out.where(F.col("shard_bytes") > limit).withColumn("small", F.col("n_bytes") * 2 <= limit)
    slices = cut.groupBy("h", "small", "slice").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("k"))
    ahead = Window.partitionBy("h", "small").orderBy("slice")  # a row for each task that read rows
    slices = slices.select("h", "small", "slice", (F.sum("b").over(ahead) - F.col("b")).alias("bytes_before"), (F.sum("k").over(ahead) - F.col("k")).alias("rows_before"))
    own = Window.partitionBy("h", "small", "slice").orderBy("n_bytes")
    before = F.col("bytes_before") + F.sum("n_bytes").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes")
    cut = cut.join(slices, ["h", "small", "slice"])
    cut = cut.withColumn("part", F.when(F.col("small"), F.floor(before * 2 / limit)).otherwise(-(F.col("rows_before") + F.row_number().over(own))).cast("long"))
    parts = cut.groupBy("h", "part").agg(F.sum("n_bytes").cast("long").alias("part_bytes"))
    cut = cut.join(parts, ["h", "part"]).withColumn("shard_bytes", F.col("part_bytes"))
    return fits.unionByName(cut.select(*fits.columns))


def shard(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, depth, prefix, part and shard_bytes of each document."""
    rows = docs.select(F.col("doc_id").cast("long"), *(c.alias(k) for k, c in _sizes(docs).items()))
    return _plan(written(rows, "sizes"), limit).select("doc_id", "n_bytes", "depth", "prefix", "part", "shard_bytes")


def write_shards(docs: DataFrame, limit: int, path: str) -> str:
    """Write documents as Parquet in one folder for each shard; the name of the column that the folders stand for.

    Rows carry their shard themselves, so that repeated and null ids go where
    the plan put them.  Tasks are made by shard, no shard is larger than the
    limit (but a document that is alone is), and no task holds more than a few.
    """
    own = [f"own_{k}" for k in range(len(docs.columns))]
    rows = written(docs.select(*(docs[c].alias(o) for c, o in zip(docs.columns, own, strict=True)), *(c.alias(k) for k, c in _sizes(docs).items())), "documents")
    name = "shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    placed = _plan(rows, limit).select(*(F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)), F.concat_ws("-", "depth", "prefix", "part").alias(name))
    placed.repartition(name).write.partitionBy(name).parquet(path)
    return name


def oracle(limit: int) -> str:
    """The same mapping in DuckDB SQL, for ids that don't repeat."""
    return f"""
    WITH s AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
                      CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
         u AS (SELECT s.*, d.d, h >> ({BITS} - d.d) AS prefix FROM s, (SELECT CAST(range AS INTEGER) AS d FROM range({BITS + 1})) d),
         b AS (SELECT d, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, min(h) = max(h) AS one FROM u GROUP BY d, prefix),
         f AS (SELECT u.doc_id, u.n_bytes, u.d, u.prefix, b.shard_bytes,
                      row_number() OVER (PARTITION BY u.doc_id ORDER BY u.d) AS k
               FROM u JOIN b USING (d, prefix) WHERE b.shard_bytes <= {limit} OR b.one)
    SELECT doc_id, n_bytes, d AS depth, prefix, CAST(0 AS BIGINT) AS part, shard_bytes FROM f WHERE k = 1
    """
