"""The driver tables read as a selection screen: the same SQL text runs on Spark and on the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SELECTION = """
SELECT
  CASE WHEN l_linenumber = 7 AND l_orderkey % 11 = 0 THEN 'bad-id'
       ELSE concat('qDOS', CAST(l_suppkey % 6 AS STRING), '-', CAST(l_partkey % 20 AS STRING), '-',
                   CAST(l_suppkey % 15 AS STRING), '-', CAST(l_orderkey % 30 AS STRING)) END AS compound,
  CASE WHEN l_orderkey % 97 = 0 THEN '' WHEN l_orderkey % 89 = 0 THEN 'NNNNNNNNNNNN'
       ELSE concat('Compound', CAST(l_orderkey AS STRING), CAST(l_partkey % 3 AS STRING)) END AS smiles,
  CAST(floor(50 / l_quantity) AS BIGINT) AS count_target,
  CAST(CASE WHEN l_returnflag = 'R' THEN l_linenumber % 3 ELSE 0 END AS BIGINT) AS count_inhibitor,
  CAST(CASE WHEN l_discount >= 0.095 THEN 1 ELSE 0 END AS BIGINT) AS count_ntc,
  CAST(l_orderkey % 7 AS BIGINT) AS historic_hits,
  l_extendedprice / 20000 - 1 AS zscore
FROM lineitem
"""

SUPPLEMENT = """
SELECT
  CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 43 = 0 THEN NULL
       WHEN o_orderkey % 5 = 0 THEN concat('Compound', CAST(o_orderkey AS STRING), '0')
       WHEN o_orderkey % 7 = 0 THEN concat('Control', CAST(o_orderkey - o_orderkey % 14 AS STRING), 'X')
       ELSE concat('Control', CAST(o_orderkey AS STRING)) END AS smiles,
  CAST(o_custkey % 3 AS BIGINT) AS count_ntc
FROM orders
"""

ENUMERATION = "SELECT DISTINCT compound FROM selection WHERE substr(md5(compound), 1, 1) <> '0'"

CHANNELS = """
SELECT d.doc_id AS row_idx, 'length' AS channel, CAST(d.n_chars AS DOUBLE) AS score FROM documents d
UNION ALL
SELECT d.doc_id, 'label', CASE WHEN l.toxic = 0 THEN CAST(l.quality AS DOUBLE) * 10 + d.doc_id % 7 END FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
UNION ALL
SELECT d.doc_id, 'draw', CAST(ascii(substr(md5(CAST(d.doc_id AS STRING)), 1, 1)) * 128 + ascii(substr(md5(CAST(d.doc_id AS STRING)), 2, 1)) AS DOUBLE) FROM documents d
"""

RANKED = "SELECT d.doc_id AS row_idx, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    frames = {t: _table(spark, sf_dir, t) for t in tables}
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **frames)


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SELECTION, "lineitem")


def supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SUPPLEMENT, "orders")


def enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ENUMERATION.replace("FROM selection", "FROM {selection}"), selection=selection(spark, sf_dir))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CHANNELS, "documents", "labels")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RANKED, "documents", "labels")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings")
