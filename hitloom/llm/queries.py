"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import oracles, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_sentencepiece")
def op1(spark, sf_dir):
    import public_tokenizers

    from .sentencepiece_codec import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_quality_rules")
def op4(spark, sf_dir):
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7(spark, sf_dir):
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op5_quality_classifier")
def op5(spark, sf_dir):
    from .quality_classifier import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


SHARD_BYTES = 1 << 20


@query("op2_sharding", sharding.oracle(SHARD_BYTES))
def op2(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query("op10_neighbours")
def op10(spark, sf_dir):
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query("op9_jaccard_join", oracles.shingle_components(5, 3, 4))
def op9(spark, sf_dir):
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op6_suffix_dedup", oracles.removal(100))
def op6(spark, sf_dir):
    from .suffix_dedup import removal

    return removal(table(spark, sf_dir, "documents"))


@query("op3_stupid_backoff", oracles.backoff(0.4, 1))
def op3(spark, sf_dir):
    from .stupid_backoff import scores

    return scores(table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 6))


@query("op8_passage_dedup")
def op8(spark, sf_dir):
    from .passage_dedup import removal

    return removal(table(spark, sf_dir, "documents"))


@query("op13_importance", oracles.importance(10_000, 25, 20, 7))
def op13(spark, sf_dir):
    from .importance import resample

    target = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return resample(table(spark, sf_dir, "documents"), target)


def planted(docs):
    """A tenth of the texts made periodic from some word on, as operator 12's contract says."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    rows = docs.select("doc_id", "text", h.alias("h"), words.alias("words"))
    rows = rows.withColumn("a", F.when(n > 0, g % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), n - F.col("a"))), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    from .periodic_runs import collapse, digests

    return digests(collapse(planted(table(spark, sf_dir, "documents"))))


@query("op11_chat_format")
def op11(spark, sf_dir):
    import public_tokenizers

    from .chat_format import digests, format_chats

    file = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(format_chats(turns, *file), *file, dealt=True)
