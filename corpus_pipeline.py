"""The corpus pipeline: quality rules, quality classifier, near-duplicate documents, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.  No stage can be expressed in SQL as a whole.

Defined cases: documents with a null or empty text fail the quality rules; a
null id is kept as it is where its text is good; repeated rows are copies, of
which one stays if they have an id; texts of any length are judged as wholes;
further columns, whatever their names, pass all stages but the last, which
returns its own; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers

from hitloom.llm import jaccard_join, packing, passage_dedup, quality_classifier, quality_rules
from hitloom.llm.common import written


def good_by_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and lie in their language's perplexity band."""
    return quality_rules.keep_good(docs)


def good_by_classifier(spark, docs, sf_dir):
    """Documents that the additive model, fitted to the labelled ones among them, predicts as good."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark, docs, sf_dir):
    """The first document of each group linked by shingle similarity of 0.75 or more."""
    return jaccard_join.keep_first(docs)


def without_repeated_passages(spark, docs, sf_dir):
    """Documents without the passages that near-duplicate an earlier one; documents left empty go."""
    cut = passage_dedup.cut_repeats(docs)
    return cut.where("text is null or text != ''")


def packed(spark, docs, sf_dir):
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", good_by_rules),
    ("quality_classifier", good_by_classifier),
    ("jaccard_join", one_of_each_group),
    ("passage_dedup", without_repeated_passages),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply all stages to documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
