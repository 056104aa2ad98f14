"""Early recognition: enrichment, LogAUC, ROC, average precision, and permutation nulls.

Scores are higher-is-better; null, NaN and infinite ones are left out first.
Ties are broken by the row id.  No window holds a whole table: the top k are
taken by a distributed top-k, and ranks come from slices of the score axis.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.cleaning import finite, ratio
from ..functions.draws import distinct_draws
from ..functions.lineage import settled
from ..functions.ranks import sliced

C = F.col


def scored(df: DataFrame, score: str = "score", label: str = "label", row: str = "row_idx") -> DataFrame:
    return df.select(C(row).alias("row_idx"), finite(C(score)).alias("score"), C(label).cast("int").alias("label")).where("score is not null and label is not null")


def sizes(rows: DataFrame) -> tuple[int, int]:
    n, hits = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    return int(n), int(hits)


def enrichment(rows: DataFrame, k: int) -> DataFrame:
    """Hit rate of the first k over that of all; divided by k even if there are fewer rows; null without hits."""
    top = rows.orderBy(F.desc("score"), "row_idx").limit(k).agg(F.sum("label").alias("h"))
    every = rows.agg(F.sum("label").alias("hits"), F.count("*").alias("n"))
    return top.crossJoin(every).select((ratio(C("h"), F.lit(k)) / F.nullif(ratio(C("hits"), C("n")), F.lit(0.0))).alias("ef"))  # one row each


def top_count(n: int, share: float) -> int:
    """At least one; a half rounds to the even number."""
    return max(1, round(n * share))


def enrichment_pct(rows: DataFrame, share: float) -> DataFrame:
    return enrichment(rows, top_count(sizes(rows)[0], share))


def _log_auc(fp: Column, n_neg: int, n_pos: int, min_fpr: float | None) -> Column:
    """An aggregate over hits: fp is the number of misses ranked above the hit.

    Between two misses the true-positive rate is constant, so the area is the
    sum over hits of the length of the axis behind them.
    """
    least = 1.0 / n_neg if min_fpr is None else min_fpr
    first = max(1, math.ceil(least * n_neg - 1e-12))
    span = -math.log10(least)
    if span <= 0 or n_pos == 0 or first > n_neg:
        return F.lit(None).cast("double")
    lead = max(0.0, (math.log10(first / n_neg) + span) / 2)
    part = -F.log10(F.greatest(fp.cast("double"), F.lit(float(first))) / n_neg) + F.when(fp < first, F.lit(lead)).otherwise(0.0)
    return F.sum(part) / (n_pos * span)


def log_auc(rows: DataFrame, min_fpr: float | None = None) -> DataFrame:
    """Area under the true-positive rate over log10 of the false-positive rate, scaled to 1; null without hits or misses."""
    rows = settled(rows.select("row_idx", "score", "label"), "scored")  # counts, cuts and ranks read it: one scan of the input
    n, n_pos = sizes(rows)
    if n_pos in (0, n):
        return rows.sparkSession.range(1).select(F.lit(None).cast("double").alias("log_auc"))
    hits = ranked_hits(rows)
    return hits.agg(_log_auc(C("rn") - C("hit"), n - n_pos, n_pos, min_fpr).alias("log_auc"))


def ranked_hits(rows: DataFrame) -> DataFrame:
    """Hits with their rank among all (rn) and among hits (hit): both are running counts in a slice, after those of the slices above."""
    cut = sliced(rows.where("score is not null"), "score")
    counts = cut.groupBy("slice_").agg(F.count("*").alias("n_"), F.sum("label").alias("h_"))
    w = Window.orderBy("slice_")  # one row for each slice
    above = counts.select("slice_", (F.sum("n_").over(w) - C("n_")).alias("n0_"), (F.sum("h_").over(w) - C("h_")).alias("h0_"))
    own = Window.partitionBy("slice_").orderBy(F.desc("score"), "row_idx").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumns({"rn": F.count("*").over(own), "hit": F.sum("label").over(own)}).where("label = 1")
    return placed.join(above, "slice_").withColumns({"rn": C("rn") + C("n0_"), "hit": C("hit") + C("h0_")}).drop("slice_", "n0_", "h0_")


def summarize(rows: DataFrame) -> DataFrame:
    """n, hits, EF at min(50, n), EF at 1 %, LogAUC."""
    n, hits = sizes(rows)
    out = rows.sparkSession.range(1).select(F.lit(n).cast("long").alias("n_total"), F.lit(hits).cast("long").alias("n_hits"))
    return out.crossJoin(enrichment(rows, min(50, n) or 1).withColumnRenamed("ef", "ef_50")).crossJoin(enrichment_pct(rows, 0.01).withColumnRenamed("ef", "ef_1pct")).crossJoin(log_auc(rows))  # one row each


def by_score(rows: DataFrame) -> DataFrame:
    """Distinct scores with numbers of hits and misses: what ROC and precision need."""
    return rows.groupBy("score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))


def _running(counts: DataFrame) -> DataFrame:
    """Sums over all higher scores, by slices of the score axis."""
    cut = sliced(counts, "score")
    totals = cut.groupBy("slice_").agg(F.sum("p").alias("p_"), F.sum("n").alias("n_"))
    w = Window.orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    totals = totals.select("slice_", F.coalesce(F.sum("p_").over(w), F.lit(0)).alias("p0"), F.coalesce(F.sum("n_").over(w), F.lit(0)).alias("n0"))
    own = Window.partitionBy("slice_").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumns({"pc": F.sum("p").over(own), "nc": F.sum("n").over(own)}).join(F.broadcast(totals), "slice_").select("score", "p", "n", (C("pc") + C("p0")).alias("tp"), (C("nc") + C("n0")).alias("seen"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Share of (hit, miss) pairs in the right order, ties half."""
    r = _running(by_score(rows))
    above = C("tp") - C("p") + C("p") / F.lit(2.0)
    return r.agg(ratio(F.sum((C("n") - C("p")) * above), F.sum("p") * F.sum(C("n") - C("p"))).alias("roc_auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Precision at each distinct score, weighted by the hits found there."""
    r = _running(by_score(rows))
    return r.agg(ratio(F.sum(C("p") * C("tp") / C("seen")), F.sum("p")).alias("average_precision"))


def labels_from_counts(spark: SparkSession, n_total: int, n_hits: int) -> DataFrame:
    """A table of n_total rows of which the first n_hits are hits."""
    return spark.range(n_total).select(C("id").alias("row_idx"), (C("id") < n_hits).cast("int").alias("label"))


def null_from_counts(spark: SparkSession, n_total: int, n_hits: int, n_perm: int = 1000, seed: int = 42) -> DataFrame:
    """perm, metric, value: EF@50, EF@1% and LogAUC of random rankings of n_total rows with n_hits hits.

    A ranking is known by the ranks of its hits, so each permutation draws
    just these: n_perm * n_hits rows, however long the table is.
    """
    hits = distinct_draws(spark, n_total, n_hits, n_perm, seed).select(C("draw").alias("perm"), (C("place") + 1).alias("rn"), C("k").alias("hit"))
    k = top_count(n_total, 0.01)
    rate = n_hits / n_total if n_total else 0
    ef = lambda top: (F.count_if(C("rn") <= top) / F.lit(float(top)) / F.lit(rate))
    wide = hits.groupBy("perm").agg(ef(50).alias("ef_50"), ef(k).alias("ef_1pct"), _log_auc(C("rn") - C("hit"), max(n_total - n_hits, 1), n_hits, None).alias("log_auc"))
    return wide.unpivot("perm", ["ef_50", "ef_1pct", "log_auc"], "metric", "value")


def permutation_null(labels: DataFrame, n_perm: int = 1000, seed: int = 42) -> DataFrame:
    """The null of a table's numbers of rows and hits."""
    n, hits = (int(x) for x in labels.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first())
    return null_from_counts(labels.sparkSession, n, hits, n_perm, seed)


def summarize_null(null: DataFrame) -> DataFrame:
    q = F.percentile("value", [0.5, 0.95, 0.99])
    return null.groupBy("metric").agg(F.avg("value").alias("mean"), q.alias("q"), F.max("value").alias("max")).select("metric", "mean", C("q")[0].alias("p50"), C("q")[1].alias("p95"), C("q")[2].alias("p99"), "max")


def percentiles(observed: DataFrame, null: DataFrame) -> DataFrame:
    """observed: metric, observed value; the share of the null that doesn't exceed it, in percent."""
    return null.join(observed, "metric").groupBy("metric").agg(F.first("observed").alias("observed"), (100 * F.avg((C("value") <= C("observed")).cast("double"))).alias("percentile"))


def observed_metrics(rows: DataFrame) -> DataFrame:
    """metric and observed: EF@50 (over 50 even for fewer rows), EF@1%, LogAUC."""
    one = enrichment(rows, 50).withColumnRenamed("ef", "ef_50").crossJoin(enrichment_pct(rows, 0.01).withColumnRenamed("ef", "ef_1pct")).crossJoin(log_auc(rows))  # one row each
    return one.unpivot([], ["ef_50", "ef_1pct", "log_auc"], "metric", "observed")


def evaluate_channel(df: DataFrame, n_perm: int = 1000, seed: int = 42) -> DataFrame:
    """Observed metrics, their percentiles and the summary of their null, one row for each metric."""
    rows = scored(df)
    null = permutation_null(rows.select("row_idx", "label"), n_perm, seed)
    return percentiles(observed_metrics(rows), null).join(summarize_null(null), "metric")
