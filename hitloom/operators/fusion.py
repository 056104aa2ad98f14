"""Fusing score channels: a long table (row_idx, channel, score), null for not scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cleaning import finite
from . import clustering

C = F.col
RANK_OFFSET = 60


def clean(channels: DataFrame) -> DataFrame:
    return channels.select("row_idx", "channel", finite(C("score")).alias("score"))


def check_lengths(channels: DataFrame, n_rows: int) -> None:
    """Each channel has one entry for each row of the table, or an error."""
    bad = channels.groupBy("channel").agg(F.count("*").alias("n"), F.countDistinct("row_idx").alias("d")).where((C("n") != n_rows) | (C("d") != n_rows)).collect()
    if bad:
        raise ValueError(f"channels of another length than {n_rows}: {[r['channel'] for r in bad]}")


def min_max(channels: DataFrame) -> DataFrame:
    """Each channel scaled to [0, 1]; a constant one to 0; null stays null.

    Ranges are one row for each channel, so they are joined, not windowed: no
    channel has to fit a task.
    """
    c = clean(channels)
    ranges = c.groupBy("channel").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(C("score").isNull(), None).when(C("hi") <= C("lo"), 0.0).otherwise((C("score") - C("lo")) / (C("hi") - C("lo")))
    return c.join(ranges, "channel").select("row_idx", "channel", scaled.alias("score"))


def combined_score(channels: DataFrame) -> DataFrame:
    """The largest scaled score of each row; 0 without any."""
    return min_max(channels).groupBy("row_idx").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))


def top_of_channels(channels: DataFrame, n: int | dict[str, int]) -> DataFrame:
    """Rank of the n best rows of each channel (or as many as it is given); tasks drop the others before the shuffle."""
    w = Window.partitionBy("channel").orderBy(F.desc("score"), "row_idx")
    most = max(n.values(), default=0) if isinstance(n, dict) else n
    top = clean(channels).where("score is not null").withColumn("rank", F.row_number().over(w)).where(C("rank") <= most)
    if isinstance(n, dict):
        top = top.where(F.coalesce(*(F.when(C("channel") == k, C("rank") <= v) for k, v in sorted(n.items())), F.lit(False)))
    return top


def reciprocal_rank(channels: DataFrame, n: int, weights: dict[str, float] | None = None) -> DataFrame:
    """row_idx and rrf: the sum of weight / (60 + rank); rows outside all tops aren't in it."""
    pairs = [x for k, v in sorted((weights or {}).items()) for x in (F.lit(k), F.lit(float(v)))]
    weight = F.coalesce(F.try_element_at(F.create_map(*pairs), C("channel")), F.lit(1.0)) if pairs else F.lit(1.0)
    return top_of_channels(channels, n).groupBy("row_idx").agg(F.sum(weight / (F.lit(float(RANK_OFFSET)) + C("rank"))).alias("rrf"))


def greedy_diverse(candidates: DataFrame, n: int, score: str = "rrf", series: str = "series", row: str = "row_idx") -> DataFrame:
    """The n picks: first the best of each series by score, then the others by score.

    Two sorts instead of a loop; the first n of an ordering are a distributed
    top-k.
    """
    own = Window.partitionBy(series).orderBy(F.desc(score), row)
    marked = candidates.withColumn("repeat_", (F.row_number().over(own) > 1).cast("int"))
    order = ["repeat_", F.desc(score), row]
    picks = marked.orderBy(*order).limit(n)
    return picks.withColumn("pick", F.row_number().over(Window.orderBy(*order))).drop("repeat_")  # n rows


def need_picks(picks: DataFrame, n: int) -> DataFrame:
    found = picks.count()
    if found < n:
        raise RuntimeError(f"only {found} candidates, need {n}; take more of each channel")
    return picks


def series_counts(candidates: DataFrame, picks: DataFrame) -> DataFrame:
    return candidates.agg(F.countDistinct("series").alias("n_series_pool")).crossJoin(picks.agg(F.countDistinct("series").alias("n_series_picked")))  # one row each


def naive_top(scores: DataFrame, n: int = 50) -> DataFrame:
    return scores.orderBy(F.desc_nulls_last(finite(C("score"))), "row_idx").limit(n)


def shortlist(channels: DataFrame, n: int | dict[str, int]) -> DataFrame:
    """The union of all tops: in how many channels a row is, and in which."""
    top = top_of_channels(channels, n).groupBy("row_idx").agg(F.array_sort(F.collect_set("channel")).alias("c"))
    return top.select("row_idx", F.size("c").cast("long").alias("n_sources"), F.array_join("c", ";").alias("sources"))


def shortlist_table(short: DataFrame, template: DataFrame, key: str = "CatalogID") -> DataFrame:
    """A shortlist with ids, rows of most channels first, then by id; place counts from 1."""
    order = Window.orderBy(F.desc("n_sources"), key)  # a shortlist of a few thousand rows
    return short.join(template, "row_idx").withColumn("place", F.row_number().over(order)).orderBy("place")


def channel_members(short: DataFrame) -> DataFrame:
    """channel and n: how many rows of a shortlist name it among their sources."""
    return short.select(F.explode(F.split("sources", ";")).alias("channel")).groupBy("channel").agg(F.count("*").alias("n"))


def fuse_and_select(channels: DataFrame, fingerprints: DataFrame, n_rows: int, n: int = 50, per_channel: int = 500, weights: dict[str, float] | None = None, distance: float = 0.32) -> tuple[DataFrame, DataFrame]:
    """Picks and the combined score of every row.

    Only the candidates (at most per_channel for each channel) are clustered.
    """
    check_lengths(channels, n_rows)
    ranked = reciprocal_rank(channels, per_channel, weights)
    pool = ranked.join(fingerprints, "row_idx", "left")
    series = clustering.average_linkage(pool.select("row_idx", "bits"), distance).withColumnRenamed("cluster", "series")
    picks = need_picks(greedy_diverse(ranked.join(series, "row_idx"), n), n)
    return picks, combined_score(channels)
