"""Keyword scores and per-user search history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import materialize, sized

SCORE_PER_SEARCH = 5


def keyword_scores(log: DataFrame, min_length: int = 0) -> DataFrame:
    """Score per keyword: five for each search."""
    if min_length:
        log = log.filter(F.length("keyword") >= min_length)
    return log.groupBy("keyword").agg(
        (F.count(F.lit(1)) * F.lit(SCORE_PER_SEARCH)).cast("bigint").alias("score"))


def hot_keywords(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k best keywords; equal scores in reverse key order."""
    return scores.orderBy(F.desc("score"), F.desc("keyword")).limit(k)


def recent_searches(log: DataFrame, k: int = 5, min_length: int = 2) -> DataFrame:
    """Last k distinct keywords of each user, newest first."""
    last = (log.filter(F.length("keyword") >= min_length)
            .groupBy("user_id", "keyword").agg(F.max("ts").alias("last_ts")))
    newest = Window.partitionBy("user_id").orderBy(F.desc("last_ts"), F.asc("keyword"))
    return (last.withColumn("rank", F.row_number().over(newest))
            .filter(F.col("rank") <= k))


def first_seen_history(log: DataFrame, ranges: int | None = None) -> DataFrame:
    """All distinct keywords of each user in the order of their first search.

    The rows are range-partitioned by (user, first time, keyword), so a user with a third of all rows lies in many
    partitions, and even one instant does. A row's rank is its place in its partition's share of the user, plus
    what the partitions before hold of the user: no window spans a user.
    """
    first = log.groupBy("user_id", "keyword").agg(F.min("ts").alias("first_ts"))
    order = ["user_id", "first_ts", "keyword"]
    spread_out = first.repartitionByRange(ranges, *order) if ranges else first.repartitionByRange(*order)
    # written, so that both steps below see the same partitions
    cut = materialize(spread_out.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    # one row for each user of a partition
    counts = cut.groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("user_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("user_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("user_id", "part").orderBy("first_ts", "keyword")
    # a null user is a user of its own
    there = cut.withColumn("place", F.row_number().over(inside)).alias("r")
    ahead = sized(offsets).alias("o")
    return (there.join(ahead, F.col("r.user_id").eqNullSafe(F.col("o.user_id")) & (F.col("r.part") == F.col("o.part")))
            .select("r.user_id", "r.keyword", "r.first_ts", (F.col("before") + F.col("place")).alias("rank")))
