"""Helpers of the operators: tables cut from their lineage, words, components of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import BROADCAST_ROWS, scratch_path, ship_package

# bytes of a text that are split into words at once
WORD_CHUNK = 1 << 22
# bits of a filter for each key, and its least and greatest size
FILTER_BITS = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
# components of a bucket beyond which its members are dealt again
HOT_PARTS = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as Parquet in the shared folder: its lineage ends there, and any executor can read it."""
    ship_package(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_rows(table: DataFrame) -> DataFrame:
    """A written table, sent to all tasks of its joins if it has at most BROADCAST_ROWS rows, else shuffled.

    Spark goes by the bytes of files, which say little of the rows in them.
    """
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap of hashed long keys: FILTER_BITS bits for each, up to a fixed size.

    Its blocks are made by aggregates; what comes to the driver is at most MOST_BITS bits whatever the input.
    """
    n = keys.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (FILTER_BITS * n).bit_length()))
    place = F.col(key).bitwiseAND(size - 1) + 1
    found = (keys.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("block"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    bits = np.zeros(size // 8, np.uint8)
    for r in found:
        block = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["block"] - 1) * len(block)
        bits[at:at + len(block)] = block
    return bits


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key whether it may be one of the filter's; false only where it is not."""
    at = (keys.astype(np.int64) & (len(bits) * 8 - 1))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text in runs, so that a long text is never one list."""
    chunk = WORD_CHUNK
    if len(data) <= chunk:
        yield data.split()
        return
    start = 0
    while start < len(data):
        end = min(start + chunk, len(data))
        # go on to the next white space, so that no word is cut
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[start:end].split()
        start = end


def components(links: DataFrame) -> DataFrame:
    """Connected components of links(a, b): one row (id, root) per linked id, root the smallest id.

    Every round hangs each id under its smallest neighbour, follows these parents to
    their ends by doubling, and goes on with the links between different ends; their
    number at least halves.  All steps are joins against one row per id and
    aggregates that combine on the map side, so a hub with very many links is split.
    """
    def canonical(df: DataFrame) -> DataFrame:
        return (df.where("a is not null and b is not null and a <> b")
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    rest = written(canonical(links), "links")
    found = None
    while not rest.isEmpty():
        ends = rest.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
            rest.select(F.col("b").alias("id"), F.col("a").alias("other")))
        parent = written(ends.groupBy("id").agg(F.min("other").alias("low"))
                         .select("id", F.least("id", "low").alias("root")), "parents")
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("higher"))
            jumped = written(parent.join(up, "root").select(
                "id", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")), "jumps")
            parent = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break
        left = parent.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        rest = written(canonical(rest.join(left, "a").join(right, "b")
                                 .select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "links")
        if found is None:
            found = parent
        else:
            next_root = parent.select(F.col("id").alias("root"), F.col("root").alias("higher"))
            found = written(found.join(next_root, "root", "left").select(
                "id", F.coalesce("higher", "root").alias("root")), "roots")
    if found is None:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return found


def link_within_buckets(members: DataFrame, verified: Callable[[DataFrame], DataFrame],
                        prepare: Callable[[DataFrame], None] | None = None,
                        deal_again: Callable[[DataFrame], DataFrame] | None = None,
                        sketches: Callable[[], DataFrame] | None = None,
                        possible: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Components of all ids that share a bucket and pass `verified`, without all pairs of a bucket.

    members(bucket..., id): `bucket` is one column.  `verified` takes distinct pairs
    (a, b) and returns those that are links; `prepare` sees the ids (id) that may be
    in a pair before that.  First each member is compared with the
    smallest id of its bucket, which joins most of a group of near copies.  Then only
    pairs in different components are left to compare; the members outside a
    bucket's largest component are met with the bucket's other components.  After that no
    pair of a bucket is in two components and a link, so the components are those of all pairs that meet.
    `deal_again` gives the ids of buckets with more than HOT_PARTS components new, narrower buckets
    instead, where alike but unlinked members are many.  Of these ids, pairs that meet in the narrower buckets
    count, not those of the bucket they came from, so a link must meet there as surely.
    `sketches` gives (id, sketch) of all ids that `prepare` saw, and `possible` says of two sketches whether they can be
    a link; it must never be false for one.  Other pairs are then not formed, and of the rest each id's smallest
    partner is verified first, then only what lies in two components still.
    Returns (id, root) for linked ids.
    """
    sizes = members.groupBy("bucket").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1")
    # members come from an explode, which Spark takes for no larger than its input: both sides are shuffled, whatever it expects
    shared = written(members.hint("merge").join(sizes.drop("n"), "bucket"), "members")
    if prepare:
        prepare(shared.select("id").distinct())
    stars = (shared.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct())
    first = written(verified(stars), "stars")
    roots = by_rows(components(first))
    placed = written(shared.join(roots, "id", "left").select(
        "bucket", "id", F.coalesce("root", "id").alias("root")), "placed")
    if deal_again:
        hot = _parts(placed).where(F.col("parts") > HOT_PARTS).select("bucket")
        of_hot = written(placed.join(hot, "bucket").select("id", "root").distinct(), "hot-members")
        again = written(deal_again(of_hot.select("id")).join(of_hot, "id").select("bucket", "id", "root"), "dealt-again")
        apart = [placed.join(hot, "bucket", "left_anti"), again]
    else:
        apart = [placed]
    of_ids = sketches() if sketches else None
    cross = reduce(DataFrame.unionByName, [_cross(p, of_ids, possible) for p in apart])
    cross = cross.distinct() if len(apart) > 1 else cross
    if of_ids is None:
        return components(first.unionByName(written(verified(cross), "cross")))
    cross = written(cross, "cross-pairs")
    nearest = written(cross.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "nearest")
    first = written(first.unionByName(verified(nearest)), "first-links")
    roots = written(components(first), "first-roots")
    a = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    b = roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    rest = written(cross.join(nearest, ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left")
                   .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "still-apart")
    return components(first.unionByName(written(verified(rest), "cross")))


def _parts(placed: DataFrame) -> DataFrame:
    """(bucket, top, parts): the largest component of each bucket and their number, where there are several."""
    return (placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
            .groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts"))
            .where("parts > 1").select("bucket", F.col("top.root").alias("top"), "parts"))


def _cross(placed: DataFrame, sketches: DataFrame | None = None, possible: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Distinct pairs (a, b) of one bucket and two components; no pair lies inside a bucket's largest component.

    With sketches, only the pairs whose sketches can be a link.
    """
    split = placed.join(by_rows(written(_parts(placed).drop("parts"), "parts")), "bucket")
    split = split.withColumn("sketch", F.lit(None)) if sketches is None else split.join(sketches, "id")
    outside = split.where("root <> top").select("bucket", F.col("id").alias("a"), F.col("root").alias("ra"), F.col("sketch").alias("sa"))
    inside = split.select("bucket", F.col("id").alias("b"), F.col("root").alias("rb"), (F.col("root") == F.col("top")).alias("main"),
                          F.col("sketch").alias("sb"))
    fits = F.lit(True) if possible is None else possible(F.col("sa"), F.col("sb"))
    return (outside.hint("merge").join(inside, "bucket").where("ra <> rb and (main or a < b)").where(fits)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def with_components(rows: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """`rows` with the root of their key, the key itself where it has no link."""
    named = by_rows(roots.select(F.col("id").alias(key), F.col("root")))
    return rows.join(named, key, "left").withColumn("root", F.coalesce("root", key))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
