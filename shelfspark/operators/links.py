"""The link graph: new links, bounded walks, next-page chains."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import urls
from shelfspark.session import materialize, scratch_path, sized

# folders of visited pages
VISITED_BUCKETS = 32


def clean_fingerprints(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of a seen file -> valid fingerprints, each once."""
    value = F.rtrim(F.regexp_replace(F.col(column), r"\r+$", ""))
    return (lines.select(value.alias("fingerprint"))
            .filter(F.col("fingerprint").rlike("^[0-9a-f]{40}$"))
            .distinct())


def new_links(links: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Distinct links whose fingerprint is not in `seen`.

    The aggregate keeps one row per fingerprint on the map side, so a link that
    is on a third of all pages is no hot key. Both steps share one shuffle key.
    """
    found = (links.select(F.col(url).alias("url"))
             .withColumn("fingerprint", urls.fingerprint(F.col("url")))
             .groupBy("fingerprint").agg(F.min("url").alias("url")))
    return found.join(seen, "fingerprint", "left_anti")


def in_domain_table(links: DataFrame, domains: DataFrame, url: str = "url",
                    domain: str = "domain") -> DataFrame:
    """Links at or below a domain of the table, for lists too long for `in_domains`.

    Works on distinct hosts, so a host with very many links counts once.
    """
    hosts = links.select(urls.host(F.col(url)).alias("host")).distinct()
    allowed = (hosts.select("host", F.explode(urls.host_suffixes(F.concat(F.lit("http://"), "host")))
                            .alias("suffix"))
               .join(domains.select(F.col(domain).alias("suffix")), "suffix", "left_semi")
               .select("host").distinct())
    return (links.withColumn("host", urls.host(F.col(url)))
            .join(allowed, "host", "left_semi").drop("host"))


def walk_frontier(seeds: DataFrame, links: DataFrame, hops: Sequence[str], repeat_last: bool = False,
                  buckets: int = VISITED_BUCKETS) -> DataFrame:
    """Pages reached from `seeds(url)` over `links(src_url, dst_url, route)`.

    Hop n follows only links of route `hops[n - 1]`; a page counts at its
    smallest depth and is expanded once. With `repeat_last` the last route leads into
    itself: it is followed until a level finds no new page.

    Visited pages are one table in folders by a bucket of the url. A level appends its new pages to it, and
    meets only the buckets its own pages fall into: the plan is the same at every depth, and a small frontier reads
    a small part of what was visited. Only the pages of the last level are expanded.
    """
    spark = seeds.sparkSession
    root = scratch_path(spark, "visited")
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
    schema = f"url {seeds.schema['url'].dataType.simpleString()}, depth int, bucket int"

    def visited() -> DataFrame:
        return spark.read.schema(schema).parquet(root)

    def add(pages: DataFrame) -> DataFrame:
        """Append a level; it is written once by itself first, as the append reads what is visited."""
        level = materialize(pages)
        level.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(root)
        return level

    frontier = add(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    more = repeat(hops[-1]) if repeat_last and hops else ()
    for depth, name in enumerate(chain(hops, more), start=1):
        step = links.filter(F.col("route") == name).select(
            F.col("src_url").alias("url"), "dst_url")
        reached = materialize(step.join(sized(frontier.select("url")), "url").select(F.col("dst_url").alias("url")).distinct()
                              .withColumn("bucket", bucket))
        touched = sorted(r["bucket"] for r in reached.select("bucket").distinct().collect())
        if not touched:
            break
        known = visited().filter(F.col("bucket").isin(touched)).select("url")
        frontier = add(reached.join(known, "url", "left_anti").select("url", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
    return visited().select("url", "depth")


def walk_next_pages(starts: DataFrame, next_links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Every page on the next-page chain of each start: (start, url, hop).

    `next_links(src_url, dst_url)` has one next page per page. The jumps double
    each round, so a chain of n pages takes log2(n) joins, and a chain that
    runs into itself ends when a round finds nothing new.
    """
    reach = starts.select(F.col("url").alias("start"), "url").distinct().withColumn(
        "hop", F.lit(0).cast("bigint"))
    jump = materialize(next_links.groupBy("src_url").agg(F.min("dst_url").alias("dst_url")))
    reach = materialize(reach)
    known = reach.count()
    for turn in range(max_rounds):
        ahead = (reach.join(jump, reach["url"] == jump["src_url"])
                 .select("start", F.col("dst_url").alias("url"),
                         (F.col("hop") + F.lit(2 ** turn).cast("bigint")).alias("hop")))
        reach = materialize(reach.unionByName(ahead)
                            .groupBy("start", "url").agg(F.min("hop").alias("hop")))
        now = reach.count()
        if now == known:
            return reach
        known = now
        far = jump.select(F.col("src_url").alias("dst_url"), F.col("dst_url").alias("far_url"))
        jump = materialize(jump.join(far, "dst_url").select("src_url", F.col("far_url").alias("dst_url")))
    raise RuntimeError(f"chains still grow after {max_rounds} rounds")
