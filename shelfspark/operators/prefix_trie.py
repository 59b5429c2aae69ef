"""Completions as a trie in a table: every prefix with its best documents, built from the longest prefixes up.

The node of a prefix is made of its words and of the nodes one character longer, each of which holds `size` documents
already.  So the node of a single letter gathers a few rows for each second letter, not all words that begin with it.  A typed text
is one lookup of a unique key.  Nodes reach DEPTH characters; a longer text is looked up among the words below the
node of its first DEPTH characters.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.operators.suggest import SIZE, Completions, near_prefixes
from shelfspark.session import materialize, sized

DEPTH = 16


class PrefixTrie(NamedTuple):
    """nodes(length, prefix, place, weight, title, doc_id): the `size` best of each prefix; words are those of the completions."""

    nodes: DataFrame
    words: DataFrame
    size: int
    depth: int


def _order() -> list[Column]:
    return [F.desc("weight"), F.asc("title"), F.asc("doc_id")]


def _best(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, place, weight, title, doc_id): each document once, with its highest weight; Spark cuts each key to `size` rows in every task first."""
    once = rows.groupBy(key, "doc_id", "title").agg(F.max("weight").alias("weight"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*_order()))
    return once.withColumn("place", place).filter(F.col("place") <= size)


def build_trie(completed: Completions, path: str, depth: int = DEPTH) -> PrefixTrie:
    """Write the trie of all prefixes of all words under `path`, a folder for each length of prefixes."""
    words = completed.words.filter(F.length("word") > 0)
    spark = words.sparkSession
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    top = min(longest, depth)
    below = None
    for n in range(top, 0, -1):
        # words that end here, and at the deepest level all that go on
        ending = F.length("word") >= n if n == top else F.length("word") == n
        own = words.filter(ending).select(F.substring("word", 1, n).alias("prefix"), "doc_id", "title", "weight")
        rows = own if below is None else own.unionByName(
            below.select(F.substring("prefix", 1, n).alias("prefix"), "doc_id", "title", "weight"))
        _best(rows, "prefix", completed.size).write.mode("overwrite").parquet(f"{path}/length={n}")
        below = spark.read.parquet(f"{path}/length={n}")
    return read_trie(spark, path, completed, top)


def read_trie(spark: SparkSession, path: str, completed: Completions, depth: int) -> PrefixTrie:
    if depth == 0:
        nodes = completed.words.limit(0).select(F.col("word").alias("prefix"), F.lit(0).alias("place"), "weight", "title", "doc_id", F.lit(0).alias("length"))
    else:
        nodes = spark.read.parquet(path)
    return PrefixTrie(nodes, completed.words, completed.size, depth)


def _longer(texts: DataFrame, trie: PrefixTrie) -> DataFrame:
    """(prefix, place, weight, title, doc_id) of texts longer than the trie is deep, from the words they begin."""
    start = F.substring(F.col("word"), 1, trie.depth)
    below = trie.words.filter(F.length("word") > trie.depth).withColumn("start", start)
    asked = texts.select("text", F.substring("text", 1, trie.depth).alias("start"))
    found = below.join(sized(asked), "start").filter(F.col("word").startswith(F.col("text")))
    return _best(found.select(F.col("text").alias("prefix"), "doc_id", "title", "weight"), "prefix", trie.size)


def complete(queries: DataFrame, trie: PrefixTrie, size: int = SIZE) -> DataFrame:
    """(query_id, rank, doc_id, title, weight) for queries(query_id, text): one node per distinct text."""
    typed = queries.select("query_id", F.lower("text").alias("text"))
    texts = materialize(typed.filter(F.length("text") > 0).select("text").distinct())
    short = texts.filter(F.length("text") <= trie.depth)
    columns = ["text", "place", "weight", "title", "doc_id"]
    found = short.join(trie.nodes.withColumnRenamed("prefix", "text"), "text").select(columns)
    if not texts.filter(F.length("text") > trie.depth).isEmpty():
        found = found.unionByName(_longer(texts.filter(F.length("text") > trie.depth), trie).withColumnRenamed("prefix", "text").select(columns))
    return typed.join(found.filter(F.col("place") <= size), "text").select(
        "query_id", F.col("place").alias("rank"), "doc_id", "title", "weight")


def complete_near(queries: DataFrame, trie: PrefixTrie, size: int = SIZE) -> DataFrame:
    """(query_id, rank, doc_id, title, weight, distance): the best documents of all prefixes at most one typing error away.

    The trie's prefixes are met as they are; no word's prefixes are made anew.  A document outside the best of a near prefix has `size` documents before it
    there, so the nodes' lists are enough.  Texts reach one character beyond the trie's depth.
    """
    typed = queries.select("query_id", F.lower("text").alias("text"))
    texts = materialize(typed.filter((F.length("text") > 0) & (F.length("text") <= trie.depth + 1)).select("text").distinct())
    lengths = sorted({r[0] + d for r in texts.select(F.length("text")).distinct().collect() for d in (-1, 0, 1)})
    known = trie.nodes.filter(F.col("length").isin(lengths)).select("prefix").distinct()
    near = near_prefixes(texts, known)
    found = (near.join(trie.nodes, "prefix").groupBy("text", "doc_id", "title")
             .agg(F.max(F.struct("weight", (-F.col("distance")).alias("nearness"))).alias("best"))
             .select("text", "doc_id", "title", "best.weight", (-F.col("best.nearness")).alias("distance")))
    place = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("weight"), F.asc("distance"), F.asc("title"), F.asc("doc_id")))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= size)
    return typed.join(ranked, "text").select("query_id", "rank", "doc_id", "title", "weight", "distance")
