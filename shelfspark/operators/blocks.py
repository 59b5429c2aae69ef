"""Postings in blocks with their highest contribution, and a search that skips blocks by intervals of documents.

Documents are numbered in the order of the index, with gaps only where one has no word, and the numbers are cut into cells of equal
width, at most CELLS of them.  The postings of a word lie in blocks of at most BLOCK_ROWS neighbours.  A block keeps its first
and last number and its highest norm, in a small table of its own (`headers`); no block crosses a cell.

A search reads the headers of its words first.  They bound what any document of a cell can score.  The cells with the highest
bounds are scored until they hold twice as many documents of their weightiest word as the page is deep, which gives a floor; then only cells
that can reach it are read.  A deep page needs the floor of its own depth, not of a fixed number of postings per word.

Only blocks of asked words move, once and by cell.  They meet the queries where a cell's postings lie together, so that parts are added up by
document before they move again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import safe_page
from shelfspark.operators.index import SearchIndex, term_bucket
from shelfspark.operators.search import NO_LIMIT, PAGE_SIZE, SLACK, query_terms
from shelfspark.session import materialize, sized

BLOCK_ROWS = 128
# cells of the whole index at most, and documents of a cell at least
CELLS = 1 << 16
CELL_DOCS = 1 << 10
# cells that one task scores
TASK_CELLS = 2
# numbers of documents that begin with one row of offsets: a task of the index numbers its own from a multiple of this
NUMBER_BITS = 20
# documents that the first cells of a query should hold, as a multiple of its page's depth
FIRST_SHARE = 2


class BlockIndex(NamedTuple):
    """headers(term_bucket, field, term, cell, block, first, last, n, max_norm), blocks = the same key with their
    postings(doc_no, doc_id, norm), term_stats(field, term, df, idf, term_bucket), sizes(n_docs, cell_docs)."""

    headers: DataFrame
    blocks: DataFrame
    term_stats: DataFrame
    sizes: DataFrame


def write_blocks(index: SearchIndex, path: str, buckets: int = 64, block_rows: int = BLOCK_ROWS, cell_docs: int = CELL_DOCS) -> BlockIndex:
    """Cut the postings of an index into blocks and write them under `path`.

    The index's own numbers are moved together: what lies before a group of 2 ** NUMBER_BITS of them is one row.  Postings move
    once, to the range of their word and cell, where blocks are cut from each cell.  However frequent a word is, no task gathers more
    than a cell of it at once.
    """
    spark = index.postings.sparkSession
    high, low = F.shiftright("doc_no", NUMBER_BITS).alias("high"), F.col("doc_no").bitwiseAND((1 << NUMBER_BITS) - 1)
    ends = materialize(index.postings.groupBy(high).agg((F.max(low) + 1).alias("n")))
    before = Window.orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized(ends.select("high", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("offset")))
    n_docs = ends.agg(F.sum("n")).first()[0] or 0
    width = cell_docs
    while width * CELLS < n_docs:
        width *= 2
    spark.createDataFrame([(n_docs, width)], "n_docs bigint, cell_docs bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
    index.term_stats.select("field", "term", "df", "idf", term_bucket(F.col("term"), buckets).alias("term_bucket")) \
        .write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/term_stats")
    key = ["term_bucket", "field", "term", "cell"]
    rows = (index.postings.select("field", "term", "doc_id", "norm", high, low.alias("low")).join(offsets, "high")
            .select(term_bucket(F.col("term"), buckets).alias("term_bucket"), "field", "term", F.expr(f"(offset + low) DIV {width}").alias("cell"),
                    F.struct((F.col("offset") + F.col("low")).alias("doc_no"), "doc_id", "norm").alias("posting")))
    # groups lie whole in the ranges, so they are gathered without a further exchange
    cells = rows.repartitionByRange(*key).groupBy(*key).agg(F.sort_array(F.collect_list("posting")).alias("all"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / block_rows).cast("int")), lambda i: F.struct(
        i.cast("bigint").alias("block"), F.slice("all", i * block_rows + 1, block_rows).alias("postings")))
    (cells.select(*key, F.explode(cut).alias("b")).select(*key, "b.block", "b.postings")
     .select(*key, "block", "postings", F.get("postings", F.lit(0))["doc_no"].alias("first"),
             F.element_at("postings", -1)["doc_no"].alias("last"), F.size("postings").cast("bigint").alias("n"),
             F.array_max("postings.norm").alias("max_norm"))
     .sortWithinPartitions(*key, "block").write.mode("overwrite").option("compression", "zstd").partitionBy("term_bucket").parquet(f"{path}/blocks"))
    # the small columns by themselves, so that a search does not read row groups full of postings to skip them
    spark.read.parquet(f"{path}/blocks").drop("postings").write.mode("overwrite").option("compression", "zstd").partitionBy("term_bucket").parquet(f"{path}/headers")
    return read_blocks(spark, path)


def read_blocks(spark: SparkSession, path: str) -> BlockIndex:
    return BlockIndex(*[spark.read.parquet(f"{path}/{name}") for name in BlockIndex._fields])


def _sieve(cells: DataFrame, n_cells: int) -> DataFrame:
    """(query_id, sieve): a bit for each of the query's cells, 64 in a number; at most CELLS / 64 numbers a query."""
    some = cells.groupBy("query_id", F.expr("cell DIV 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(cell % 64 AS INT))")).alias("bits"))
    none = cells.select("query_id").distinct().select(
        "query_id", F.explode(F.sequence(F.lit(0), F.lit(n_cells // 64)).cast("array<bigint>")).alias("word"), F.lit(0).cast("bigint").alias("bits"))
    return (some.unionByName(none).groupBy("query_id", "word").agg(F.bit_or("bits").alias("bits"))
            .groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
            .select("query_id", F.col("words.bits").alias("sieve")))


def _scores(cells: DataFrame, terms: DataFrame, index: BlockIndex, fields: Sequence[str]) -> DataFrame:
    """(query_id, doc_id, score) of all documents in cells(query_id, cell).

    A block of an asked word moves once, to the task of its cell, and meets the queries there.
    """
    n_docs, cell_docs = index.sizes.select("n_docs", "cell_docs").first()
    n_cells = -(-n_docs // cell_docs)
    words = sized(terms.select("term_bucket", "field", "term").distinct())
    sieve = sized(_sieve(cells, n_cells))
    met = (index.blocks.select("term_bucket", "field", "term", "cell", "postings").join(words, ["term_bucket", "field", "term"], "left_semi")
           .join(sized(cells.select("cell").distinct()), "cell", "left_semi")
           .repartition(max(1, n_cells // TASK_CELLS), "cell")
           .join(terms, ["term_bucket", "field", "term"]).join(sieve, "query_id"))
    bit = F.expr("shiftright(get(sieve, CAST(cell DIV 64 AS INT)), CAST(cell % 64 AS INT)) & 1L")
    parts = (met.filter(bit == 1).select("query_id", "field", "weight", F.explode("postings").alias("p"))
             .select("query_id", "field", "p.doc_id", (F.col("weight") * F.col("p.norm")).alias("part")))
    sums = [F.sum(F.when(F.col("field") == f, F.col("part"))) for f in fields]
    best = F.greatest(*sums) if len(sums) > 1 else sums[0]
    return parts.groupBy("query_id", "doc_id").agg(F.round(best, 6).alias("score"))


class Plan(NamedTuple):
    """What a search reads: cells(query_id, cell) of its first and second step, and bounds(query_id, cell, bound, n) of all.

    floors(query_id, floor): the score that the last document of the page reaches at least, where the first step found so many.
    """

    terms: DataFrame
    bounds: DataFrame
    first: DataFrame
    second: DataFrame
    scored: DataFrame
    floors: DataFrame


def plan(queries: DataFrame, index: BlockIndex, fields: Sequence[str], depths: DataFrame, analyzer: str = "fine") -> Plan:
    """The cells that can hold one of the first `depth` documents of depths(query_id, depth), and the scores of the first of them."""
    terms = sized(query_terms(queries, fields, analyzer).join(index.term_stats, ["field", "term"])
                  .select("query_id", "term_bucket", "field", "term", (F.col("qtf") * F.col("idf")).alias("weight")))
    # of a word's blocks in a cell the highest, before the queries that ask for the word; of a field the sum over words, of a document the best field
    key = ["term_bucket", "field", "term"]
    words = sized(terms.select(*key).distinct())
    heads = (index.headers.join(words, key, "left_semi").groupBy(*key, "cell").agg(F.max("max_norm").alias("max_norm"), F.sum("n").alias("n")))
    per_word = heads.join(terms, key).select("query_id", "field", "cell", (F.col("max_norm") * F.col("weight")).alias("bound"), "n")
    # n = documents of the cell that hold the word which counts most there
    bounds = materialize(per_word.groupBy("query_id", "field", "cell").agg(F.sum("bound").alias("bound"), F.max_by("n", "bound").alias("n"))
                         .groupBy("query_id", "cell").agg(F.max(F.struct("bound", "n")).alias("best"))
                         .select("query_id", "cell", "best.bound", "best.n"))
    # at most CELLS rows of a query: cells until they hold enough such documents
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(bounds.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).join(depths, "query_id")
                        .filter(F.col("before") / FIRST_SHARE < F.col("depth")).select("query_id", "cell", "depth"))
    scored = materialize(_scores(first.select("query_id", "cell"), terms, index, fields))
    # the depth-th best score so far, by counting scores from the top; a query with fewer documents has no floor
    steps = scored.groupBy("query_id", "score").agg(F.count(F.lit(1)).alias("n"))
    rising = Window.partitionBy("query_id").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    floors = sized(steps.withColumn("n", F.sum("n").over(rising)).join(depths, "query_id").filter(F.col("n") >= F.col("depth"))
              .groupBy("query_id").agg(F.max("score").alias("floor")))
    second = materialize(bounds.join(first, ["query_id", "cell"], "left_anti").join(floors, "query_id", "left")
                         .filter(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - SLACK).select("query_id", "cell"))
    return Plan(terms, bounds, first, second, scored, floors)


def search_blocks(queries: DataFrame, index: BlockIndex, fields: Sequence[str], size: int = PAGE_SIZE, analyzer: str = "fine") -> DataFrame:
    """One page of hits per query of queries(query_id, text[, page]): (query_id, page, rank, doc_id, score), as `search` ranks them."""
    asked = safe_page(F.col("page").cast("string")) if "page" in queries.columns else F.lit(1)
    page = F.greatest(asked, F.lit(1)).cast("bigint")
    depths = materialize(queries.select("query_id", page.alias("page"), F.coalesce(
        F.try_multiply(page, F.lit(size).cast("bigint")), F.lit(NO_LIMIT)).alias("depth")))
    made = plan(queries, index, fields, depths.select("query_id", "depth"), analyzer)
    # what lies below the floor has a page's depth of documents before it
    floored = (rows.join(made.floors, "query_id", "left").filter(F.col("score") >= F.coalesce("floor", F.col("score"))).select("query_id", "doc_id", "score")
               for rows in (made.scored, _scores(made.second, made.terms, index, fields)))
    scored = materialize(reduce(DataFrame.unionByName, floored))
    grouped = depths.withColumn("group", F.length(F.col("page").cast("string")))
    deepest = {r["group"]: r["deepest"] for r in grouped.groupBy("group").agg(F.max("depth").alias("deepest")).collect()}
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = []
    for group, limit in sorted(deepest.items()) or [(1, size)]:
        own = grouped.filter(F.col("group") == group)
        # the fixed limit lets Spark cut each query's rows before they are shuffled
        ranked.append(scored.join(sized(own.select("query_id")), "query_id", "left_semi").withColumn("rank", F.row_number().over(place))
                      .filter(F.col("rank") <= limit).join(own, "query_id")
                      .filter((F.col("rank") > F.col("depth") - size) & (F.col("rank") <= F.col("depth")))
                      .select("query_id", F.col("page").cast("int").alias("page"), "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, ranked)
