"""Inputs of the registered queries, made from the given tables.

The texts a collected site would show (upload times, sizes, bracketed titles)
are put together from columns of the tables; the SQL beside each query does
the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import urls
from shelfspark.operators.extract import extract_links
from shelfspark.operators.index import SearchIndex, write_index
from shelfspark.session import scratch_path
from shelfspark.sources.pages import scan_pages

NOW = 1_706_788_800_000  # 2024-02-01 12:00:00 UTC

FIELDS = {"title": "fine", "tag": "fine", "description": "fine"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return scan_pages(spark, f"{sf}/pages.parquet")


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Every link of every page, resolved: (page_id, link_no, href, link)."""
    return extract_links(pages(spark, sf)).select(
        "page_id", "link_no", "href",
        urls.resolve_link(F.col("url"), F.col("href")).alias("link"))


def case_of(number: Column, *texts: Column) -> Column:
    """One of the texts, by the number's remainder: mixes all formats over a table."""
    picked = F.lit(None).cast("string")
    kind = F.pmod(number, F.lit(len(texts)))
    for at, value in enumerate(texts):
        picked = F.when(kind == at, value).otherwise(picked)
    return picked


def sql_case_of(number: str, *texts: str) -> str:
    whens = " ".join(f"WHEN {at} THEN {value}" for at, value in enumerate(texts))
    return f"CASE ({number}) % {len(texts)} {whens} END"


def book_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as books: the first sentence is the title, the text the description."""
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.regexp_extract(text, r"^[^.!?\n]*", 0).alias("title"),
        F.concat_ws(" ", "lang", "source").alias("tag"),
        text.alias("description"),
        F.concat(F.lit("http://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string"),
                 F.lit(".html")).alias("url"),
        F.col("source").alias("source_website"),
        F.concat(F.date_add(F.lit("2018-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int"))
                 .cast("string"), F.lit("T00:00:00")).alias("upload_time"))


BOOK_DOCS_SQL = r"""
d AS (SELECT doc_id, regexp_extract(text, '^[^.!?\n]*') AS title, lang || ' ' || source AS tag,
             text AS description, 'http://' || source || '.example.com/' || doc_id || '.html' AS url,
             source AS source_website,
             strftime(DATE '2018-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') || 'T00:00:00'
               AS upload_time
      FROM documents),
toks AS (SELECT doc_id, field, regexp_extract_all(lower(value), '[\p{L}\p{N}]+') AS tokens FROM (
           SELECT doc_id, 'title' AS field, title AS value FROM d
           UNION ALL SELECT doc_id, 'tag', tag FROM d
           UNION ALL SELECT doc_id, 'description', description FROM d)),
post AS (SELECT field, term, doc_id, count(*) AS tf, any_value(dl) AS dl
         FROM (SELECT field, doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM toks)
         GROUP BY field, term, doc_id),
fstat AS (SELECT field, count(*) AS n_docs, avg(len(tokens)) AS avg_dl FROM toks
          WHERE len(tokens) > 0 GROUP BY field),
tstat AS (SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf
          FROM post GROUP BY field, term)"""

_indexes: dict[tuple[str, str], SearchIndex] = {}


def book_index(spark: SparkSession, sf: str) -> SearchIndex:
    """The index over `book_docs`, written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = write_index(
            book_docs(spark, sf), FIELDS, scratch_path(spark, "index"),
            stored=["title", "tag", "url", "source_website", "upload_time"], buckets=8)
    return _indexes[key]


def search_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as searches: (user_id, keyword, ts)."""
    return table(spark, sf, "events").select(
        "user_id", F.get_json_object("props", "$.k").alias("keyword"),
        F.col("ts").cast("timestamp").alias("ts"))


SEARCH_LOG_SQL = """
log AS (SELECT user_id, json_extract_string(props, '$.k') AS keyword, ts FROM events)"""
