"""Registered queries over keyword scores, histories and the running jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import urls
from shelfspark.operators import ranking
from shelfspark.operators.extract import extract_links
from shelfspark.operators.tables import current_table
from shelfspark.plans.inputs import NOW, SEARCH_LOG_SQL, search_log, table
from shelfspark.plans.page_plans import LINKS_SQL
from shelfspark.plans.record_plans import ACCEPTED_ISHARE, SITE_SQL, site_pages
from shelfspark.schemas import PAGES, SOURCES
from shelfspark.session import scratch_path
from shelfspark.sources.pages import stream_table
from shelfspark.streaming import jobs


def _finish(query) -> None:
    """Wait for a stream to end; a failed one raises here."""
    query.awaitTermination()


def keyword_scores(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.keyword_scores(search_log(spark, sf))


def hot_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.hot_keywords(keyword_scores(spark, sf))


def recent_searches(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.recent_searches(search_log(spark, sf)).select(
        "user_id", "keyword", F.col("rank").cast("bigint").alias("rank"))


def first_seen_history(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.first_seen_history(search_log(spark, sf)).select("user_id", "keyword", "rank")


def stream_hot_keywords(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "scores")
    events = stream_table(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)
    log = events.select(F.get_json_object("props", "$.k").alias("keyword"))
    _finish(jobs.start_keyword_scores(log, root))
    return ranking.hot_keywords(jobs.read_keyword_scores(spark, root))


def stream_new_links(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "links")
    pages = stream_table(spark, f"{sf}/pages.parquet", PAGES)
    links = extract_links(pages).select(urls.resolve_link(F.col("url"), F.col("href")).alias("url"))
    _finish(jobs.start_new_links(links, root))
    return jobs.read_new_links(spark, root)


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    root, spec = scratch_path(spark, "ingest"), SOURCES["ishare"]
    pages = site_pages(stream_table(spark, f"{sf}/pages.parquet", PAGES), spec.site)
    _finish(jobs.start_ingest(pages, spec, root, NOW))
    return current_table(spark, root, spec).select(
        "url_obj_id", "title", "upload_people", "load_num", "read_num", "comment_num", "upload_time", "type")


QUERIES = {
    "keyword_scores": keyword_scores,
    "hot_keywords": hot_keywords,
    "recent_searches": recent_searches,
    "first_seen_history": first_seen_history,
    "stream_hot_keywords": stream_hot_keywords,
    "stream_new_links": stream_new_links,
    "stream_ingest": stream_ingest,
}

_SCORES = f"""WITH {SEARCH_LOG_SQL}
    SELECT keyword, count(*) * 5 AS score FROM log GROUP BY keyword"""
_HOT = f"{_SCORES} ORDER BY score DESC, keyword DESC LIMIT 5"

ORACLE = {
    "keyword_scores": _SCORES,
    "hot_keywords": _HOT,
    "recent_searches": f"""WITH {SEARCH_LOG_SQL},
        s AS (SELECT user_id, keyword, max(ts) AS last_ts FROM log WHERE length(keyword) >= 2
              GROUP BY user_id, keyword)
        SELECT user_id, keyword, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, keyword) AS rank
        FROM s QUALIFY rank <= 5""",
    "first_seen_history": f"""WITH {SEARCH_LOG_SQL},
        s AS (SELECT user_id, keyword, min(ts) AS first_ts FROM log GROUP BY user_id, keyword)
        SELECT user_id, keyword, row_number() OVER (PARTITION BY user_id ORDER BY first_ts, keyword) AS rank
        FROM s""",
    "stream_hot_keywords": _HOT,
    "stream_new_links": f"WITH {LINKS_SQL} SELECT DISTINCT link AS url, sha1(link) AS fingerprint FROM l",
    "stream_ingest": f"""WITH {SITE_SQL["ishare"]}
        SELECT url_obj_id, title, upload_people, load_num, read_num, comment_num, upload_time, type
        FROM ishare WHERE {ACCEPTED_ISHARE}""",
}
