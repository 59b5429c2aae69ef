"""Registered queries over request fingerprints and the set of seen requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.requests import IN_PATH, UNRESERVED, canonical_url, request_fingerprint
from shelfspark.operators import seen
from shelfspark.plans.inputs import case_of, links, sql_case_of
from shelfspark.plans.page_plans import LINKS_SQL
from shelfspark.session import scratch_path


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """The links of all pages as a crawler writes them: parameters in any order, escapes in any spelling, fragments."""
    at = F.col("link_no")
    tail = case_of(at, F.lit("?b=2&a=%7euser&c=x y"), F.lit("?c=x+y&a=~user&b=2#top"), F.lit("?q=%C3%A9t%c3%a9&&flag"),
                   F.lit("?flag=&q=été"), F.lit(""), F.lit("/%41b c/%2f?"))
    return links(spark, sf).select("page_id", "link_no", F.concat(F.regexp_replace("link", "[?#].*$", ""), tail).alias("url"))


def request_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical URL and fingerprint of every request."""
    return _requests(spark, sf).select("page_id", "link_no", canonical_url(F.col("url")).alias("canonical"),
                                       request_fingerprint(F.col("url")).alias("fingerprint"))


def new_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of all pages that none of two earlier runs made: one of the http sites, one of every third link."""
    root, found = scratch_path(spark, "seen"), _requests(spark, sf)
    for earlier in (found.filter(F.col("url").startswith("http://")), found.filter(F.col("link_no") % 3 == 1)):
        seen.append_seen(seen.distinct_requests(earlier).select("fingerprint"), root, buckets=8)
    return seen.new_requests(found, root)


QUERIES = {"request_fingerprints": request_fingerprints, "new_requests": new_requests}

_UNIT = r"'%[0-9A-Fa-f]{2}|(?s:.)'"
_ESCAPE = r"regexp_full_match(u, '%[0-9A-Fa-f]{2}')"
_PLAIN = "chr(CAST((strpos('0123456789ABCDEF', upper(u[2])) - 1) * 16 + strpos('0123456789ABCDEF', upper(u[3])) - 1 AS INTEGER))"
_BYTES = r"regexp_replace(hex(u), '(..)', '%\1', 'g')"
_PATH_SET = IN_PATH.replace("'", "''")


def _units_sql(text: str, cases: str) -> str:
    return f"coalesce(array_to_string(list_transform(regexp_extract_all({text}, {_UNIT}), lambda u: CASE {cases} END), ''), '')"


def _path_sql(path: str) -> str:
    return f"""CASE WHEN {path} = '' THEN '/' ELSE {_units_sql(path, f"""
        WHEN {_ESCAPE} THEN CASE WHEN upper(u[2:]) NOT IN ('2F', '3F') AND regexp_full_match({_PLAIN}, '{_PATH_SET}') THEN {_PLAIN} ELSE upper(u) END
        WHEN regexp_full_match(u, '{_PATH_SET}') THEN u ELSE {_BYTES}""")} END"""


def _spelled_sql(text: str) -> str:
    return _units_sql(text, f"""
        WHEN {_ESCAPE} THEN CASE WHEN upper(u[2:]) = '20' THEN '+' WHEN regexp_full_match({_PLAIN}, '{UNRESERVED}') THEN {_PLAIN} ELSE upper(u) END
        WHEN u IN (' ', '+') THEN '+' WHEN regexp_full_match(u, '{UNRESERVED}') THEN u ELSE {_BYTES}""")


def _order_sql(text: str) -> str:
    return _units_sql(text, f"WHEN {_ESCAPE} THEN upper(u[2:]) WHEN u = '+' THEN '20' ELSE hex(u)")


def _pair_sql() -> str:
    name, value = "regexp_extract(p, '^([^=]*)', 1)", "regexp_extract(p, '(?s)^[^=]*=?(.*)$', 1)"
    return f"{{'n': {_order_sql(name)}, 'v': {_order_sql(value)}, 't': {_spelled_sql(name)} || '=' || {_spelled_sql(value)}}}"


_REQUESTS_SQL = rf"""{LINKS_SQL},
asked0 AS (SELECT page_id, link_no, regexp_replace(link, '[?#].*$', '') || {sql_case_of(
    "link_no", "'?b=2&a=%7euser&c=x y'", "'?c=x+y&a=~user&b=2#top'", "'?q=%C3%A9t%c3%a9&&flag'", "'?flag=&q=été'", "''", "'/%41b c/%2f?'")} AS url FROM l),
cut AS (SELECT page_id, link_no, trim(url) AS url, regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://') AS whole,
    regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) AS scheme, regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host,
    regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1) AS query FROM asked0),
asked AS (SELECT *, coalesce(array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''),
    lambda p: {_pair_sql()})), lambda s: s.t), '&'), '') AS sorted_ FROM cut),
req AS (SELECT page_id, link_no, url, CASE WHEN whole THEN lower(scheme) || '://' || regexp_replace(lower(host), ':+$', '') || {_path_sql("path")}
    || CASE WHEN sorted_ = '' THEN '' ELSE '?' || sorted_ END ELSE url END AS canonical FROM asked)"""

ORACLE = {
    "request_fingerprints": f"WITH {_REQUESTS_SQL} SELECT page_id, link_no, canonical, sha1('GET' || canonical) AS fingerprint FROM req",
    "new_requests": f"""WITH {_REQUESTS_SQL},
        old AS (SELECT canonical FROM req WHERE starts_with(url, 'http://') OR link_no % 3 = 1)
        SELECT DISTINCT sha1('GET' || canonical) AS fingerprint, canonical AS url FROM req WHERE canonical NOT IN (SELECT canonical FROM old)""",
}
