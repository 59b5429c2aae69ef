"""Registered queries over single-value expressions and proxy rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import ordered_sets, text, times
from shelfspark.operators import extract, records
from shelfspark.operators.tables import accepted, conform, delete_by_key, upsert
from shelfspark.plans.inputs import NOW, case_of, sql_case_of, table
from shelfspark.schemas import SOURCES, XICI_IP, FieldSpec


def _str(column: str):
    return F.col(column).cast("string")


def _titles(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    name = F.col("p_name")
    if kind == "dot":
        title = case_of(F.col("p_size"), name, F.concat(name, F.lit(".pdf")),
                        F.concat(F.lit("."), "p_brand"), F.concat(name, F.lit(".v1.epub")),
                        F.concat(name, F.lit(".")))
    else:
        title = case_of(F.col("p_size"), F.concat(F.lit("《"), name, F.lit("》"), F.lower("p_type")),
                        F.concat(F.lit("《x》（"), "p_brand", F.lit("）epub+mobi")),
                        F.concat(name, F.lit(" pdf")),
                        F.concat(F.lit("《"), name, F.lit("》1pdf")))
    return table(spark, sf, "part").select("p_partkey", title.alias("title"))


DOT_TITLES = "WITH t AS (SELECT p_partkey, " + sql_case_of(
    "p_size", "p_name", "p_name || '.pdf'", "'.' || p_brand", "p_name || '.v1.epub'",
    "p_name || '.'") + " AS title FROM part) "
BRACKET_TITLES = "WITH t AS (SELECT p_partkey, " + sql_case_of(
    "p_size", "'《' || p_name || '》' || lower(p_type)", "'《x》（' || p_brand || '）epub+mobi'",
    "p_name || ' pdf'", "'《' || p_name || '》1pdf'") + " AS title FROM part) "


def ext_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return _titles(spark, sf, "dot").select("p_partkey", "title",
                                            text.ext_unknown(F.col("title")).alias("ext"))


def ext_none(spark: SparkSession, sf: str) -> DataFrame:
    return _titles(spark, sf, "dot").select("p_partkey", "title",
                                            text.ext_none(F.col("title")).alias("ext"))


def ext_bracket(spark: SparkSession, sf: str) -> DataFrame:
    return _titles(spark, sf, "bracket").select("p_partkey", "title",
                                                text.ext_bracket(F.col("title")).alias("ext"))


def clean_size(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("\r\n\t"), _str("p_size"), F.lit(" MB\t"))
    return table(spark, sf, "part").select("p_partkey", text.clean_size(raw).alias("size"))


def split_marker(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(case_of(F.col("p_size"), F.lit("作者："), F.lit("")), "p_brand")
    return table(spark, sf, "part").select(
        "p_partkey", text.text_after(label, "作者：").alias("author"),
        text.text_before(F.concat(_str("p_size"), F.lit(".5秒")), "秒").alias("seconds"))


def date_part(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    value = case_of(F.col("o_orderkey"), F.concat(day, F.lit("T00:00:00")), day, F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", times.date_part(value).alias("day"))


def safe_page(spark: SparkSession, sf: str) -> DataFrame:
    asked = case_of(F.col("event_id"), _str("user_id"), F.col("event_type"), F.lit(None).cast("string"),
                    F.concat(_str("user_id"), F.lit(".5")))
    return table(spark, sf, "events").select("event_id", text.safe_page(asked).alias("page"))


def coerce_counts(spark: SparkSession, sf: str) -> DataFrame:
    raw = case_of(F.col("event_id"), _str("user_id"), F.concat(F.lit(" "), _str("user_id"), F.lit(" ")),
                  F.col("event_type"), F.lit("99999999999"))
    return table(spark, sf, "events").select("event_id", text.to_count(raw).alias("n"))


def upload_time_relative(spark: SparkSession, sf: str) -> DataFrame:
    user, day = _str("user_id"), F.date_format("ts", "yyyy-M-d")
    shown = case_of(
        F.col("event_id"), F.concat(user, F.lit("小时前")), F.concat(F.lit("昨天"), F.date_format("ts", "H:mm")),
        F.concat(F.lit("前天"), F.date_format("ts", "HH:mm")), F.concat(user, F.lit("天前")),
        day, F.col("event_type"))
    return table(spark, sf, "events").select(
        "event_id", shown.alias("shown"), times.upload_time_ms(shown, NOW).alias("upload_time"))


def upload_time_cn(spark: SparkSession, sf: str) -> DataFrame:
    shown = case_of(
        F.col("o_orderkey"),
        F.concat(F.lit("发布 "), F.date_format("o_orderdate", "yyyy年M月d日"), F.lit(" 分类")),
        F.col("o_orderpriority"),
        F.concat(F.date_format("o_orderdate", "yyyy年MM月dd日"), F.lit(" 2000年1月1日")))
    return table(spark, sf, "orders").select(
        "o_orderkey", times.upload_time_cn(shown, NOW).alias("upload_time"))


def date_to_ms(spark: SparkSession, sf: str) -> DataFrame:
    shown = case_of(F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-M-d"), F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", times.date_to_ms(shown).alias("ms"))


def ms_to_date(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return table(spark, sf, "events").select(
        "event_id", times.ms_to_date(F.floor(ms / 1000)).alias("day"))


def duration_ms(spark: SparkSession, sf: str) -> DataFrame:
    user = _str("user_id")
    shown = case_of(F.col("event_id"), F.concat(user, F.lit("分钟")), F.concat(user, F.lit("小时")),
                    F.concat(user, F.lit("天")), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", times.duration_ms(shown).alias("ms"))


def _proxy_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as pages of a proxy list, cut into cells: twelve text nodes a row, and a speed text."""
    key, nation = F.col("s_suppkey"), _str("s_nationkey")
    protocol = case_of(F.col("s_nationkey"), F.lit("HTTP"), F.lit("HTTPS"), F.lit("socks"))
    lived = case_of(key, F.concat(nation, F.lit("分钟")), F.concat(nation, F.lit("小时")),
                    F.concat(nation, F.lit("天")), F.lit("?"))
    address = F.concat(F.lit("10."), F.floor(key / 65536).cast("string"), F.lit("."),
                       F.pmod(F.floor(key / 256), F.lit(256)).cast("string"), F.lit("."),
                       F.pmod(key, F.lit(256)).cast("string"))
    bar = case_of(key, F.concat(F.lit('<div title="'), _str("s_nationkey"), F.lit('.25秒" class="bar">')), F.lit('<div class="bar">'))
    parts = ['<table id="ip_list"><tr><th>ip</th></tr><tr class="odd"><td class="country"></td><td>', address, "</td><td>80", nation,
             "</td><TD>\n<a>", F.col("s_name"), "</a>\n</TD><td>high &amp; low</td><td>", protocol, "</td><td>\n", bar,
             "<div></div></div>\n</td><td>\n<div class='bar'><div></div></div>\n</td><td>", lived, "</td><td>17-01-01</td></tr></table>"]
    page = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    lists = table(spark, sf, "supplier").select("s_suppkey", page.alias("html"))
    hits = extract.extract_fields(lists, [FieldSpec("rows", "#ip_list tr", "html")], keep=["s_suppkey"])
    rows = extract.table_rows(hits, "rows", "td", keep=["s_suppkey"])
    return rows.select("s_suppkey", "cells", extract.row_attribute(F.col("row"), "title").alias("speed"))


PROXY_SQL = """
cells AS (SELECT s_suppkey,
    '10.' || (s_suppkey // 65536) || '.' || (s_suppkey // 256 % 256) || '.' || (s_suppkey % 256) AS ip,
    '80' || s_nationkey AS port,
    CASE s_nationkey % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'https' ELSE 'socks' END AS type,
    CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey || '.25' AS DOUBLE) ELSE 0.0 END AS speed,
    CASE s_suppkey % 4 WHEN 0 THEN CAST(s_nationkey AS BIGINT) * 60000
         WHEN 1 THEN CAST(s_nationkey AS BIGINT) * 3600000
         WHEN 2 THEN CAST(s_nationkey AS BIGINT) * 86400000 END AS live_time
    FROM supplier),
pool AS (SELECT ip, port, type, speed, live_time FROM cells WHERE live_time IS NOT NULL)"""


def _proxies(spark: SparkSession, sf: str) -> DataFrame:
    return records.proxy_records(_proxy_cells(spark, sf), keep=("s_suppkey",))


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(conform(_proxies(spark, sf), XICI_IP))


def proxy_pages(spark: SparkSession, sf: str) -> DataFrame:
    """What is cut from the pages of a proxy list: the number of cells and those read by position."""
    cell = F.col("cells")
    return _proxy_cells(spark, sf).select(
        "s_suppkey", F.size(cell).cast("bigint").alias("n_cells"), F.get(cell, F.lit(4)).alias("kind"),
        F.get(cell, F.lit(5)).alias("protocol"), F.get(cell, F.lit(10)).alias("lived"), "speed")


def proxy_seed(spark: SparkSession, sf: str) -> DataFrame:
    """The pool table as loaded: a row without a readable live time is refused."""
    return _pool(spark, sf)


def proxy_type(spark: SparkSession, sf: str) -> DataFrame:
    return _proxies(spark, sf).select("s_suppkey", "ip", "type", "speed", "live_time")


def proxy_url(spark: SparkSession, sf: str) -> DataFrame:
    return _pool(spark, sf).select(
        "ip", records.proxy_url(F.col("type"), F.col("ip"), F.col("port")).alias("proxy"))


def proxy_delete(spark: SparkSession, sf: str) -> DataFrame:
    """The pool without the proxies that failed: those of suppliers in debt."""
    failed = (_proxies(spark, sf).join(table(spark, sf, "supplier").filter("s_acctbal < 0"),
                                       "s_suppkey", "left_semi").select("ip"))
    return delete_by_key(_pool(spark, sf), failed, "ip")


def random_pick(spark: SparkSession, sf: str) -> DataFrame:
    return records.random_pick(_pool(spark, sf), "ip", seed="7").select("ip", "port", "type")


def upsert_proxy(spark: SparkSession, sf: str) -> DataFrame:
    """Events report a new live time for the proxy of their user, in event order."""
    reports = (table(spark, sf, "events")
               .select(F.col("user_id").alias("s_suppkey"), F.col("event_id").alias("seq"))
               .join(_proxies(spark, sf).select("s_suppkey", "ip"), "s_suppkey")
               .select("ip", F.lit("1").alias("port"), F.lit("none").alias("type"),
                       F.lit(9.0).alias("speed"), (F.col("seq") * 1000).alias("live_time"), "seq"))
    return upsert(_pool(spark, sf), reports, SOURCES["xici"])


def ordered_sets_query(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("p_name", " ")
    left = F.concat(words, F.array(F.lit("new")), words)
    right = F.array(F.lit("widget"), F.get(words, F.lit(0)), F.lower("p_type"), F.lit("widget"))

    def show(items):
        return F.array_join(items, ",")

    s = ordered_sets
    return table(spark, sf, "part").select(
        "p_partkey", show(s.ordered(left)).alias("members"),
        show(s.add(left, F.lower("p_type"))).alias("added"),
        show(s.discard(left, F.lit("new"))).alias("discarded"),
        show(s.union(left, right)).alias("joined"),
        show(s.intersection(left, right)).alias("shared"),
        show(s.difference(left, right)).alias("rest"),
        show(s.symmetric_difference(left, right)).alias("either"),
        s.is_subset(words, left).alias("words_inside"),
        s.is_superset(right, words).alias("covers_words"),
        s.is_proper_subset(words, left).alias("words_smaller"))


QUERIES = {
    "ext_unknown": ext_unknown,
    "ext_none": ext_none,
    "ext_bracket": ext_bracket,
    "clean_size": clean_size,
    "split_marker": split_marker,
    "date_part": date_part,
    "safe_page": safe_page,
    "coerce_counts": coerce_counts,
    "upload_time_relative": upload_time_relative,
    "upload_time_cn": upload_time_cn,
    "date_to_ms": date_to_ms,
    "ms_to_date": ms_to_date,
    "duration_ms": duration_ms,
    "proxy_pages": proxy_pages,
    "proxy_seed": proxy_seed,
    "proxy_type": proxy_type,
    "proxy_url": proxy_url,
    "proxy_delete": proxy_delete,
    "random_pick": random_pick,
    "upsert_proxy": upsert_proxy,
    "ordered_sets": ordered_sets_query,
}

_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_MINUS = "list_filter({0}, lambda x: NOT list_contains({1}, x))"

ORACLE = {
    "ext_unknown": DOT_TITLES + r"""SELECT p_partkey, title, CASE WHEN contains(title, '.')
        THEN regexp_extract(title, '^.*\.(.*)', 1) ELSE 'unknown' END AS ext FROM t""",
    "ext_none": DOT_TITLES + r"""SELECT p_partkey, title, CASE WHEN regexp_matches(title, '^.+\..+')
        THEN regexp_extract(title, '^.+\.(.+)', 1) ELSE 'None' END AS ext FROM t""",
    "ext_bracket": BRACKET_TITLES + r"""SELECT p_partkey, title,
        CASE WHEN regexp_matches(title, '(》|）|\))[a-zA-Z]')
        THEN regexp_extract(title, '^.*(》|）|\))([a-zA-Z].*)', 2) ELSE 'unknown' END AS ext FROM t""",
    "clean_size": "SELECT p_partkey, p_size || ' MB' AS size FROM part",
    "split_marker": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand END AS author,
        p_size || '.5' AS seconds FROM part""",
    "date_part": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
    "safe_page": """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS INTEGER) ELSE 1 END AS page
        FROM events""",
    "coerce_counts": """SELECT event_id, CASE WHEN event_id % 4 <= 1 THEN CAST(user_id AS INTEGER) END AS n
        FROM events""",
    "upload_time_relative": f"""
        WITH e AS (SELECT event_id, {sql_case_of(
            "event_id", "user_id || '小时前'", "'昨天' || strftime(ts, '%-H:%M')",
            "'前天' || strftime(ts, '%H:%M')", "user_id || '天前'", "strftime(ts, '%Y-%-m-%-d')",
            "event_type")} AS shown, user_id, hour(ts) * 3600000 + minute(ts) * 60000 AS clock, ts FROM events)
        SELECT event_id, shown, CAST({sql_case_of(
            "event_id", f"{NOW} - user_id * 3600000", f"{NOW} - 12 * 3600000 - 86400000 + clock",
            f"{NOW} - 12 * 3600000 - 2 * 86400000 + clock", f"{NOW} - user_id * 86400000",
            "epoch_ms(date_trunc('day', ts))", f"{NOW}")} AS BIGINT) AS upload_time FROM e""",
    "upload_time_cn": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN {NOW}
        ELSE epoch_ms(date_trunc('day', o_orderdate)) END AS upload_time FROM orders""",
    "date_to_ms": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0
        THEN epoch_ms(date_trunc('day', o_orderdate)) END AS ms FROM orders""",
    "ms_to_date": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "duration_ms": f"""SELECT event_id, CAST({sql_case_of(
        "event_id", "user_id * 60000", "user_id * 3600000", "user_id * 86400000", "NULL")} AS BIGINT) AS ms
        FROM events""",
    "proxy_pages": """
        SELECT s_suppkey, CAST(12 AS BIGINT) AS n_cells, 'high & low' AS kind,
            CASE s_nationkey % 3 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'HTTPS' ELSE 'socks' END AS protocol,
            CASE s_suppkey % 4 WHEN 0 THEN s_nationkey || '分钟' WHEN 1 THEN s_nationkey || '小时'
                 WHEN 2 THEN s_nationkey || '天' ELSE '?' END AS lived,
            CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey || '.25秒' END AS speed
        FROM supplier""",
    "proxy_seed": f"WITH {PROXY_SQL} SELECT * FROM pool",
    "proxy_type": f"WITH {PROXY_SQL} SELECT s_suppkey, ip, type, speed, live_time FROM cells",
    "proxy_url": f"WITH {PROXY_SQL} SELECT ip, type || '://' || ip || ':' || port AS proxy FROM pool",
    "proxy_delete": f"""WITH {PROXY_SQL} SELECT * FROM pool WHERE ip NOT IN (
        SELECT ip FROM cells JOIN supplier USING (s_suppkey) WHERE s_acctbal < 0)""",
    "random_pick": f"WITH {PROXY_SQL} SELECT ip, port, type FROM pool ORDER BY md5(ip || '7'), ip LIMIT 1",
    "upsert_proxy": f"""WITH {PROXY_SQL},
        r AS (SELECT ip, max(event_id) * 1000 AS live_time FROM events JOIN cells ON s_suppkey = user_id
              GROUP BY ip)
        SELECT coalesce(pool.ip, r.ip) AS ip, coalesce(port, '1') AS port, coalesce(type, 'none') AS type,
               coalesce(speed, 9.0) AS speed, coalesce(r.live_time, pool.live_time) AS live_time
        FROM pool FULL JOIN r ON pool.ip = r.ip""",
    "ordered_sets": f"""
        WITH w AS (SELECT p_partkey, lower(p_type) AS kind, string_split(p_name, ' ') AS words FROM part),
        s AS (SELECT p_partkey, kind, words, list_concat(list_concat(words, ['new']), words) AS a0,
                     ['widget', words[1], kind, 'widget'] AS b0 FROM w),
        t AS (SELECT p_partkey, kind, words, {_DISTINCT.format('a0')} AS a, {_DISTINCT.format('b0')} AS b FROM s),
        u AS (SELECT *, {_MINUS.format('a', 'b')} AS ab, {_MINUS.format('b', 'a')} AS ba FROM t)
        SELECT p_partkey, array_to_string(a, ',') AS members,
               array_to_string(CASE WHEN list_contains(a, kind) THEN a ELSE list_append(a, kind) END, ',') AS added,
               array_to_string(list_filter(a, lambda x: x <> 'new'), ',') AS discarded,
               array_to_string(list_concat(a, ba), ',') AS joined,
               coalesce(array_to_string(list_filter(a, lambda x: list_contains(b, x)), ','), '') AS shared,
               coalesce(array_to_string(ab, ','), '') AS rest,
               coalesce(array_to_string(list_concat(ab, ba), ','), '') AS either,
               true AS words_inside, list_has_all(b, words) AS covers_words,
               len({_DISTINCT.format('words')}) < len(a) AS words_smaller
        FROM u""",
}
