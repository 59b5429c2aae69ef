"""Registered queries over whole records: build, conform, merge, fan out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import text, urls
from shelfspark.operators import keyed, tables
from shelfspark.operators.catalog import catalog_union, to_catalog
from shelfspark.operators.extract import site_fields
from shelfspark.operators.records import BUILDERS
from shelfspark.plans.inputs import NOW, case_of, pages, sql_case_of, table
from shelfspark.plans.page_plans import DECODE
from shelfspark.schemas import DOC_SITES, SOURCES, T_ISHARE
from shelfspark.session import scratch_path

DAY_TEXT = "yyyy-M-d"


def _str(column: str):
    return F.col(column).cast("string")


def site_pages(page_table: DataFrame, site: str) -> DataFrame:
    """The crawled pages inside the markup of a site's detail page.

    Heading, host, paragraphs and numbers come from the page itself, and its
    whole markup follows after the site's own elements.
    """
    html, number = F.col("html"), _str("page_id")
    heading = F.regexp_extract(html, "<h1>([^<]*)</h1>", 1)
    article = F.regexp_extract(html, "(?s)<article>(.*?)</article>", 1)
    day = F.date_add(F.lit("2018-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    link = F.regexp_extract(html, 'href="([^"]*)"', 1)
    parts = {
        "ishare": (
            '<div class="detail-box"><h1>', heading, case_of(F.col("page_id"), F.lit(".pdf"), F.lit(""),
                                                             F.lit(".v2.epub")),
            '</h1></div><div class="detail-user-bar"><a>', urls.host(F.col("url")), "</a></div>",
            '<i id="downNumId">', F.length(html).cast("string"), '</i><i id="readNumId"> ', number,
            '</i><i id="commentNumId">', case_of(F.col("page_id"), number, F.lit("many")),
            '</i><i id="collectNumId">0</i><div id="swfPreview"><div><div><div><span>a</span><span>b</span><span>',
            F.date_format(day, DAY_TEXT), "</span></div></div></div></div>",
            F.when(F.pmod("page_id", F.lit(11)) == 5, '<div class="education-banner">').otherwise("<div>"), "</div>"),
        "pipipan": (
            '<div class="view_title"><h3>', heading, '</h3></div><div class="item-red x clearfix">',
            '<div class="inline"><a>', heading, '.mobi</a></div><span class="pull-right">\n\t', number,
            ' KB\r\n</span></div><div id="main-container"><div><div><div><div>1</div><div><div>1</div>',
            "<div><div><div>1</div><div>2</div><div>3</div><div>4: <span>",
            case_of(F.col("page_id"), F.concat(number, F.lit("小时前")), F.concat(number, F.lit("天前")),
                    F.date_format(day, DAY_TEXT), F.lit("刚刚")),
            "</span></div><div>5</div><div>6: <span>", F.length(html).cast("string"),
            "</span></div></div></div><div><div><div>1</div><div>2: <span>book</span><span>",
            F.substring_index(urls.host(F.col("url")), ".", 1), "</span></div></div></div>",
            '</div></div></div></div></div><div id="resource_content">', article, "</div>",
            F.when(F.pmod("page_id", F.lit(7)) == 3, "<p>未找到</p>").otherwise("")),
        "mebook": (
            '<div id="primary"><h1>《', heading, "》epub</h1></div>",
            '<div class="postinfo"><div class="left">发布 ', F.date_format(day, "yyyy年M月d日"),
            " 分类 <a>novel</a><a>", F.substring_index(urls.host(F.col("url")), ".", 1),
            '</a></div></div><div id="content">', article,
            case_of(F.col("page_id"), F.lit("<p>下载地址</p>"), F.lit("<p>none</p>"), F.lit("下载地址")),
            "</div>"),
        "ireadweek": (
            '<div class="hanghang-za-title"><b>', heading, '</b></div><a class="downloads x" href="', link,
            '">get</a><div class="hanghang-shu-content-font"><p>作者：', urls.host(F.col("url")),
            "</p><p>分类：c", number, "</p><p>3</p><p>4</p><p>intro <i>", number, "</i></p></div>"),
    }[site]
    own = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return page_table.select("page_id", "url", F.concat(own, html).alias("html"))


def site_records(spark: SparkSession, sf: str, site: str) -> DataFrame:
    hits = site_fields(site_pages(pages(spark, sf), site), SOURCES[site])
    return BUILDERS[site](hits, NOW, keep=("page_id",))


def _plain(records: DataFrame) -> DataFrame:
    """Decimals as doubles, so both engines print them alike; counters as the table reads them."""
    def shown(name: str, kind: str):
        if kind.startswith("decimal"):
            return F.col(name).cast("double").alias(name)
        if name.endswith("_num") and kind == "string":
            return text.to_count(F.col(name)).alias(name)
        return F.col(name)
    return records.select(*[shown(name, kind) for name, kind in records.dtypes])


def _build(site: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _plain(site_records(spark, sf, site))
    query.__doc__ = f"Records of the pages of site {site}."
    return query


_H1 = DECODE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"
_NAME = f"split_part({_HOST}, '.', 1)"
_DAY = "(DATE '2018-01-01' + CAST(page_id % 365 AS INTEGER))"
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_ARTICLE_TEXT = f"regexp_replace({_ARTICLE}, '(?s)<[a-zA-Z/!].*?>', '', 'g')"


def _site_sql(site: str, columns: str, where: str = "") -> str:
    return (f"{site} AS (SELECT page_id, md5(url) AS url_obj_id, url, '{SOURCES[site].domain}' AS source_website, "
            f"CAST({NOW} AS BIGINT) AS crawl_time, {columns} FROM pages {where})")


SITE_SQL = {
    "ishare": _site_sql("ishare", f"""
        {_H1} || {sql_case_of("page_id", "'.pdf'", "''", "'.v2.epub'")} AS title, {_HOST} AS upload_people,
        CAST(0 AS DOUBLE) AS score, CAST(length(html) AS INTEGER) AS load_num,
        CAST(page_id AS INTEGER) AS read_num,
        CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS INTEGER) END AS comment_num,
        0 AS collect_num, epoch_ms(CAST({_DAY} AS TIMESTAMP)) AS upload_time,
        CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 2 THEN 'epub'
             WHEN regexp_matches({_H1}, '^.+\\..+') THEN regexp_extract({_H1}, '^.+\\.(.+)', 1)
             ELSE 'None' END AS type""", "WHERE page_id % 11 <> 5"),
    "pipipan": _site_sql("pipipan", f"""
        {_H1} AS title, CAST(length(html) AS INTEGER) AS read_num,
        CAST({sql_case_of("page_id", f"{NOW} - page_id * 3600000", f"{NOW} - page_id * 86400000",
                          f"epoch_ms(CAST({_DAY} AS TIMESTAMP))", f"{NOW}")} AS BIGINT) AS upload_time,
        'mobi' AS type, page_id || ' KB' AS size, 'book,' || {_NAME} AS tag,
        {_ARTICLE_TEXT} AS description""", "WHERE page_id % 7 <> 3"),
    "mebook": _site_sql("mebook", f"""
        '《' || {_H1} || '》epub' AS title, epoch_ms(CAST({_DAY} AS TIMESTAMP)) AS upload_time, 'epub' AS type,
        {_ARTICLE_TEXT} || '下载地址' AS description, 'novel' AS tag""",
        "WHERE page_id % 3 <> 1"),
    "ireadweek": _site_sql("ireadweek", f"""
        {_H1} AS title, {_HOST} AS author, 'c' || page_id AS category,
        regexp_extract(html, 'href="([^"]*)"', 1) AS download_url, 'intro ' || page_id AS introduction"""),
}


def catalog_union_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog_union({site: site_records(spark, sf, site) for site in DOC_SITES})
    words = F.array_join(F.transform(
        "suggest", lambda s: F.concat(F.array_join(s["input"], " "), F.lit(":"), s["weight"].cast("string"))), "|")
    return rows.select("doc_id", "site", "title", "url", "source_website", "type", "tag",
                       F.md5("description").alias("description_md5"), "load_num", "read_num",
                       _str("crawl_date").alias("crawl_date"), _str("upload_date").alias("upload_date"),
                       words.alias("suggest"))


def _catalog_sql() -> str:
    have = {
        "ishare": {"type": "type", "load_num": "load_num", "read_num": "read_num", "second": "type"},
        "pipipan": {"type": "type", "tag": "tag", "description": "description", "read_num": "read_num",
                    "second": "tag"},
        "mebook": {"type": "type", "tag": "tag", "description": "description", "second": "tag"},
        "ireadweek": {"description": "introduction"},
    }
    selects = []
    for site, cols in have.items():
        def col(name: str, kind: str = "VARCHAR", cols: dict = cols) -> str:
            return cols.get(name, f"CAST(NULL AS {kind})")
        day = ("CAST(NULL AS VARCHAR)" if site == "ireadweek"
               else "strftime(epoch_ms(upload_time), '%Y-%m-%d')")
        selects.append(f"""SELECT url_obj_id AS doc_id, '{site}' AS site, title, url, source_website,
            {col("type")} AS type, {col("tag")} AS tag, md5({col("description")}) AS description_md5,
            {col("load_num", "INTEGER")} AS load_num, {col("read_num", "INTEGER")} AS read_num,
            '2024-02-01' AS crawl_date, {day} AS upload_date, coalesce({col("second")}, '') AS second FROM {site}""")
    return f"""WITH {", ".join(SITE_SQL[s] for s in DOC_SITES)}, c AS ({" UNION ALL ".join(selects)}),
        t AS (SELECT *, {_WORDS.format("title")} AS a0, {_WORDS.format("second")} AS b0 FROM c),
        w AS (SELECT *, list_filter(a0, lambda x, i: list_position(a0, x) = i) AS a,
                     list_filter(b0, lambda x, i: list_position(b0, x) = i AND NOT list_contains(a0, x)) AS b FROM t)
        SELECT * EXCLUDE (second, a0, b0, a, b), array_to_string(list_filter([
            CASE WHEN len(a) > 0 THEN array_to_string(a, ' ') || ':10' END,
            CASE WHEN len(b) > 0 THEN array_to_string(b, ' ') || ':7' END], lambda x: x IS NOT NULL), '|') AS suggest
        FROM w"""


_WORDS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1)"


def conform_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as untyped records: some counters, types and titles break a rule."""
    number = F.col("doc_id")
    raw = table(spark, sf, "documents").select(
        F.when(F.col("lang") != "de", F.md5(number.cast("string"))).alias("url_obj_id"),
        F.regexp_extract("text", r"^[^\n]*", 0).alias("title"),
        case_of(number, _str("n_chars"), F.concat(F.lit(" "), _str("n_chars")), F.lit("x"),
                F.lit("7")).alias("load_num"),
        case_of(number, _str("n_chars"), F.lit(None).cast("string")).alias("read_num"),
        F.when(F.pmod(number, F.lit(7)) != 0, number).alias("upload_time"),
        case_of(number, F.lit("pdf"), F.lit("unknown"), F.lit("None")).alias("type"),
        F.lit("http://x").alias("url"),
        case_of(number, F.lit("1.25"), F.lit("12345.6"), F.lit("9")).alias("size"),
        F.col("doc_id"))
    return _plain(tables.conform(raw, T_ISHARE, keep=["doc_id"]))


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as versions of one record per user, in event order."""
    number = F.col("event_id")
    url = F.concat(F.lit("http://x/"), _str("user_id"))
    return table(spark, sf, "events").select(
        urls.url_id(url).alias("url_obj_id"), number.alias("seq"), F.col("event_type").alias("title"),
        F.when(F.col("value") < 10, F.floor("value").cast("int")).alias("n"),
        number.alias("crawl_time"), F.concat(url, F.lit("#"), number.cast("string")).alias("url"),
        F.get_json_object("props", "$.k").alias("tag"))


VERSIONS_SQL = """
v AS (SELECT md5('http://x/' || user_id) AS url_obj_id, event_id AS seq, event_type AS title,
             CASE WHEN value < 10 THEN CAST(floor(value) AS INTEGER) END AS n, event_id AS crawl_time,
             'http://x/' || user_id || '#' || event_id AS url,
             json_extract_string(props, '$.k') AS tag FROM events)"""


def _old_and_new(source: str) -> str:
    return f"""
newest AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY url_obj_id ORDER BY seq DESC) = 1),
oldest AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY url_obj_id ORDER BY seq) = 1)"""


def upsert_ishare(spark: SparkSession, sf: str) -> DataFrame:
    """New versions of the users' records, over a table with one row per customer."""
    def record(rows: DataFrame, *extra: str) -> DataFrame:
        zero = F.lit(0)
        return rows.select(
            "url_obj_id", "title", F.col("tag").alias("upload_people"), zero.cast("decimal(2,1)").alias("score"),
            F.coalesce("n", zero).alias("load_num"), F.col("n").alias("read_num"),
            zero.alias("comment_num"), zero.alias("collect_num"), F.col("crawl_time").alias("upload_time"),
            "crawl_time", "url", F.lit("site").alias("source_website"), F.lit("pdf").alias("type"), *extra)

    url = F.concat(F.lit("http://x/"), _str("c_custkey"))
    existing = table(spark, sf, "customer").select(
        urls.url_id(url).alias("url_obj_id"), F.col("c_name").alias("title"),
        F.col("c_nationkey").alias("n"), F.lit(-1).cast("bigint").alias("crawl_time"),
        url.alias("url"), F.col("c_mktsegment").alias("tag"))
    merged = tables.upsert(record(existing), record(_versions(spark, sf), "seq"), SOURCES["ishare"])
    return _plain(merged)


def upsert_pipipan(spark: SparkSession, sf: str) -> DataFrame:
    rows = _versions(spark, sf).select(
        "url_obj_id", "seq", "title", F.col("n").alias("read_num"), F.col("crawl_time").alias("upload_time"),
        "crawl_time", "url", F.lit("site").alias("source_website"), F.lit("pdf").alias("type"),
        F.concat(_str("crawl_time"), F.lit(" KB")).alias("size"), "tag", F.col("tag").alias("description"))
    return tables.upsert(None, rows, SOURCES["pipipan"])


def upsert_mebook(spark: SparkSession, sf: str) -> DataFrame:
    rows = _versions(spark, sf).select(
        "url_obj_id", "seq", "title", F.col("crawl_time").alias("upload_time"), "crawl_time", "url",
        F.lit("site").alias("source_website"), F.lit("pdf").alias("type"),
        F.when(F.col("n").isNotNull(), F.col("tag")).alias("description"), "tag")
    return tables.upsert(None, rows, SOURCES["mebook"])


def index_replace(spark: SparkSession, sf: str) -> DataFrame:
    documents = _versions(spark, sf).withColumnRenamed("url_obj_id", "doc_id")
    return tables.replace_by_id(documents)


def fanout_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per sink after the pages of a site went to index and table."""
    spec, root = SOURCES["ishare"], scratch_path(spark, "fanout")
    records = site_records(spark, sf, spec.site).withColumnRenamed("page_id", "seq").persist()
    tables.fan_out(records, to_catalog(records, spec.site, keep=("seq",)), spec, 0, root)
    records.unpersist()
    counts = [tables.read_sink(spark, root, spec, sink).agg(F.count(F.lit(1)).alias("n"))
              .select(F.lit(sink).alias("sink"), "n") for sink in ("index", "table", "rejects")]
    return tables.union_all(counts)


def compact_table(spark: SparkSession, sf: str) -> DataFrame:
    """The users' records after their versions came in four batches, compacted after two and read over two more."""
    rows = _versions(spark, sf).select(
        "url_obj_id", "seq", "title", F.col("n").alias("read_num"), F.col("crawl_time").alias("upload_time"),
        "crawl_time", "url", F.lit("site").alias("source_website"), F.lit("pdf").alias("type"),
        F.concat(_str("crawl_time"), F.lit(" KB")).alias("size"), "tag", F.col("tag").alias("description"))
    spec, root = SOURCES["pipipan"], scratch_path(spark, "keyed")
    sink = keyed.Sink("table", spec.key, keyed.upserted(spec), 8)
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    part = F.expr(f"(seq - {low or 0}) * 4 DIV {(high or 0) - (low or 0) + 1}")
    for batch in range(4):
        keyed.commit(spark, root, batch, {sink: rows.filter(part == batch)})
        if batch == 1:
            keyed.compact(spark, root, [sink])
    return keyed.read(spark, root, sink)


def fanout_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Index and table of a site after its pages came in three batches, each visible in both sinks at once."""
    spec, root = SOURCES["ishare"], scratch_path(spark, "fanout")
    sinks = keyed.site_sinks(spec, 8)
    records = site_records(spark, sf, spec.site).withColumnRenamed("page_id", "seq").persist()
    low, high = records.agg(F.min("seq"), F.max("seq")).first()
    part = F.expr(f"(seq - {low or 0}) * 3 DIV {(high or 0) - (low or 0) + 1}")
    for batch in range(3):
        some = records.filter(part == batch)
        rows = tables.sink_rows(some, to_catalog(some, spec.site, keep=("seq",)), spec)
        keyed.commit(spark, root, batch, {sink: rows[sink.name] for sink in sinks})
    records.unpersist()
    keyed.compact(spark, root, sinks)
    index, table_, rejects = (keyed.read(spark, root, sink) for sink in sinks)
    return tables.union_all([
        index.select(F.lit("index").alias("sink"), F.col("doc_id").alias("id"), "title"),
        table_.select(F.lit("table").alias("sink"), F.col("url_obj_id").alias("id"), "title"),
        rejects.select(F.lit("rejects").alias("sink"), F.col("url_obj_id").alias("id"), "title")])


QUERIES = {
    "conform_records": conform_records,
    **{f"build_{site}": _build(site) for site in DOC_SITES},
    "catalog_union": catalog_union_query,
    "upsert_ishare": upsert_ishare,
    "upsert_pipipan": upsert_pipipan,
    "upsert_mebook": upsert_mebook,
    "index_replace": index_replace,
    "fanout_counts": fanout_counts,
    "compact_table": compact_table,
    "fanout_manifest": fanout_manifest,
}

ACCEPTED_ISHARE = "length(title) <= 255 AND length(url) <= 255 AND length(type) <= 5 AND comment_num IS NOT NULL"

_PIPIPAN_SQL = f"""WITH {VERSIONS_SQL}, {_old_and_new("v")}
        SELECT url_obj_id, b.title, b.n AS read_num, a.crawl_time AS upload_time, b.crawl_time, a.url,
               'site' AS source_website, 'pdf' AS type, a.crawl_time || ' KB' AS size, b.tag,
               a.tag AS description FROM oldest a JOIN newest b USING (url_obj_id)"""

ORACLE = {
    "compact_table": _PIPIPAN_SQL,
    "fanout_manifest": f"""WITH {SITE_SQL["ishare"]}
        SELECT 'index' AS sink, url_obj_id AS id, arg_max_null(title, page_id) AS title FROM ishare GROUP BY url_obj_id UNION ALL
        SELECT 'table', url_obj_id, arg_max_null(title, page_id) FROM ishare WHERE {ACCEPTED_ISHARE} GROUP BY url_obj_id UNION ALL
        SELECT 'rejects', url_obj_id, title FROM ishare WHERE NOT ({ACCEPTED_ISHARE})""",
    "conform_records": r"""
        WITH r AS (SELECT doc_id, CASE WHEN lang <> 'de' THEN md5(CAST(doc_id AS VARCHAR)) END AS url_obj_id,
            regexp_extract(text, '^[^\n]*') AS title,
            CASE WHEN doc_id % 4 < 2 THEN CAST(n_chars AS INTEGER) WHEN doc_id % 4 = 3 THEN 7 END AS load_num,
            CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS INTEGER) END AS read_num,
            CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS upload_time,
            CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'unknown' ELSE 'None' END AS type,
            CASE doc_id % 3 WHEN 0 THEN 1.25 WHEN 2 THEN 9.0 END AS size FROM documents)
        SELECT doc_id, url_obj_id, title, '' AS upload_people, CAST(0 AS DOUBLE) AS score, load_num, read_num,
            0 AS comment_num, 0 AS collect_num, upload_time, CAST(0 AS BIGINT) AS crawl_time, 'http://x' AS url,
            '' AS source_website, type, CAST(size AS DOUBLE) AS size,
            nullif(concat_ws(';', CASE WHEN url_obj_id IS NULL THEN 'null:url_obj_id' END,
                CASE WHEN length(title) > 255 THEN 'long:title' END,
                CASE WHEN load_num IS NULL THEN 'type:load_num' END,
                CASE WHEN upload_time IS NULL THEN 'null:upload_time' END,
                CASE WHEN length(type) > 5 THEN 'long:type' END,
                CASE WHEN size IS NULL THEN 'type:size' END), '') AS reject FROM r""",
    **{f"build_{site}": f"WITH {SITE_SQL[site]} SELECT * FROM {site}" for site in DOC_SITES},
    "catalog_union": _catalog_sql(),
    "upsert_ishare": f"""WITH {VERSIONS_SQL}, vs AS (
            SELECT md5('http://x/' || c_custkey) AS url_obj_id, -1 AS seq, c_name AS title,
                   CAST(c_nationkey AS INTEGER) AS n, -1 AS crawl_time, 'http://x/' || c_custkey AS url,
                   c_mktsegment AS tag FROM customer UNION ALL SELECT * FROM v), {_old_and_new("vs")}
        SELECT url_obj_id, b.title, a.tag AS upload_people, CAST(0 AS DOUBLE) AS score,
               coalesce(b.n, 0) AS load_num, b.n AS read_num, 0 AS comment_num, 0 AS collect_num,
               a.crawl_time AS upload_time, b.crawl_time, a.url, 'site' AS source_website, 'pdf' AS type
        FROM oldest a JOIN newest b USING (url_obj_id)""",
    "upsert_pipipan": _PIPIPAN_SQL,
    "upsert_mebook": f"""WITH {VERSIONS_SQL}, {_old_and_new("v")}
        SELECT url_obj_id, b.title, a.crawl_time AS upload_time, b.crawl_time, a.url,
               'site' AS source_website, 'pdf' AS type,
               CASE WHEN b.n IS NOT NULL THEN b.tag END AS description, b.tag
        FROM oldest a JOIN newest b USING (url_obj_id)""",
    "index_replace": f"""WITH {VERSIONS_SQL}, {_old_and_new("v")}
        SELECT url_obj_id AS doc_id, title, n, crawl_time, url, tag FROM newest""",
    "fanout_counts": f"""WITH {SITE_SQL["ishare"]}
        SELECT 'index' AS sink, count(*) AS n FROM ishare UNION ALL
        SELECT 'table', count(*) FROM ishare WHERE {ACCEPTED_ISHARE} UNION ALL
        SELECT 'rejects', count(*) FROM ishare WHERE NOT ({ACCEPTED_ISHARE})""",
}
