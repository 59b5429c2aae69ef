"""Registered queries over pages and links, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import text, urls
from shelfspark.operators import extract
from shelfspark.operators.links import clean_fingerprints, new_links, walk_frontier, walk_next_pages
from shelfspark.plans.inputs import links, pages, table
from shelfspark.schemas import SOURCES, FieldSpec

DOMAINS = ("example.com", "spam-farm.example.org")
HOPS = ("category", "subcategory", "list", "detail")
ROUTES = tuple(rule for spec in SOURCES.values() for rule in spec.routes)
# entities as a page reader takes them: a cut-off text may end without the semicolon
DECODE = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&copy;?', '©', 'g'),"
          " '&middot;?', '·', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')")


def scan_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


def strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", text.strip_tags(F.col("html")).alias("text"))


def filter_pages(spark: SparkSession, sf: str) -> DataFrame:
    return (pages(spark, sf)
            .filter(extract.containing("</html>") & extract.lacking("&quot;"))
            .select("page_id", "url"))


def extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    fields = [FieldSpec(name, name, column_fn=text.join_hits) for name in ("title", "h1", "footer")]
    return extract.extract_fields(pages(spark, sf), fields).select("page_id", "title", "h1", "footer")


def extract_blocks(spark: SparkSession, sf: str) -> DataFrame:
    hits = extract.extract_fields(pages(spark, sf), [FieldSpec("p", "article p", "all_text")])
    first = extract.block(F.col("p"), 0)
    return hits.select("page_id", F.size("p").cast("bigint").alias("n_blocks"),
                       first.alias("first_block"),
                       extract.block(F.col("p"), 4).alias("fifth_block"),
                       text.text_after(first, ", ").alias("after_marker"))


def extract_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    hits = extract.extract_fields(pages(spark, sf), [FieldSpec("rows", "ul li", "html")])
    rows = extract.table_rows(hits, "rows", "a", keep=["page_id"])
    return rows.select("page_id", F.col("row_no").cast("bigint").alias("row_no"),
                       F.get("cells", F.lit(0)).alias("cell"),
                       extract.row_attribute(F.col("row"), "href").alias("href"))


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", extract.tag_text(F.col("html"), "p").alias("hits"))


PARAGRAPHS_SQL = r"WITH h AS (SELECT page_id, regexp_extract_all(html, '<p(?:\s[^>]*)?>([^<]*)</p>', 1) AS hits FROM pages) "


def take_first(spark: SparkSession, sf: str) -> DataFrame:
    return _paragraphs(spark, sf).select("page_id", text.take_first(F.col("hits")).alias("hit"))


def join_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _paragraphs(spark, sf).select("page_id", text.join_hits(F.col("hits")).alias("joined"))


def map_hits(spark: SparkSession, sf: str) -> DataFrame:
    """First words of the paragraphs in lower case; `The` is dropped."""
    mapped = text.map_hits(
        F.col("hits"),
        lambda h: F.nullif(F.substring_index(h, " ", 1), F.lit("The")),
        F.lower)
    return _paragraphs(spark, sf).select("page_id", text.join_hits(mapped).alias("mapped"))


def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_links(pages(spark, sf)).select(
        "page_id", F.col("link_no").cast("bigint").alias("link_no"), "href")


def resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    return links(spark, sf).select("page_id", F.col("link_no").cast("bigint").alias("link_no"), "link")


def http_links(spark: SparkSession, sf: str) -> DataFrame:
    """Raw and resolved forms of each link; only the resolved ones have a scheme."""
    return (links(spark, sf).select("page_id", F.explode(F.array("href", "link")).alias("link"))
            .filter(urls.is_http(F.col("link"))))


def allowed_links(spark: SparkSession, sf: str) -> DataFrame:
    return links(spark, sf).filter(urls.in_domains(F.col("link"), DOMAINS)).select("page_id", "link")


def route_links(spark: SparkSession, sf: str) -> DataFrame:
    found = (pages(spark, sf).select("page_id", "url")
             .unionByName(links(spark, sf).select("page_id", F.col("link").alias("url"))))
    return found.select("page_id", "url", urls.route(F.col("url"), ROUTES).alias("route"))


def seen_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a seen file, with its line ends and some lines that are no fingerprint."""
    lines = pages(spark, sf).select(F.explode(F.array(
        F.concat(urls.fingerprint(F.col("url")), F.lit("\r\r")), "url", F.lit(""))).alias("value"))
    return clean_fingerprints(lines)


def new_links_query(spark: SparkSession, sf: str) -> DataFrame:
    """Links of this run; the run before had collected the pages served over http."""
    found = links(spark, sf).select(F.col("link").alias("url"))
    seen = found.filter(F.col("url").startswith("http://")).select(
        urls.fingerprint(F.col("url")).alias("fingerprint")).distinct()
    return new_links(found, seen)


def shop_links(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of the order tables as a site: regions lead to nations, and so on."""
    def edges(name: str, src: tuple[str, str], dst: tuple[str, str], route: str) -> DataFrame:
        def address(kind: str, column: str):
            return F.concat(F.lit(f"{kind}/"), F.col(column).cast("string"))
        return table(spark, sf, name).select(
            address(*src).alias("src_url"), address(*dst).alias("dst_url"),
            F.lit(route).alias("route"))
    return (edges("nation", ("r", "n_regionkey"), ("n", "n_nationkey"), HOPS[0])
            .unionByName(edges("customer", ("n", "c_nationkey"), ("c", "c_custkey"), HOPS[1]))
            .unionByName(edges("orders", ("c", "o_custkey"), ("o", "o_orderkey"), HOPS[2]))
            .unionByName(edges("lineitem", ("o", "l_orderkey"), ("p", "l_partkey"), HOPS[3])))


def walk_frontier_query(spark: SparkSession, sf: str) -> DataFrame:
    seeds = table(spark, sf, "region").select(
        F.concat(F.lit("r/"), F.col("r_regionkey").cast("string")).alias("url"))
    return walk_frontier(seeds, shop_links(spark, sf), HOPS)


def walk_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Orders lead to their first lines, and lines to the next ones: a route into itself, until nothing is new."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    order = F.col("l_orderkey").cast("string")

    def line(number):
        return F.concat(order, F.lit("/"), number.cast("string"))
    into = lines.filter("l_linenumber = 1").select(order.alias("src_url"), line(F.col("l_linenumber")).alias("dst_url"), F.lit("list").alias("route"))
    on = lines.select(line(F.col("l_linenumber") - 1).alias("src_url"), line(F.col("l_linenumber")).alias("dst_url"), F.lit("list").alias("route"))
    seeds = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("url"))
    return walk_frontier(seeds, into.unionByName(on), ["list"], repeat_last=True)


def walk_next_pages_query(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as list pages: line n leads to line n + 1."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()

    def address(number):
        return F.concat(F.col("l_orderkey").cast("string"), F.lit("/page/"), number.cast("string"))

    # (order, line) pairs are matched as a whole, so a long order is no hot key
    following = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"))
    steps = lines.join(following, ["l_orderkey", "l_linenumber"]).select(
        address(F.col("l_linenumber")).alias("src_url"),
        address(F.col("l_linenumber") + 1).alias("dst_url"))
    starts = lines.filter(F.col("l_linenumber") == 1).select(address(F.col("l_linenumber")).alias("url"))
    return walk_next_pages(starts, steps)


def url_ids(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", urls.url_id(F.col("url")).alias("url_obj_id"))


QUERIES = {
    "scan_pages": scan_pages,
    "strip_tags": strip_tags,
    "filter_pages": filter_pages,
    "extract_fields": extract_fields,
    "extract_blocks": extract_blocks,
    "extract_table_rows": extract_table_rows,
    "take_first": take_first,
    "join_hits": join_hits,
    "map_hits": map_hits,
    "extract_links": extract_links,
    "resolve_links": resolve_links,
    "http_links": http_links,
    "allowed_links": allowed_links,
    "route_links": route_links,
    "seen_fingerprints": seen_fingerprints,
    "new_links": new_links_query,
    "walk_frontier": walk_frontier_query,
    "walk_lists": walk_lists,
    "walk_next_pages": walk_next_pages_query,
    "url_ids": url_ids,
}

LINKS_SQL = r"""
raw AS (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages),
l AS (SELECT page_id, i - 1 AS link_no, hrefs[i] AS href,
             regexp_extract(url, '^[a-z]+://[^/?#]*') || hrefs[i] AS link
      FROM (SELECT page_id, url, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM raw))"""
_HOST = "regexp_extract({0}, '^[a-z]+://([^/?#:]*)', 1)"

ORACLE = {
    "scan_pages": "SELECT page_id, url, length(html) AS n_chars FROM pages",
    "strip_tags": r"SELECT page_id, regexp_replace(html, '(?s)<[a-zA-Z/!].*?>', '', 'g') AS text FROM pages",
    "filter_pages": "SELECT page_id, url FROM pages WHERE html LIKE '%</html>%' AND html NOT LIKE '%&quot;%'",
    "extract_fields": "SELECT page_id, " + ", ".join(
        DECODE.format(f"regexp_extract(html, '<{t}>([^<]*)</{t}>', 1)") + f" AS {t}"
        for t in ("title", "h1", "footer")) + " FROM pages",
    "extract_blocks": rf"""
        WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art FROM pages),
        b AS (SELECT page_id, string_split(art, '<p>')[2:] AS parts FROM a),
        c AS (SELECT page_id, list_transform(parts, lambda x: {DECODE.format(
            "regexp_replace(split_part(x, '</p>', 1), '(?s)<[a-zA-Z/!].*?>', '', 'g')")}) AS p FROM b)
        SELECT page_id, len(p) AS n_blocks, p[1] AS first_block, p[5] AS fifth_block,
               CASE WHEN contains(p[1], ', ') THEN split_part(p[1], ', ', 2) END AS after_marker FROM c""",
    "extract_table_rows": r"""
        WITH r AS (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1)[2:] AS body FROM pages),
        e AS (SELECT page_id, body, unnest(range(1, len(body) + 1)) AS i FROM r)
        SELECT page_id, i - 1 AS row_no, regexp_extract(body[i], '>([^<]+)<', 1) AS cell,
               regexp_extract(body[i], 'href="([^"]*)"', 1) AS href FROM e""",
    "take_first": PARAGRAPHS_SQL + "SELECT page_id, list_filter(hits, lambda x: x <> '')[1] AS hit FROM h",
    "join_hits": PARAGRAPHS_SQL + "SELECT page_id, coalesce(array_to_string(hits, ','), '') AS joined FROM h",
    "map_hits": PARAGRAPHS_SQL + """SELECT page_id, coalesce(array_to_string(list_transform(
        list_filter(hits, lambda x: split_part(x, ' ', 1) <> 'The'),
        lambda x: lower(split_part(x, ' ', 1))), ','), '') AS mapped FROM h""",
    "extract_links": f"WITH {LINKS_SQL} SELECT page_id, link_no, href FROM l",
    "resolve_links": f"WITH {LINKS_SQL} SELECT page_id, link_no, link FROM l",
    "http_links": f"""WITH {LINKS_SQL} SELECT page_id, link FROM (
        SELECT page_id, href AS link FROM l UNION ALL SELECT page_id, link FROM l)
        WHERE starts_with(link, 'http')""",
    "allowed_links": f"WITH {LINKS_SQL} SELECT page_id, link FROM l WHERE " + " OR ".join(
        f"{_HOST.format('link')} = '{d}' OR ends_with({_HOST.format('link')}, '.{d}')" for d in DOMAINS),
    "route_links": f"""WITH {LINKS_SQL}, u AS (
        SELECT page_id, url FROM pages UNION ALL SELECT page_id, link FROM l)
        SELECT page_id, url, CASE """ + " ".join(
        f"WHEN regexp_matches(url, '{p}') THEN '{n}'" for p, n in ROUTES) + """
        ELSE 'other' END AS route FROM u""",
    "seen_fingerprints": "SELECT DISTINCT sha1(url) AS fingerprint FROM pages",
    "new_links": f"""WITH {LINKS_SQL} SELECT DISTINCT sha1(link) AS fingerprint, link AS url FROM l
        WHERE NOT starts_with(link, 'http://')""",
    "walk_frontier": """
        WITH RECURSIVE e AS (
            SELECT 'r/' || n_regionkey AS src, 'n/' || n_nationkey AS dst, 1 AS hop FROM nation
            UNION SELECT 'n/' || c_nationkey, 'c/' || c_custkey, 2 FROM customer
            UNION SELECT 'c/' || o_custkey, 'o/' || o_orderkey, 3 FROM orders
            UNION SELECT 'o/' || l_orderkey, 'p/' || l_partkey, 4 FROM lineitem),
        w(url, depth) AS (
            SELECT 'r/' || r_regionkey, 0 FROM region
            UNION SELECT e.dst, e.hop FROM w JOIN e ON e.src = w.url AND e.hop = w.depth + 1)
        SELECT url, min(depth) AS depth FROM w GROUP BY url""",
    "walk_lists": """
        WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS i FROM lineitem),
        w(o, i) AS (
            SELECT o_orderkey, CAST(0 AS BIGINT) FROM orders
            UNION SELECT w.o, CAST(n.i AS BIGINT) FROM w JOIN n ON n.o = w.o AND n.i = w.i + 1)
        SELECT CASE WHEN i = 0 THEN CAST(o AS VARCHAR) ELSE o || '/' || i END AS url, CAST(i AS INTEGER) AS depth FROM w""",
    "walk_next_pages": """
        WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS i FROM lineitem),
        w(o, i, hop) AS (
            SELECT o, i, CAST(0 AS BIGINT) FROM n WHERE i = 1
            UNION SELECT w.o, n.i, w.hop + 1 FROM w JOIN n ON n.o = w.o AND n.i = w.i + 1)
        SELECT o || '/page/1' AS start, o || '/page/' || i AS url, hop FROM w""",
    "url_ids": "SELECT page_id, md5(url) AS url_obj_id FROM pages",
}
