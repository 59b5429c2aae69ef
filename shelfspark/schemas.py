"""Record tables, their rules, and the registry of collected sites."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

SUGGEST = T.ArrayType(T.StructType([
    T.StructField("input", T.ArrayType(T.StringType())),
    T.StructField("weight", T.IntegerType()),
]))

CATALOG = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("source_website", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("load_num", T.IntegerType()),
    T.StructField("read_num", T.IntegerType()),
    T.StructField("crawl_date", T.DateType()),
    T.StructField("upload_date", T.DateType()),
    T.StructField("suggest", SUGGEST),
])


@dataclass(frozen=True)
class ColumnRule:
    """One table column: type, whether null is allowed, default, text limit.

    The default fills a column the input does not have; `max_chars` is checked,
    never cut.
    """

    name: str
    dtype: str
    nullable: bool = True
    default: str | None = None
    max_chars: int | None = None


def _text(name: str, chars: int, nullable: bool = True, default: str | None = None) -> ColumnRule:
    return ColumnRule(name, "string", nullable, default, chars)


def _millis(name: str) -> ColumnRule:
    return ColumnRule(name, "bigint", False, "0")


# Fixed table definitions.
T_ISHARE = (
    _text("url_obj_id", 100, nullable=False),
    _text("title", 255, False, ""),
    _text("upload_people", 255, True, ""),
    ColumnRule("score", "decimal(2,1)", False, "0"),
    ColumnRule("load_num", "int", False, "0"),
    ColumnRule("read_num", "int", True, "0"),
    ColumnRule("comment_num", "int", True, "0"),
    ColumnRule("collect_num", "int", True, "0"),
    _millis("upload_time"),
    _millis("crawl_time"),
    _text("url", 255, False, ""),
    _text("source_website", 255, True, ""),
    _text("type", 5, False, "0"),
    ColumnRule("size", "decimal(5,2)", True, "0.00"),
)
T_PIPIPAN = (
    _text("url_obj_id", 100, nullable=False),
    _text("title", 255, False, ""),
    ColumnRule("read_num", "int", True, "0"),
    _millis("upload_time"),
    _millis("crawl_time"),
    _text("url", 255, False, ""),
    _text("source_website", 255, True, ""),
    _text("type", 5, False, "0"),
    _text("size", 20, False, "0.00"),
    _text("tag", 255, False, ""),
    ColumnRule("description", "string"),
)
T_MEBOOK = (
    _text("url_obj_id", 100, nullable=False),
    _text("title", 255, False, ""),
    _millis("upload_time"),
    _millis("crawl_time"),
    _text("url", 255, False, ""),
    _text("source_website", 255, True, ""),
    _text("type", 255, False, "0"),
    ColumnRule("description", "string"),
    _text("tag", 255, False, ""),
    _text("size", 20, True, "0.00"),
)
XICI_IP = (
    _text("ip", 50, nullable=False),
    _text("port", 10, nullable=False),
    _text("type", 10, True, "http"),
    ColumnRule("speed", "double", True, "0"),
    _millis("live_time"),
)
# This site has no table; its documents go to the catalogue only.
IREADWEEK = (
    _text("url_obj_id", 100, nullable=False),
    ColumnRule("title", "string"),
    ColumnRule("author", "string"),
    ColumnRule("category", "string"),
    ColumnRule("download_url", "string"),
    ColumnRule("introduction", "string"),
    ColumnRule("url", "string"),
    ColumnRule("source_website", "string"),
    _millis("crawl_time"),
)


@dataclass(frozen=True)
class FieldSpec:
    """A field cut from a page.

    `take` is `text` (direct text nodes), `all_text` (text of the whole
    element), `html` (its markup) or `attr:<name>`; `column_fn` turns the array
    of hits into the field's column.
    """

    name: str
    selector: str
    take: str = "text"
    column_fn: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class SourceSpec:
    """All a site needs: table rules, fields, merge columns, suggestions."""

    site: str
    domain: str
    rules: tuple[ColumnRule, ...]
    key: str
    update_cols: tuple[str, ...] = ()
    fields: tuple[FieldSpec, ...] = ()
    suggest_fields: tuple[tuple[str, int], ...] = (("title", 10),)
    routes: tuple[tuple[str, str], ...] = field(default=())
    # text of error pages: a page that holds it is no record
    lacking: tuple[str, ...] = ()


# Fixed page markers.
NOT_FOUND = "未找到"
BANNER = "education-banner"

# Detail tables of the second site sit at fixed positions under the container.
_PANEL = "#main-container > div > div > div > div:nth(2)"
_FACTS = _PANEL + " > div:nth(2) > div > div"

SOURCES: dict[str, SourceSpec] = {
    spec.site: spec for spec in (
        SourceSpec(
            site="ishare",
            domain="ishare.iask.sina.com.cn",
            rules=T_ISHARE,
            key="url_obj_id",
            update_cols=("title", "load_num", "score", "read_num", "comment_num",
                         "collect_num", "crawl_time", "type"),
            fields=(
                FieldSpec("title", ".detail-box h1"),
                FieldSpec("upload_people", ".detail-user-bar a"),
                FieldSpec("score", "#starScoreId"),
                FieldSpec("load_num", "#downNumId"),
                FieldSpec("comment_num", "#commentNumId"),
                FieldSpec("collect_num", "#collectNumId"),
                FieldSpec("read_num", "#readNumId"),
                FieldSpec("upload_time", "#swfPreview > div > div:nth(1) > div:nth(1) > span:nth(3)"),
            ),
            suggest_fields=(("title", 10), ("type", 7)),
            routes=((r".*iask.sina.com.cn/c/([0-9]+).html$", "category"),
                    (r".*cn/f/[a-zA-Z0-9]*.html$", "detail")),
            lacking=(BANNER,),
        ),
        SourceSpec(
            site="pipipan",
            domain="edu.pipipan.com",
            rules=T_PIPIPAN,
            key="url_obj_id",
            update_cols=("title", "read_num", "crawl_time", "tag"),
            fields=(
                FieldSpec("title", ".view_title h3"),
                FieldSpec("read_num", _FACTS + ":nth(6) > span"),
                FieldSpec("upload_time", _FACTS + ":nth(4) > span"),
                FieldSpec("type", ".item-red.clearfix .inline a"),
                FieldSpec("size", ".item-red.clearfix .pull-right"),
                FieldSpec("tag", _PANEL + " > div:nth(3) > div > div:nth(2) > span"),
                FieldSpec("description", "#resource_content", "html"),
            ),
            suggest_fields=(("title", 10), ("tag", 7)),
            lacking=(NOT_FOUND,),
        ),
        SourceSpec(
            site="mebook",
            domain="mebook.cc",
            rules=T_MEBOOK,
            key="url_obj_id",
            update_cols=("title", "crawl_time", "tag", "description"),
            fields=(
                FieldSpec("title", "#primary h1"),
                FieldSpec("upload_time", ".postinfo .left"),
                FieldSpec("description", "#content", "html"),
                FieldSpec("tag", ".postinfo .left a"),
            ),
            suggest_fields=(("title", 10), ("tag", 7)),
            routes=((r"category/[a-zA-Z]{1,}$", "list"),
                    (r"category/.+/page/[0-9]+", "list"),
                    (r"[0-9]+.html$", "detail")),
        ),
        SourceSpec(
            site="ireadweek",
            domain="www.ireadweek.com",
            rules=IREADWEEK,
            key="url_obj_id",
            fields=(
                FieldSpec("name", "div.hanghang-za-title", "all_text"),
                FieldSpec("download_url", "a.downloads", "attr:href"),
                FieldSpec("info", "div.hanghang-shu-content-font p", "all_text"),
            ),
        ),
        SourceSpec(
            site="xici",
            domain="www.xicidaili.com",
            rules=XICI_IP,
            key="ip",
            update_cols=("live_time",),
        ),
    )
}

DOC_SITES = ("ishare", "pipipan", "mebook", "ireadweek")
