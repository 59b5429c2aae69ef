"""Typed records per site, and proxy rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import text, times, urls
from shelfspark.schemas import SOURCES

# Fixed labels.
DOWNLOAD_LABEL = "下载地址"
AUTHOR_LABEL = "作者："
CATEGORY_LABEL = "分类："
SECONDS = "秒"


def _first(name: str) -> Column:
    return text.take_first(F.col(name))


def _common(site: str, now: Column | int) -> dict[str, Column]:
    """Columns every record has: id, address, site and one crawl time per batch."""
    return {
        "url_obj_id": urls.url_id(F.col("url")),
        "url": F.col("url"),
        "source_website": F.lit(SOURCES[site].domain),
        "crawl_time": times.as_millis(now),
    }


def _select(hits: DataFrame, site: str, columns: dict[str, Column], keep: tuple[str, ...]) -> DataFrame:
    order = [r.name for r in SOURCES[site].rules if r.name in columns]
    return hits.select(*keep, *[columns[name].alias(name) for name in order])


def build_ishare(hits: DataFrame, now: Column | int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Shared-documents site. A missing upload time becomes the table default.

    Counters are the page's text; the table's rules read them, and name those that are no number.
    """
    columns = _common("ishare", now) | {
        "title": _first("title"),
        "upload_people": _first("upload_people"),
        "score": F.lit(0).cast("decimal(2,1)"),
        **{c: _first(c)
           for c in ("load_num", "read_num", "comment_num", "collect_num")},
        "upload_time": F.coalesce(times.date_to_ms(_first("upload_time")),
                                  F.lit(0).cast("bigint")),
        "type": text.ext_none(_first("title")),
    }
    return _select(hits, "ishare", columns, keep)


def build_pipipan(hits: DataFrame, now: Column | int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cloud-drive site; an empty description is stored as null."""
    columns = _common("pipipan", now) | {
        "title": _first("title"),
        "read_num": _first("read_num"),
        "upload_time": times.upload_time_ms(F.get("upload_time", F.lit(0)), now),
        "type": text.take_first(text.map_hits(F.col("type"), text.ext_unknown)),
        "size": text.take_first(text.map_hits(F.col("size"), text.clean_size)),
        "tag": text.join_hits(F.col("tag")),
        "description": text.take_first(text.map_hits(F.col("description"), text.strip_tags)),
    }
    return _select(hits, "pipipan", columns, keep)


def build_mebook(hits: DataFrame, now: Column | int, keep: tuple[str, ...] = (),
                 required: str = DOWNLOAD_LABEL) -> DataFrame:
    """Book-blog site; only pages whose text holds the download label."""
    columns = _common("mebook", now) | {
        "title": _first("title"),
        "upload_time": times.upload_time_cn(text.join_hits(F.col("upload_time")), now),
        "type": text.ext_bracket(_first("title")),
        "description": text.strip_tags(F.coalesce(F.get("description", F.lit(0)), F.lit(""))),
        "tag": _first("tag"),
    }
    records = _select(hits, "mebook", columns, keep)
    return records.filter(F.col("description").contains(required))


def build_ireadweek(hits: DataFrame, now: Column | int, keep: tuple[str, ...] = (),
                    author_label: str = AUTHOR_LABEL,
                    category_label: str = CATEGORY_LABEL) -> DataFrame:
    """Reading site: facts sit in the n-th paragraph behind a label."""
    info = F.col("info")
    columns = _common("ireadweek", now) | {
        "title": F.get("name", F.lit(0)),
        "author": text.text_after(F.get(info, F.lit(0)), author_label),
        "category": text.text_after(F.get(info, F.lit(1)), category_label),
        "download_url": F.get("download_url", F.lit(0)),
        "introduction": F.get(info, F.lit(4)),
    }
    return _select(hits, "ireadweek", columns, keep)


BUILDERS = {
    "ishare": build_ishare,
    "pipipan": build_pipipan,
    "mebook": build_mebook,
    "ireadweek": build_ireadweek,
}


def proxy_type(cells: Column, position: int = 5) -> Column:
    """`https` or `http` when a cell says so, else the protocol cell as it is."""
    return (F.when(F.array_contains(cells, "HTTPS"), F.lit("https"))
            .when(F.array_contains(cells, "HTTP"), F.lit("http"))
            .otherwise(F.get(cells, F.lit(position))))


def proxy_speed(title: Column) -> Column:
    """Seconds in a speed text, 0.0 when the text is missing or empty."""
    seconds = text.text_before(title, SECONDS).try_cast("double")
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit(0.0)).otherwise(seconds)


def proxy_records(rows: DataFrame, cells: str = "cells", speed: str = "speed",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells of a proxy list row -> (ip, port, type, speed, live_time)."""
    cell = F.col(cells)
    return rows.select(
        *keep,
        F.get(cell, F.lit(0)).alias("ip"),
        F.get(cell, F.lit(1)).alias("port"),
        proxy_type(cell).alias("type"),
        proxy_speed(F.col(speed)).alias("speed"),
        times.duration_ms(F.get(cell, F.lit(10))).alias("live_time"))


def proxy_url(kind: Column, ip: Column, port: Column) -> Column:
    return F.concat(kind, F.lit("://"), ip, F.lit(":"), port)


def random_pick(df: DataFrame, key: str, seed: str, k: int = 1) -> DataFrame:
    """k rows in a random but repeatable order: the smallest hashes of key and seed."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    return df.orderBy(order, key).limit(k)
