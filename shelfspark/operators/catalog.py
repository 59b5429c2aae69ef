"""One catalogue over all sites, with suggestion words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.analysis import analyze, suggestion_words
from shelfspark.functions.times import ms_to_day
from shelfspark.operators.tables import union_all
from shelfspark.schemas import CATALOG, SOURCES


def gen_suggests(fields: Sequence[tuple[Column, int]], analyzer: str = "coarse",
                 dedup: bool = True) -> Column:
    """(text, weight) pairs -> array of (input words, weight).

    A word goes to the first field that has it; fields without words of their
    own are left out. `dedup=False` keeps a word in every field.
    """
    entries, used = [], None
    for value, weight in fields:
        words = suggestion_words(analyze(value, analyzer))
        own = words if used is None or not dedup else F.array_except(words, used)
        used = words if used is None else F.array_union(used, words)
        entries.append(F.struct(own.alias("input"), F.lit(weight).alias("weight")))
    return F.filter(F.array(*entries), lambda e: F.size(e["input"]) > 0)


def to_catalog(records: DataFrame, site: str, keep: Sequence[str] = ()) -> DataFrame:
    """Records of one site as catalogue rows."""
    spec = SOURCES[site]
    have = set(records.columns)
    renamed = {"description": "introduction"} if site == "ireadweek" else {}

    def source(name: str) -> Column:
        column = renamed.get(name, name)
        return F.col(column) if column in have else F.lit(None)

    columns = {
        "doc_id": F.col(spec.key),
        "site": F.lit(site),
        "crawl_date": ms_to_day(F.col("crawl_time")),
        "upload_date": ms_to_day(F.col("upload_time")) if "upload_time" in have else F.lit(None),
        "suggest": gen_suggests([(F.col(name), weight) for name, weight in spec.suggest_fields]),
    }
    return records.select(*keep, *[
        columns.get(f.name, source(f.name)).try_cast(f.dataType).alias(f.name) for f in CATALOG])


def catalog_union(tables: dict[str, DataFrame], keep: Sequence[str] = ()) -> DataFrame:
    """Catalogue over several sites; the site is a column."""
    return union_all([to_catalog(records, site, keep) for site, records in tables.items()])
