"""String expressions: file types, sizes, markers and selector hits."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns. (?d) makes the dot stop at line feeds only.
AFTER_LAST_DOT = r"(?d)^.*\.(.*)"
AFTER_INNER_DOT = r"(?d)^.+\.(.+)"
AFTER_BRACKET = r"(?d)^.*(》|）|\))([a-zA-Z].*)"
MARKUP_TAG = r"(?s)<[a-zA-Z/!].*?>"
WHOLE_NUMBER = r"^[+-]?[0-9]+$"


def _matched(value: Column, pattern: str, group: int, missing: str) -> Column:
    return (F.when(value.isNull(), F.lit(None).cast("string"))
            .when(value.rlike(pattern), F.regexp_extract(value, pattern, group))
            .otherwise(F.lit(missing)))


def ext_unknown(title: Column) -> Column:
    """Extension after the last dot, `unknown` without a dot."""
    return _matched(title, AFTER_LAST_DOT, 1, "unknown")


def ext_none(title: Column) -> Column:
    """Extension with text on both sides of the dot, else the word `None`."""
    return _matched(title, AFTER_INNER_DOT, 1, "None")


def ext_bracket(title: Column) -> Column:
    """Format named after a closing bracket, `unknown` if there is none."""
    return _matched(title, AFTER_BRACKET, 2, "unknown")


def clean_size(value: Column) -> Column:
    """Size text without carriage returns, line feeds and tabs."""
    return F.translate(value, "\r\n\t", "")


def strip_tags(html: Column) -> Column:
    """Text of a markup fragment; comments and tags go, entities stay."""
    return F.regexp_replace(html, MARKUP_TAG, "")


def text_after(value: Column, marker: str) -> Column:
    """Text between the first and the second marker, null without a marker."""
    return F.get(F.split(value, re.escape(marker)), F.lit(1))


def text_before(value: Column, marker: str) -> Column:
    """Text before the first marker, the whole text without one."""
    return F.substring_index(value, marker, 1)


def to_count(value: Column) -> Column:
    """A counter as int; null when the text is not a whole number."""
    text = F.trim(value)
    return F.when(text.rlike(WHOLE_NUMBER), text.try_cast("int"))


def safe_page(value: Column) -> Column:
    """Requested page number, 1 when it is missing or not a number."""
    return F.coalesce(to_count(value), F.lit(1))


def truncate(value: Column, length: int = 500) -> Column:
    return F.substring(value, 1, length)


def take_first(hits: Column) -> Column:
    """First hit that is neither null nor empty."""
    return F.get(F.filter(hits, lambda h: h.isNotNull() & (h != "")), F.lit(0))


def join_hits(hits: Column, separator: str = ",") -> Column:
    return F.array_join(hits, separator)


def map_hits(hits: Column, *steps: Callable[[Column], Column]) -> Column:
    """Apply column functions to every hit in turn, dropping null results."""
    for step in steps:
        hits = F.filter(F.transform(hits, step), lambda h: h.isNotNull())
    return hits
