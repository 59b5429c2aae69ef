"""Link expressions: ids, fingerprints, hosts and relative links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.analysis import bind

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
ORIGIN = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*"
PATH_OF = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
HOST_OF = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def url_id(url: Column) -> Column:
    """Record id of a page."""
    return F.md5(url)


def fingerprint(url: Column) -> Column:
    """Key of a request in the set of seen pages."""
    return F.sha1(url)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST_OF, 1))


def is_http(url: Column) -> Column:
    return url.startswith("http")


def in_domains(url: Column, domains: Sequence[str]) -> Column:
    """True when the host is one of the domains or lies below one of them."""
    name = host(url)
    allowed = F.lit(False)
    for domain in domains:
        allowed = allowed | (name == domain) | name.endswith("." + domain)
    return allowed


def host_suffixes(url: Column) -> Column:
    """`a.b.c` -> [a.b.c, b.c, c], the join keys for a table of domains."""
    return bind(F.split(host(url), r"\."), lambda labels: F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def _fold_dots(segments: Column) -> Column:
    """Path text of a list of segments with `.` and `..` worked off."""
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))))
    ends_open = F.element_at(segments, -1).isin(".", "..")
    text = F.array_join(F.when(ends_open, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(text.startswith("/"), text).otherwise(F.concat(F.lit("/"), text))


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute form of `href` as found on the page `base`.

    Stays in the JVM for every case; the segment walk runs only for links that
    are relative to the page's folder or contain dot segments.
    """
    origin = F.regexp_extract(base, ORIGIN, 0)
    base_path = F.regexp_extract(base, PATH_OF, 1)
    path = F.regexp_extract(href, r"^[^?#]*", 0)
    tail = F.substr(href, F.length(path) + 1)

    folder = F.split(base_path, "/")
    folder = F.when(F.element_at(folder, -1) == "", folder).otherwise(
        F.slice(folder, 1, F.size(folder) - 1))
    merged = F.concat(folder, F.split(path, "/"))
    # empty segments inside a merged path fall away, the outer two stay
    merged = F.concat(
        F.slice(merged, 1, 1),
        F.filter(F.slice(merged, 2, F.greatest(F.size(merged) - 2, F.lit(0))), lambda s: s != ""),
        F.slice(merged, -1, 1))
    has_dots = path.rlike(r"(^|/)\.\.?(/|$)")

    return (F.when(href == "", base)
            .when(href.rlike(SCHEME), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(base, SCHEME, 0), href))
            .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), href))
            .when(href.startswith("?"), F.concat(origin, base_path, href))
            .when(href.startswith("/") & ~has_dots, F.concat(origin, href))
            .when(href.startswith("/"), F.concat(origin, _fold_dots(F.split(path, "/")), tail))
            .otherwise(F.concat(origin, _fold_dots(merged), tail)))


def route(url: Column, rules: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """Name of the first rule whose pattern the URL matches."""
    result = None
    for pattern, name in rules:
        hit = url.rlike(pattern)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return F.lit(other) if result is None else result.otherwise(other)
