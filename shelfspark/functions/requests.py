"""Canonical URLs and request fingerprints, as native expressions.

Two URLs that ask for the same page have one canonical form: scheme and host in lower case, parameters sorted by name and
value, escapes in one spelling, no fragment, a path at least.  The fingerprint of a request is the SHA-1 of its method, its canonical URL
and its body.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.analysis import bind

# Unreserved characters, and those that may also stand in a path.
UNRESERVED = r"[A-Za-z0-9._~-]"
IN_PATH = r"[A-Za-z0-9._~:/?\[\]@!$&'()*+,;=%-]"
# an escape, or any one character
UNIT = r"(?s)%[0-9A-Fa-f]{2}|."
ESCAPE = r"^%[0-9A-Fa-f]{2}$"
PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _escaped(text: Column) -> Column:
    """Every byte of a text as an escape."""
    return F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "%$1")


def _byte(escape: Column) -> Column:
    """The character of an escape below 0x80, else null."""
    code = F.conv(F.substring(escape, 2, 2), 16, 10).cast("int")
    return F.when(code < 128, F.chr(code))


def canonical_path(path: Column) -> Column:
    """A path with its escapes in one form; those of a slash or a question mark stay, as they part nothing."""
    def one(unit: Column) -> Column:
        plain = _byte(unit)
        keep = F.upper(F.substring(unit, 2, 2)).isin("2F", "3F")
        return (F.when(unit.rlike(ESCAPE), F.when(~keep & plain.rlike(f"^{IN_PATH}$"), plain).otherwise(F.upper(unit)))
                .when(unit.rlike(f"^{IN_PATH}$"), unit).otherwise(_escaped(unit)))
    return F.when(path == "", F.lit("/")).otherwise(F.array_join(F.transform(_units(path), one), ""))


def _spelled(text: Column) -> Column:
    """A parameter's name or value, decoded and encoded anew: a space is a plus sign."""
    def one(unit: Column) -> Column:
        plain = _byte(unit)
        return (F.when(unit.rlike(ESCAPE), F.when(plain == " ", F.lit("+")).when(plain.rlike(f"^{UNRESERVED}$"), plain).otherwise(F.upper(unit)))
                .when(unit.isin(" ", "+"), F.lit("+")).when(unit.rlike(f"^{UNRESERVED}$"), unit).otherwise(_escaped(unit)))
    return F.array_join(F.transform(_units(text), one), "")


def _order(text: Column) -> Column:
    """The bytes of a decoded name or value, as hexadecimal digits: they sort as the bytes do."""
    def one(unit: Column) -> Column:
        return (F.when(unit.rlike(ESCAPE), F.upper(F.substring(unit, 2, 2))).when(unit == "+", F.lit("20"))
                .otherwise(F.hex(F.encode(unit, "UTF-8"))))
    return F.array_join(F.transform(_units(text), one), "")


def canonical_query(query: Column) -> Column:
    """Parameters sorted by name and value, each with an equals sign; empty ones between two `&` are left out."""
    def one(pair: Column) -> Column:
        name = F.regexp_extract(pair, "(?s)^([^=]*)", 1)
        value = F.regexp_extract(pair, "(?s)^[^=]*=?(.*)$", 1)
        return F.struct(_order(name).alias("n"), _order(value).alias("v"), F.concat(_spelled(name), F.lit("="), _spelled(value)).alias("text"))
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.array_join(F.transform(F.sort_array(F.transform(pairs, one)), lambda s: s["text"]), "&")


def canonical_url(url: Column) -> Column:
    """The canonical form of an absolute URL; a text that is none is only trimmed."""
    text = F.trim(url)

    def built(parts: Column) -> Column:
        query = F.substring(parts[3], 2, 1 << 30)
        return F.concat(
            F.lower(parts[0]), F.lit("://"), F.regexp_replace(F.lower(parts[1]), ":+$", ""), canonical_path(parts[2]),
            F.when(canonical_query(query) == "", F.lit("")).otherwise(F.concat(F.lit("?"), canonical_query(query))))
    parts = F.array(*[F.regexp_extract(text, PARTS, at) for at in range(1, 5)])
    return F.when(text.rlike(PARTS), bind(parts, built)).otherwise(text)


def request_fingerprint(url: Column, method: Column | None = None, body: Column | None = None) -> Column:
    """SHA-1 over method, canonical URL and body, as 40 hexadecimal digits."""
    verb = F.lit("GET") if method is None else F.upper(method)
    content = F.lit("") if body is None else F.coalesce(body.cast("string"), F.lit(""))
    return F.sha1(F.concat(verb, canonical_url(url), content))
