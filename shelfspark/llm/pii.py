"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

DataFrame functions only.  A pattern's matches and the gaps between them give the
places: a span starts where all gaps and matches before it end.  These sums are taken by a
window over a document's spans, so a text with very many spans costs no more than its
length.  The patterns are written so that Java's matcher neither recurses nor starts again
inside a run of characters, whatever the length of the text: separators inside a number
or a host name are first replaced by one control character of the same length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import text_or_empty

CONTEXT_CHARS = 40
ACCEPTED = 50
_JOIN = "\x01"

# Lengths of account numbers by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
                "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """A kind of span: where to look for it, its pattern, its score and the words near it that change the score."""
    name: str
    might_hold: str
    pattern: str
    score: int
    near: str
    against: str = r"(?i)version|example|isbn|order"
    base: bool = True
    # what is replaced by the control character before the pattern is used
    joins: str | None = None


KINDS = (
    Kind("email", "@", rf"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++",
         90, r"(?i)mail|contact|write to", joins=r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"),
    Kind("ip", r"[0-9]\.[0-9]+\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         60, r"(?i)address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9][0-9\x01]+",
         80, r"(?i)card|credit|visa|payment|paid", joins=r"(?<=[0-9])[\x20-](?=[0-9])"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]",
         60, r"(?i)phone|call|mobile|tel|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}",
         r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
         90, r"(?i)iban|account|bank", base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         30, r"(?i)ssn|social security|tax id", base=False),
)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    def value(i):
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(i % 2 == 1, F.when(double > 9, double - 9).otherwise(double)).otherwise(digit)
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, value), F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(text: Column) -> Column:
    """Remainder by 97 of letters and digits, A read as 10 and so on."""
    def step(total, i):
        c = F.ascii(F.substring(text, i, F.lit(1)))
        return F.when(c >= 65, (total * 100 + c - 55) % 97).otherwise((total * 10 + c - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def _proposals(kind: Kind, text: Column) -> Column:
    """An array of the kind's matches in a text, each with the length of the gap before it and its surroundings."""
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,span:string,before:string,after:string>>")
    # a control character of the text itself is no separator
    read = F.regexp_replace(F.translate(text, _JOIN, "\x02"), kind.joins, _JOIN) if kind.joins else text
    held = F.struct(F.regexp_extract_all(read, F.lit(kind.pattern), F.lit(0)).alias("spans"),
                    F.split(read, kind.pattern, -1).alias("gaps"))

    def each(h):
        gap = lambda i: F.get(h["gaps"], i)
        return F.transform(h["spans"], lambda span, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(gap(i)).alias("gap"), span.alias("span"),
            F.right(gap(i), F.lit(CONTEXT_CHARS)).alias("before"), F.left(gap(i + 1), F.lit(CONTEXT_CHARS)).alias("after")))
    found = F.get(F.transform(F.array(held), each), F.lit(0))
    return F.when(text.rlike(kind.might_hold), found).otherwise(empty)


def _valid(name: str) -> Column:
    span, before, after = F.col("span"), F.col("before"), F.col("after")
    if name == "ip":
        return span.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if name == "card":
        digits = F.translate(span, _JOIN, "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if name == "phone":
        return F.length(F.translate(span, "+ ().-", "")).between(9, 15)
    if name == "iban":
        compact = F.translate(span, " ", "")
        lengths = F.lit(None).cast("int")
        for country, length in IBAN_LENGTHS.items():
            lengths = F.when(F.substring(compact, 1, 2) == country, F.lit(length)).otherwise(lengths)
        moved = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
        return F.when(F.length(compact) == lengths, mod97(moved) == 1).otherwise(F.lit(False))
    if name == "ssn":
        return ~(before.rlike("[0-9-]$") | after.rlike("^[0-9-]") | span.rlike("^(?:000|666|9)"))
    return F.lit(True)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, kind, start, end, score): valid spans, and one row with null kind for a row without any.

    start and end count code points, end exclusive.  A kind's spans are leftmost and do not
    overlap each other; those that fail their check are dropped, and nothing is searched inside
    them.  The score is the kind's, 20 higher with one of its words within CONTEXT_CHARS before or
    after, 30 lower with a word against it.  Spans of the base kinds always stay, others from
    ACCEPTED on.  Null texts are empty.
    """
    text = F.col("text")
    slim = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"),
                       text_or_empty(text_col).alias("text"))
    rows = slim.select("row_id", "doc_id", F.explode_outer(F.concat(*[_proposals(k, text) for k in KINDS])).alias("p")) \
        .select("row_id", "doc_id", "p.*")
    upto = Window.partitionBy("row_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.withColumn("end", F.sum(F.col("gap") + F.length("span")).over(upto))
              .withColumn("start", F.col("end") - F.length("span")))
    by_kind = lambda f, last: _by_kind(f, last)
    valid = by_kind(lambda k: _valid(k.name), F.lit(True))
    score = by_kind(lambda k: F.lit(k.score)
                    + F.when(F.col("before").rlike(k.near) | F.col("after").rlike(k.near), 20).otherwise(0)
                    - F.when(F.col("before").rlike(k.against) | F.col("after").rlike(k.against), 30).otherwise(0), F.lit(None))
    base = F.col("kind").isin([i for i, k in enumerate(KINDS) if k.base])
    judged = placed.withColumn("valid", valid).withColumn("score", F.least(F.greatest(score, F.lit(0)), F.lit(100)))
    keep = F.col("valid") & (base | (F.col("score") >= ACCEPTED))
    # a row stays for each document even if all its proposals fail
    return judged.select("row_id", "doc_id", *[F.when(F.coalesce(keep, F.lit(False)), F.col(c)).alias(c)
                                               for c in ("kind", "start", "end", "score")])


def _by_kind(made, last: Column) -> Column:
    out = last
    for i, k in enumerate(KINDS):
        out = F.when(F.col("kind") == i, made(k)).otherwise(out)
    return out


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: counts of the base kinds, base_sha256, spans and their scores."""
    spans = find_spans(docs, id_col, text_col)
    n = lambda name: F.count(F.when(F.col("kind") == [k.name for k in KINDS].index(name), 1)).alias(f"n_{name}")
    # one document's spans
    packed = spans.groupBy("row_id", "doc_id").agg(
        *[n(k.name) for k in KINDS if k.base],
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end", "score")))).alias("found"))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    text = lambda found: F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    in_base = F.filter("found", lambda s: s["kind"] < sum(k.base for k in KINDS))
    return packed.select("doc_id", *[f"n_{k.name}" for k in KINDS if k.base],
                         F.sha2(text(in_base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
                         F.concat_ws(",", F.transform("found", lambda s: s["score"].cast("string"))).alias("scores"))
