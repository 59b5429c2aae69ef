"""Quality rules: base counts, and distance of a document's histograms from its language's.

Two histograms are taken of a text: of its characters by class, and of the most common
words of its language.  A language's reference is the sum over all of its documents that
pass the base rules.  A document is rejected whose Jensen-Shannon distance (the root of
the divergence in bits, from 0 to 1) from the reference is over a limit; short
documents are not judged by a histogram that a few words fill.

DataFrame functions only.  Texts are read once; the histograms are written, and the rest
works on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import text_or_empty, written

WINDOW_WORDS = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
# guards: histograms of fewer characters, of fewer words or of a smaller language are not compared
LEAST_CHARS = 200
LEAST_LETTER_WORDS = 50
LEAST_REFERENCE = 20
CHAR_LIMIT = 0.30
WORD_LIMIT = 0.36

# Character classes as patterns of single characters, in order; what none names is the last class.
CHAR_CLASSES = ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[.,;:!?'\"()-]", "[#*$%&|<>]")
# Common words of each language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "on", "with", "as", "was", "are", "be", "by", "this", "from", "or", "an", "at"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"),
}
_SPACES = " \t\n\x0b\x0c\r"


def _length_without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of `docs` with `words`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A repeated word lies in a window of WINDOW_WORDS words that occurs twice or more.
    Windows are compared by 64-bit hashes of their words.
    """
    text = F.col(text_col)
    df = docs.withColumn("words", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    word = lambda i, k: F.get(F.col("words"), i + k)
    df = df.withColumn("_windows", F.when(F.col("n_words") >= WINDOW_WORDS, F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW_WORDS),
        lambda i: F.xxhash64(*[word(i, k) for k in range(WINDOW_WORDS)]))).otherwise(F.array().cast("array<long>")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    # only texts with a repeated window are sorted
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda j: F.get(F.col("_sorted"), j)["h"]
    df = df.withColumn("_twice", F.sort_array(F.transform(
        F.filter("_sorted", lambda p, j: F.coalesce(at(j - 1) == p["h"], F.lit(False))
                 | F.coalesce(at(j + 1) == p["h"], F.lit(False))), lambda p: p["i"])))
    far = F.lit(WINDOW_WORDS)
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(
        F.transform("_twice", lambda i, j: F.least(far, F.coalesce(F.get(F.col("_twice"), j + 1) - i, far))),
        F.lit(0), lambda total, x: total + x), F.lit(0)).cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    return (df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
            .withColumn("word_chars", _length_without(text, _SPACES).cast("long"))
            .withColumn("n_symbols", (F.length(text) - _length_without(text, "#*$%&|<>")).cast("long"))
            .drop("_windows", "_sorted", "_twice", "_lines"))


def char_histogram(text: Column) -> Column:
    """Characters of each class, what no class names last."""
    counts = [(F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("long") for pattern in CHAR_CLASSES]
    rest = F.length(text).cast("long")
    for count in counts:
        rest = rest - count
    return F.array(*counts, rest)


def _listed(letters: str, words: tuple[str, ...]) -> Column:
    listed = F.array(*[F.lit(w) for w in words])
    hits = F.filter(F.col(letters), lambda w: F.array_contains(listed, w))

    def counts(held):
        each = F.transform(listed, lambda w: F.size(F.filter(held["hits"], lambda h: h == w)).cast("long"))
        return F.concat(each, F.array((F.size(F.col(letters)) - F.size(held["hits"])).cast("long")))
    # an array of one, so that the hits are found once
    return F.get(F.transform(F.array(F.struct(hits.alias("hits"))), counts), F.lit(0))


def word_histogram(letters: str, lang: Column) -> Column:
    """Occurrences of each common word of the language among `letters`, the other words last; null without a list."""
    out = F.lit(None).cast("array<long>")
    for code, words in COMMON_WORDS.items():
        out = F.when(lang == code, _listed(letters, words)).otherwise(out)
    return out


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either is empty or holds nothing."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    shares = lambda a: F.transform(a, lambda x: x / F.nullif(total(a), F.lit(0)))

    def term(a, b):
        half = (a + b) / 2
        side = lambda x: F.when(x > 0, x * F.log2(x / half)).otherwise(F.lit(0.0))
        return (side(a) + side(b)) / 2
    parts = F.zip_with(shares(p), shares(q), term)
    root = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))
    return F.when((total(p) > 0) & (total(q) > 0), root)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of `docs`: base counts, base_failed, char_distance, word_distance, kept.

    base_failed: fewer than LEAST_WORDS words, or over MOST_REPEATED_PERCENT percent of
    the words repeated.  A distance is null where a guard holds it back: null text or language, few
    characters or words, no word list, few documents in the reference.  Null texts have no words.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       text_or_empty(text_col).alias("text"))
    counted = base_counts(slim).drop("words")
    counted = counted.withColumn("letters", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    rows = written(counted.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))
        .alias("base_failed"),
        F.size("letters").cast("long").alias("n_letter_words"), F.length("text").cast("long").alias("n_chars"),
        char_histogram(F.col("text")).alias("chars"), word_histogram("letters", F.col("lang")).alias("commons")), "quality")
    longest = max(len(words) for words in COMMON_WORDS.values()) + 1
    sums = lambda name, n: F.array(*[F.coalesce(F.sum(F.get(F.col(name), F.lit(k))), F.lit(0)) for k in range(n)])
    reference = (rows.where("not base_failed and lang is not null").groupBy("lang")
                 .agg(F.count("*").alias("n_docs"), sums("chars", len(CHAR_CLASSES) + 1).alias("ref_chars"),
                      sums("commons", longest).alias("ref_commons"))
                 .where(F.col("n_docs") >= LEAST_REFERENCE).drop("n_docs"))
    judged = rows.join(written(reference, "reference"), "lang", "left")
    judged = (judged
              .withColumn("char_distance", F.when(F.col("n_chars") >= LEAST_CHARS, distance(F.col("chars"), F.col("ref_chars"))))
              .withColumn("word_distance", F.when(F.col("n_letter_words") >= LEAST_LETTER_WORDS, distance(
                  F.col("commons"), F.slice("ref_commons", F.lit(1), F.greatest(F.size("commons"), F.lit(0)))))))
    fits = (F.coalesce(F.col("char_distance") <= CHAR_LIMIT, F.lit(True))
            & F.coalesce(F.col("word_distance") <= WORD_LIMIT, F.lit(True)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "char_distance", "word_distance", (~F.col("base_failed") & fits).alias("kept"))
