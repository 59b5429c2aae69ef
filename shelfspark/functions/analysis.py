"""Text analysis: tokens, term counts, highlighting. All native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\p{IsHan}"
# a token is a run of Han characters or a run of other letters and digits
TOKEN = r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"
PIECE = TOKEN + r"|[^\p{L}\p{N}]+"


def coarse_tokens(text: Column) -> Column:
    """Lower-cased tokens, Han runs kept whole."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _bigrams(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, 2))


def fine_tokens(text: Column) -> Column:
    """Lower-cased tokens, Han runs cut into overlapping pairs."""
    tokens = coarse_tokens(text)
    cut = F.flatten(F.transform(
        tokens,
        lambda t: F.when(t.rlike(f"^{HAN}{{2,}}$"), _bigrams(t)).otherwise(F.array(t))))
    return F.when(text.rlike(HAN), cut).otherwise(tokens)


ANALYZERS: dict[str, Callable[[Column], Column]] = {
    "fine": fine_tokens,
    "coarse": coarse_tokens,
}


def analyze(text: Column, analyzer: str) -> Column:
    return ANALYZERS[analyzer](text)


def suggestion_words(tokens: Column) -> Column:
    """Distinct tokens longer than one character."""
    return F.array_distinct(F.filter(tokens, lambda t: F.length(t) > 1))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once per row.

    An expression used inside a lambda is evaluated for every element; a lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(terms: Column) -> Column:
    """Sorted terms -> one (term, tf) per run of equal terms."""
    size = F.size(terms)
    starts = F.filter(
        F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")),
        lambda i: (i == 1) | (F.get(terms, i - 1) != F.get(terms, i - 2)))
    return bind(starts, lambda at: F.transform(
        at,
        lambda start, n: F.struct(
            F.get(terms, start - 1).alias("term"),
            (F.coalesce(F.get(at, n + 1), size + 1) - start).alias("tf"))))


def term_counts(tokens: Column) -> Column:
    """Tokens -> array of (term, tf), by sorting and cutting into runs.

    Counting inside the row keeps the index build free of a shuffle.
    """
    return bind(F.sort_array(tokens), _runs)


def highlight(text: Column, terms: Column, pre: str, post: str) -> Column:
    """Wrap every word of `text` that is one of `terms`.

    In Han runs the characters covered by a matching pair are wrapped.
    """
    def mark(piece: Column) -> Column:
        return F.concat(F.lit(pre), piece, F.lit(post))

    def mark_run(run: Column) -> Column:
        def hit(i: Column) -> Column:
            return F.array_contains(terms, F.substring(run, i, 2))
        marked = F.transform(
            F.sequence(F.lit(1), F.length(run)),
            lambda i: F.when(((i < F.length(run)) & hit(i)) | ((i > 1) & hit(i - 1)),
                             mark(F.substring(run, i, 1)))
            .otherwise(F.substring(run, i, 1)))
        return F.replace(F.array_join(marked, ""), F.lit(post + pre), F.lit(""))

    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(F.array_contains(terms, F.lower(p)), mark(p))
            .when(p.rlike(f"^{HAN}{{2,}}$"), mark_run(p))
            .otherwise(p)),
        "")


SENTENCE = r"(?s)[^.!?\n。！？]*[.!?\n。！？]+\s*|[^.!?\n。！？]+$"


def passages(text: Column, size: int) -> Column:
    """A text in passages of about `size` characters that end with a sentence.

    A sentence joins the passage before it as long as that is shorter than `size`; a longer one is cut at the last
    space before `size`, or at `size` if it has none.
    """
    # sentences, long ones in parts that end at a space
    part = rf"(?s)(?:.{{1,{size - 1}}}\s|.{{{size}}}|.+$)"
    parts = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0)), lambda s: F.when(
        F.length(s) > size, F.regexp_extract_all(s, F.lit(part), F.lit(0))).otherwise(F.array(s))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def join(state: Column, s: Column) -> Column:
        fits = (state["open"] == "") | (F.length(state["open"]) + F.length(s) <= size)
        return F.when(fits, F.struct(state["done"].alias("done"), F.concat(state["open"], s).alias("open"))).otherwise(
            F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), s.alias("open")))

    return F.aggregate(parts, start, join, lambda state: F.when(state["open"] == "", state["done"])
                       .otherwise(F.concat(state["done"], F.array(state["open"]))))


def fragments(text: Column, weights: Column, tokens: Callable[[Column], Column], size: int, most: int) -> Column:
    """The best passages of a text, in their order: array of (place, score, text).

    weights: array of (term, weight) of the query's words. A passage scores the weights of its distinct
    words that are asked for, and a tenth of that again for each further one: passages that hold several words
    stand before those that repeat one. Passages without such a word are none.
    """
    def scored(passage: Column, at: Column) -> Column:
        found = bind(tokens(passage), lambda words: F.filter(weights, lambda w: F.array_contains(words, w["term"])))
        total = F.aggregate(found, F.lit(0.0), lambda done, w: done + w["weight"])
        spread = F.greatest(F.size(found) - 1, F.lit(0))
        return F.struct(F.round(total * (1.0 + 0.1 * spread), 6).alias("score"), (-at).alias("back"), passage.alias("text"))
    ranked = F.filter(F.transform(passages(text, size), scored), lambda s: s["score"] > 0)
    best = F.slice(F.reverse(F.array_sort(ranked)), F.lit(1), F.lit(most))
    placed = F.transform(best, lambda s: F.struct((-s["back"]).alias("place"), s["score"].alias("score"), s["text"].alias("text")))
    return F.array_sort(placed)
