"""Completion of typed prefixes, exact or with one typing error."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.analysis import bind
from shelfspark.session import materialize, sized

SIZE = 10
FUZZY_FROM = 3       # shorter prefixes must match exactly
FIXED_PREFIX = 1     # leading characters that must match exactly


def _top(rows: DataFrame, keys: list[str], order: list[Column], size: int, place: str = "place") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(place, F.row_number().over(window)).filter(F.col(place) <= size)


def _by_weight() -> list[Column]:
    return [F.desc("weight"), F.asc("title"), F.asc("doc_id")]


class Completions(NamedTuple):
    """The best `size` documents of each word: words(word, doc_id, title, weight)."""

    words: DataFrame
    size: int


def completions(docs: DataFrame, size: int = SIZE) -> Completions:
    """What can be suggested from `docs(doc_id, title, suggest)`, up to `size` documents a text.

    The best documents of a prefix are among the best of its words, so words are cut to `size`
    rows; a word of very many documents costs each task only `size` rows. Words are kept whole. Their
    prefixes are made when texts are typed, of the lengths that were typed.
    """
    # the highest weight of each word is found inside the row, before any shuffle
    weighted = bind(F.col("suggest"), lambda es: F.transform(
        F.array_distinct(F.flatten(F.transform(es, lambda e: e["input"]))),
        lambda word: F.struct(word.alias("word"), F.array_max(F.transform(
            F.filter(es, lambda e: F.array_contains(e["input"], word)),
            lambda e: e["weight"])).alias("weight"))))
    inputs = docs.select("doc_id", "title", F.explode(weighted).alias("w")).select(
        "doc_id", "title", "w.word", "w.weight")
    return Completions(_top(inputs, ["word"], _by_weight(), size).drop("place"), size)


def _asked_size(completed: Completions, size: int | None) -> int:
    if size is not None and size > completed.size:
        raise ValueError(f"{size} suggestions asked, the completions keep {completed.size}")
    return size or completed.size


def _lengths(texts: DataFrame, around: int = 0) -> list[int]:
    """Distinct lengths of the texts, and those up to `around` beside them; a few numbers for any number of texts."""
    typed = {r[0] for r in texts.select(F.length("text")).distinct().collect() if r[0]}
    return sorted({n + d for n in typed for d in range(-around, around + 1) if n + d > 0})


def _prefixes(completed: Completions, lengths: list[int]) -> DataFrame:
    """(prefix, doc_id, title, weight): prefixes of the asked lengths, with the documents of their words."""
    asked = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("word"))
    return (completed.words.select("doc_id", "title", "weight", F.explode(
                F.transform(asked, lambda n: F.substring("word", F.lit(1), n))).alias("prefix"))
            .groupBy("prefix", "doc_id", "title").agg(F.max("weight").alias("weight")))


def suggest_prefix(queries: DataFrame, completed: Completions, size: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, title, weight) for `queries(query_id, text)`."""
    size = _asked_size(completed, size)
    typed = queries.select("query_id", F.lower("text").alias("text"))
    texts = typed.select("text").distinct()
    found = texts.join(_prefixes(completed, _lengths(texts)), F.col("text") == F.col("prefix"))
    # rank once per distinct text, then hand the list to every query that typed it
    ranked = _top(found.drop("prefix"), ["text"], _by_weight(), size, "rank")
    return typed.join(ranked, "text").select("query_id", "rank", "doc_id", "title", "weight")


def _near_keys(value: Column) -> Column:
    """Hashes of the text itself and of every form with one later character left out."""
    # two texts one edit or one swap apart share such a form
    cuts = F.when(F.length(value) > FIXED_PREFIX, F.transform(
        F.sequence(F.lit(FIXED_PREFIX + 1), F.length(value)),
        lambda i: F.xxhash64(F.concat(F.substring(value, F.lit(1), i - 1),
                                      F.substring(value, i + 1, F.length(value))))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(value)), F.coalesce(cuts, F.array().cast("array<bigint>"))))


def _swapped(a: Column, b: Column) -> Column:
    """Equal but for two neighbouring characters in the other order."""
    def swap(i: Column) -> Column:
        return F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)),
                        F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    places = F.sequence(F.lit(FIXED_PREFIX + 1), F.length(a) - 1)
    return ((F.length(a) == F.length(b)) & (F.length(a) > FIXED_PREFIX + 1)
            & F.exists(F.when(F.length(a) > FIXED_PREFIX + 1, places)
                       .otherwise(F.array().cast("array<int>")), lambda i: swap(i) == b))


def typing_distance(a: Column, b: Column) -> Column:
    """0 for equal texts, 1 for one edit or swap after the first character, else null."""
    same_start = F.substring(a, 1, FIXED_PREFIX) == F.substring(b, 1, FIXED_PREFIX)
    return (F.when(a == b, F.lit(0))
            .when(same_start & ((F.levenshtein(a, b, 1) == 1) | _swapped(a, b)), F.lit(1)))


def near_prefixes(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(text, prefix, distance) for distinct `texts(text)` and distinct `known(prefix)`.

    Both sides are spread over forms with one character left out and joined on
    the forms' hashes: distinct texts and prefixes give each form few rows, and no pair
    is looked at that is not close already.
    """
    exact = texts.join(known, texts["text"] == known["prefix"]).select(
        "text", "prefix", F.lit(0).alias("distance"))
    # while few texts were typed, the many forms of the prefixes are not shuffled
    left = sized(texts.filter(F.length("text") >= FUZZY_FROM).select(
        "text", F.explode(_near_keys(F.col("text"))).alias("form")))
    right = known.select("prefix", F.explode(_near_keys(F.col("prefix"))).alias("form"))
    close = (left.join(right, "form").select("text", "prefix").distinct()
             .withColumn("distance", typing_distance(F.col("text"), F.col("prefix")))
             .filter(F.col("distance") == 1))
    return exact.unionByName(close)


def suggest_fuzzy(queries: DataFrame, completed: Completions, size: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, title, weight, distance).

    Heavier suggestions first, then closer ones, then by title; one row per
    document. The words of `completed` are read more than once, so they should be a written table.
    """
    size = _asked_size(completed, size)
    typed = queries.select("query_id", F.lower("text").alias("text"))
    longest = completed.words.agg(F.coalesce(F.max(F.length("word")), F.lit(0))).first()[0]
    # a text more than one longer than the longest word is near no prefix of it
    texts = typed.filter(F.length("text") <= longest + 1).select("text").distinct()
    prefixes = materialize(_prefixes(completed, _lengths(texts, around=1)))
    found = (near_prefixes(texts, prefixes.select("prefix").distinct()).join(prefixes, "prefix")
             .groupBy("text", "doc_id", "title")
             .agg(F.max(F.struct("weight", (-F.col("distance")).alias("nearness"))).alias("best"))
             .select("text", "doc_id", "title", "best.weight",
                     (-F.col("best.nearness")).alias("distance")))
    order = [F.desc("weight"), F.asc("distance"), F.asc("title"), F.asc("doc_id")]
    ranked = _top(found, ["text"], order, size, "rank")
    return typed.join(ranked, "text").select(
        "query_id", "rank", "doc_id", "title", "weight", "distance")


def titles_json(suggested: DataFrame) -> DataFrame:
    """(query_id, titles): the suggested titles as one JSON array per query."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "title")))
    return suggested.groupBy("query_id").agg(
        F.to_json(F.transform(ordered, lambda s: s["title"])).alias("titles"))
