"""The operators applied to the given tables: one query per operator, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import alignment, benchmark, chat, jaccard, mixing, paragraphs, phrases, pii, quality, repeats, simhash, tokens, toxicity
from shelfspark.llm.common import table
from shelfspark.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "forums": 2}, "lang": {"en": 6, "de": 2, "fr": 2}}


def mix_levels() -> dict[str, Column]:
    """The tree of the mixture from the root down; a source's number names its domain."""
    number = F.regexp_extract("source", "[0-9]+$", 0).try_cast("int")
    domain = F.when(number < 10, "web").when(number < 16, "books").otherwise("forums")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op1_token_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of all documents, written as shards and read back."""
    out = scratch_path(spark, "token-shards")
    tokens.write_shards(table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER), out)
    return tokens.read_documents(spark, out)


def op2_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without the bytes of repeated 200-byte strings."""
    return repeats.without_repeats(table(spark, sf, "documents"))


def op3_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of each document in a mixture as large as all documents, by domain, language and source."""
    levels = mix_levels()
    docs = table(spark, sf, "documents").select(
        "doc_id", *[column.alias(name) for name, column in levels.items()],
        mixing.word_count(F.coalesce("text", F.lit(""))).alias("n_tokens"))
    return mixing.select_documents(docs, list(levels), MIX_WEIGHTS, F.col("total"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         CASE WHEN num < 10 THEN 'web' WHEN num < 16 THEN 'books' ELSE 'forums' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM (SELECT *, TRY_CAST(regexp_extract(source, '[0-9]+$') AS INTEGER) AS num FROM documents)),
leaf AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, 4 * CAST(sum(n_tokens) AS BIGINT) AS cap,
         CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'forums' THEN 2 ELSE 1 END AS w1,
         CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w2, 1 AS w3
  FROM d GROUP BY ALL),
root AS (SELECT CAST(sum(tokens) AS BIGINT) AS budget FROM leaf),
n1 AS (SELECT domain, sum(cap) AS cap, any_value(w1) AS w, (SELECT budget FROM root) AS budget FROM leaf GROUP BY domain),
f1 AS (SELECT *, cap * sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= (budget - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, domain
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS full_ FROM n1),
b1 AS (SELECT domain, CASE WHEN full_ THEN cap ELSE
         ((budget - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)) * w)
         // sum(CASE WHEN NOT full_ THEN w END) OVER () END AS budget FROM f1),
n2 AS (SELECT domain, lang, sum(cap) AS cap, any_value(w2) AS w, any_value(b1.budget) AS budget
       FROM leaf JOIN b1 USING (domain) GROUP BY domain, lang),
f2 AS (SELECT *, cap * sum(w) OVER (PARTITION BY domain ORDER BY CAST(cap AS DOUBLE) / w, lang
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY CAST(cap AS DOUBLE) / w, lang
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS full_ FROM n2),
b2 AS (SELECT domain, lang, CASE WHEN full_ THEN cap ELSE
         ((budget - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY domain), 0)) * w)
         // sum(CASE WHEN NOT full_ THEN w END) OVER (PARTITION BY domain) END AS budget FROM f2),
n3 AS (SELECT domain, lang, source, tokens, cap, w3 AS w, b2.budget AS budget FROM leaf JOIN b2 USING (domain, lang)),
f3 AS (SELECT *, cap * sum(w) OVER (PARTITION BY domain, lang ORDER BY CAST(cap AS DOUBLE) / w, source
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY CAST(cap AS DOUBLE) / w, source
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS full_ FROM n3),
b3 AS (SELECT domain, lang, source, tokens, CASE WHEN full_ THEN cap ELSE
         ((budget - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY domain, lang), 0)) * w)
         // sum(CASE WHEN NOT full_ THEN w END) OVER (PARTITION BY domain, lang) END AS budget FROM f3),
plan AS (SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest FROM b3
         WHERE tokens > 0 AND budget > 0),
keyed AS (SELECT d.*, epochs, rest, md5('42:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
          FROM d JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING)
             - sum(n_tokens) OVER (PARTITION BY domain, lang, source, key) AS start FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN start < rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM summed WHERE epochs + CASE WHEN start < rest THEN 1 ELSE 0 END > 0
"""


def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.report(table(spark, sf, "documents")).drop("scores")


def _spans_sql(kind: str, at: int, pattern: str, valid: str) -> str:
    """(doc, kind, start_, end_, span, before, after) of a pattern's valid matches."""
    return f"""
  SELECT doc, {at} AS kind_no, '{kind}' AS kind, end_ - length(span) AS start_, end_, span, before, after FROM (
    SELECT *, sum(length(gap) + length(span)) OVER (PARTITION BY doc ORDER BY i) AS end_ FROM (
      SELECT doc, i, gaps[i] AS gap, spans[i] AS span, right(gaps[i], 40) AS before, left(gaps[i + 1], 40) AS after FROM (
        SELECT doc, spans, gaps, unnest(range(1, len(spans) + 1)) AS i FROM (
          SELECT doc, regexp_extract_all(text, '{pattern}') AS spans, regexp_split_to_array(text, '{pattern}') AS gaps FROM d))))
  WHERE {valid}"""


_LUHN_SQL = r"""length(replace(replace(span, ' ', ''), '-', '')) BETWEEN 13 AND 19 AND
    list_sum(list_transform(range(length(replace(replace(span, ' ', ''), '-', ''))), lambda i:
      CASE WHEN i % 2 = 1 THEN
        CASE WHEN 2 * CAST(replace(replace(span, ' ', ''), '-', '')[-1 - i] AS INT) > 9
             THEN 2 * CAST(replace(replace(span, ' ', ''), '-', '')[-1 - i] AS INT) - 9
             ELSE 2 * CAST(replace(replace(span, ' ', ''), '-', '')[-1 - i] AS INT) END
      ELSE CAST(replace(replace(span, ' ', ''), '-', '')[-1 - i] AS INT) END)) % 10 = 0"""
_IBAN_LENGTH_SQL = "CASE left(span, 2) " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in pii.IBAN_LENGTHS.items()) + " END"
_IBAN_SQL = rf"""length(replace(span, ' ', '')) = {_IBAN_LENGTH_SQL} AND
    list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform(
      string_split(substr(replace(span, ' ', ''), 5) || left(replace(span, ' ', ''), 4), ''),
      lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)),
      lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"""
_SCORE_SQL = r"""30 + CASE WHEN regexp_matches(before, '(?i)ssn|social security|tax id') OR
      regexp_matches(after, '(?i)ssn|social security|tax id') THEN 20 ELSE 0 END
    - CASE WHEN regexp_matches(before, '(?i)version|example|isbn|order') OR
      regexp_matches(after, '(?i)version|example|isbn|order') THEN 30 ELSE 0 END >= 50"""
_IBAN_SCORE_SQL = r"""90 + CASE WHEN regexp_matches(before, '(?i)iban|account|bank') OR
      regexp_matches(after, '(?i)iban|account|bank') THEN 20 ELSE 0 END
    - CASE WHEN regexp_matches(before, '(?i)version|example|isbn|order') OR
      regexp_matches(after, '(?i)version|example|isbn|order') THEN 30 ELSE 0 END >= 50"""
OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_spans_sql("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")}
  UNION ALL {_spans_sql("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
                        "list_bool_and(list_transform(string_split(span, '.'), lambda p: CAST(p AS HUGEINT) <= 255))")}
  UNION ALL {_spans_sql("card", 2, r"[0-9](?:[ -]?[0-9])+", _LUHN_SQL)}
  UNION ALL {_spans_sql("phone", 3, r"\+[0-9][ ().0-9-]+[0-9]",
                        "length(regexp_replace(span, '[^0-9]', '', 'g')) BETWEEN 9 AND 15")}
  UNION ALL {_spans_sql("iban", 4, pii.KINDS[4].pattern, _IBAN_SQL + " AND " + _IBAN_SCORE_SQL)}
  UNION ALL {_spans_sql("ssn", 5, pii.KINDS[5].pattern, "NOT (regexp_matches(before, '[0-9-]$') OR "
                        "regexp_matches(after, '^[0-9-]') OR regexp_matches(span, '^(?:000|666|9)')) AND " + _SCORE_SQL)}),
g AS (SELECT doc, count(*) FILTER (WHERE kind_no = 0) AS n_email, count(*) FILTER (WHERE kind_no = 1) AS n_ip, count(*) FILTER (WHERE kind_no = 2) AS n_card,
             count(*) FILTER (WHERE kind_no = 3) AS n_phone,
             string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY kind_no, start_) FILTER (WHERE kind_no < 4) AS base,
             string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY kind_no, start_) AS spans FROM s GROUP BY doc)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc)
"""


def op5_chat(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations with legal roles, rendered piece by piece."""
    return chat.repaired(table(spark, sf, "conversations"))


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Base rules and divergence from the language for all documents."""
    return quality.quality(table(spark, sf, "documents")).drop("char_distance", "word_distance")


def _distance_sql(p: str, q: str) -> str:
    return f"""sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda k: (
      CASE WHEN {p}[k] > 0 THEN ({p}[k] / list_sum({p})) * log2(({p}[k] / list_sum({p}))
        / (({p}[k] / list_sum({p}) + {q}[k] / list_sum({q})) / 2)) ELSE 0.0 END +
      CASE WHEN {q}[k] > 0 THEN ({q}[k] / list_sum({q})) * log2(({q}[k] / list_sum({q}))
        / (({p}[k] / list_sum({p}) + {q}[k] / list_sum({q})) / 2)) ELSE 0.0 END) / 2))))"""


_CLASSES_SQL = ", ".join(f"length(text) - length(regexp_replace(text, '{c.replace(chr(39), chr(39) * 2)}', '', 'g'))"
                         for c in quality.CHAR_CLASSES)
_COMMON_SQL = " ".join("WHEN '{}' THEN [{}]".format(code, ", ".join(f"'{w}'" for w in words))
                       for code, words in quality.COMMON_WORDS.items())
OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS lines,
             regexp_extract_all(lower(text), '\p{{L}}+') AS letters FROM d),
spread AS (SELECT doc, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
grams AS (SELECT doc, i, word || ' ' || lead(word, 1) OVER v || ' ' || lead(word, 2) OVER v || ' ' || lead(word, 3) OVER v
                 || ' ' || lead(word, 4) OVER v AS gram FROM spread WINDOW v AS (PARTITION BY doc ORDER BY i)),
twice AS (SELECT doc, i FROM (SELECT doc, i, count(*) OVER (PARTITION BY doc, gram) AS n FROM grams WHERE gram IS NOT NULL) WHERE n > 1),
repeated AS (SELECT doc, count(DISTINCT i + k) AS n_repeat_words FROM twice, unnest([0, 1, 2, 3, 4]) AS t(k) GROUP BY doc),
base AS (
  SELECT doc, doc_id, lang, len(words) AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(words) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(words) AS base_failed, length(text) AS n_chars,
         len(letters) AS n_letters, [{_CLASSES_SQL}] AS chars_, CASE lang {_COMMON_SQL} END AS listed, letters
  FROM w LEFT JOIN repeated USING (doc)),
counted AS (SELECT *, CASE WHEN listed IS NOT NULL THEN
              list_transform(listed, lambda v: len(list_filter(letters, lambda x: x = v))) END AS common_ FROM base),
h AS (SELECT * EXCLUDE (letters), list_append(chars_, n_chars - list_sum(chars_)) AS chars,
             list_append(common_, n_letters - list_sum(common_)) AS commons FROM counted),
ref AS (SELECT lang, list(s ORDER BY k) AS ref_chars FROM (
          SELECT lang, k, sum(chars[k]) AS s FROM h, range(1, 8) AS r(k) WHERE NOT base_failed GROUP BY lang, k)
        GROUP BY lang HAVING lang IN (SELECT lang FROM h WHERE NOT base_failed GROUP BY lang HAVING count(*) >= 20)),
ref2 AS (SELECT lang, list(s ORDER BY k) AS ref_commons FROM (
          SELECT lang, k, sum(commons[k]) AS s FROM h, range(1, 24) AS r(k) WHERE NOT base_failed AND k <= len(commons) GROUP BY lang, k)
        GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND coalesce(CASE WHEN n_chars >= 200 AND ref_chars IS NOT NULL THEN {_distance_sql("chars", "ref_chars")} END <= {quality.CHAR_LIMIT}, true)
       AND coalesce(CASE WHEN n_letters >= 50 AND ref_chars IS NOT NULL THEN {_distance_sql("commons", "ref_commons")} END <= {quality.WORD_LIMIT}, true) AS kept
FROM h LEFT JOIN ref USING (lang) LEFT JOIN ref2 USING (lang)
"""


def op7_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all documents that repeat an earlier one, word for word or nearly."""
    return paragraphs.paragraph_report(table(spark, sf, "documents"))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that cover at least half of a benchmark item."""
    return benchmark.contaminated_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of all documents by a machine fitted on the labelled ones."""
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose fingerprints differ in at most 4 bits."""
    placed = simhash.simhash_components(table(spark, sf, "documents"))
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """All documents aligned token by token between two tokenizers, with corpus-wide counts of linked ids."""
    docs = table(spark, sf, "documents")
    return alignment.align(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES)).drop("groups")


def op12_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles overlap by 90 percent."""
    return jaccard.jaccard_components(table(spark, sf, "documents"))


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS grams FROM d),
g AS (SELECT r, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (SELECT x.r AS a, y.r AS b FROM g x JOIN g y ON x.gram = y.gram AND x.r < y.r
            AND 90 * greatest(x.n, y.n) <= 100 * least(x.n, y.n)
          GROUP BY x.r, y.r, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(r, other) AS (SELECT r, r FROM s UNION SELECT reach.r, b FROM reach JOIN steps ON a = other)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN reach ON reach.r = s.r JOIN s o ON o.r = other GROUP BY s.r, s.doc_id, len(s.grams)
"""


def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The best phrases of two to four words of each language."""
    return phrases.phrases(table(spark, sf, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER_SQL}, '[.,;:!?
-]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM d),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, key, count(*) AS f FROM (
        SELECT lang, unnest(flatten([{", ".join(f"list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i + {n - 1}])" for n in (1, 2, 3, 4))}])) AS key FROM p)
      GROUP BY lang, key HAVING count(*) >= 30),
cuts AS (SELECT lang, key, f AS a, unnest(range(1, len(key))) AS k FROM f WHERE len(key) > 1),
cut AS (SELECT cuts.*, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS score FROM cuts
        JOIN f x ON x.lang = cuts.lang AND x.key = cuts.key[1:k] JOIN f y ON y.lang = cuts.lang AND y.key = cuts.key[k + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, key ORDER BY score, k) = 1),
longer AS (SELECT lang, f, key[i:i + n - 1] AS key FROM f, range(1, 4) AS i(i), range(2, 4) AS n(n) WHERE n < len(key) AND i + n - 1 <= len(key)),
covered AS (SELECT lang, key, max(f) AS over_ FROM longer GROUP BY lang, key),
kept AS (SELECT best.lang, array_to_string(best.key, ' ') AS phrase, a, l, r, score FROM best
         LEFT JOIN covered ON covered.lang = best.lang AND covered.key = best.key WHERE over_ IS NULL OR 100 * over_ < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_repeats": op2_repeats,
    "op3_mixture": op3_mixture,
    "op4_pii": op4_pii,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_paragraphs": op7_paragraphs,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_jaccard": op12_jaccard,
    "op13_phrases": op13_phrases,
}
ORACLE = {"op3_mixture": OP3_SQL, "op4_pii": OP4_SQL, "op6_quality": OP6_SQL,
          "op12_jaccard": OP12_SQL, "op13_phrases": OP13_SQL}
