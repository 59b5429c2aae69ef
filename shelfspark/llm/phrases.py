"""Phrases whose words stand together more often than their parts, counted with HAT-tries that spill.

A task counts the word n-grams of its texts in a burst trie: a shallow trie by word numbers whose leaves are hash containers of
the remaining words.  A container of more than BURST entries bursts into one per next word.  When the trie
holds TRIE_ENTRIES of them, whole subtrees leave it, the largest first, as sorted runs dealt by the first words of their keys;
a partition's runs are merged by a heap (`runs.merged`), however many tasks they come from.

Only what can be part of a phrase is counted: an n-gram is frequent only if the two (n-1)-grams in it are, so
each length is counted in a pass of its own against a bitmap of the frequent ones a word shorter.  The bitmap has a
fixed greatest size; a false hit in it costs an entry, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm import runs
from shelfspark.llm.common import text_or_empty, written
from shelfspark.llm.repeats import _TABLE, _mixed, _power_tables
from shelfspark.session import sized

LEAST_COUNT = 30
MOST_WORDS = 4
TOP = 2000
SCALE = 2_000_000
# a phrase is dropped inside a longer one that has this percentage of its count
COVERED = 80
NO_LANG = "und"
# bytes of text whose words are numbered together
BUFFER = 1 << 19
# entries of a container before it bursts, of a trie before subtrees are spilled
BURST = 4096
TRIE_ENTRIES = 400_000
# words a task counts before it hands them on
HELD_WORDS = 250_000
# numbers of words in a trie take 16 bits, so that four words are one key
WORD_BITS = 16
PARTS = 64
# the first columns of a key that name its partition: language and two words
PREFIX = 3
# the bitmap of frequent n-grams: 16 bits for each, within these bounds
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
# parts of a language that are ranked before it is
SALTS = 64
# kinds of bytes: of words, between words, between pieces
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class WordRuns:
    """The words of some texts: 64-bit ids (hashes), the piece each is in, and their bytes."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        self.data = data
        kind = _KIND[data]
        word = kind == 0
        self.starts = np.flatnonzero(~word[:-1] & word[1:]) + 1
        self.ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        with np.errstate(over="ignore"):
            powers, inverses = _power_tables(max(len(data), BUFFER + (BUFFER >> 1)))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_TABLE[data] * powers[: len(data)], out=sums[1:])
            self.ids = _mixed((sums[self.ends] - sums[self.starts]) * inverses[self.starts])
        # texts end with a piece
        self.piece = np.cumsum(kind == 2)[self.starts]

    def word(self, at: int) -> str:
        return self.data[self.starts[at]:self.ends[at]].tobytes().decode("utf-8", "surrogatepass")


def _word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, WordRuns]]:
    """(lang, words) of batches of (lang, text), texts of one language together, long ones cut between pieces."""
    for batch in batches:
        texts = sorted(zip(batch.column(0).to_pylist(), range(len(batch))), key=itemgetter(0))
        for lang, rows in groupby(texts, key=itemgetter(0)):
            held, size = [], 0
            for _, at in rows:
                text = batch.column(1)[at].as_py().encode("utf-8", "surrogatepass").lower()
                for part in _cut(text):
                    held.append(part)
                    size += len(part)
                    if size >= BUFFER:
                        yield lang, WordRuns(held)
                        held, size = [], 0
            if held:
                yield lang, WordRuns(held)


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between pieces (a piece that is longer stays whole)."""
    start = 0
    while len(text) - start > 2 * BUFFER:
        end = start + BUFFER
        while end < len(text) and _KIND[text[end]] != 2:
            end += 1
        yield text[start:end]
        start = end
    if start < len(text):
        yield text[start:]


class HatTrie:
    """Counts of n-grams of word numbers: a trie by the first words, hash containers of the rest.

    A key holds `words` numbers of WORD_BITS each.  `children` of a node are nodes or containers (dicts rest -> count).
    """

    def __init__(self, words: int, burst: int = BURST, limit: int = TRIE_ENTRIES):
        self.words, self.burst, self.limit = words, burst, limit
        self.root: dict = {}
        # entries under each first word
        self.sizes: dict[int, int] = {}

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct ascending keys with their counts."""
        shift = WORD_BITS * (self.words - 1)
        first = (keys >> np.uint64(shift)).astype(np.int64)
        rest = (keys & np.uint64((1 << shift) - 1)).tolist()
        amounts = counts.tolist()
        cuts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else np.empty(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(first)]):
            word = int(first[a])
            # below the first word: its own rest is words - 1 numbers long
            self.root[word], more = self._put(self.root.get(word, {}), self.words - 1, rest[a:b], amounts[a:b])
            self.sizes[word] = self.sizes.get(word, 0) + more

    def _put(self, node, words: int, keys: list[int], counts: list[int]):
        """(node with the keys added, entries it gained)."""
        if isinstance(node, tuple):
            shift = WORD_BITS * (words - 1)
            gained = 0
            for word, group in groupby(zip(keys, counts), key=lambda kc: kc[0] >> shift):
                group = list(group)
                low = (1 << shift) - 1
                child, more = self._put(node[0].get(word, {}), words - 1, [k & low for k, _ in group], [c for _, c in group])
                node[0][word] = child
                gained += more
            return node, gained
        before = len(node)
        get = node.get
        for k, c in zip(keys, counts):
            node[k] = get(k, 0) + c
        gained = len(node) - before
        # the last word has no trie below it
        if len(node) > self.burst and words > 1:
            items = sorted(node.items())
            burst = ({},)
            self._put(burst, words, [k for k, _ in items], [c for _, c in items])
            return burst, gained
        return node, gained

    def _entries(self, node, words: int, above: int) -> Iterator[tuple[int, int]]:
        if isinstance(node, tuple):
            for word, child in node[0].items():
                yield from self._entries(child, words - 1, above << WORD_BITS | word)
        else:
            shift = WORD_BITS * words
            for k, c in node.items():
                yield above << shift | k, c

    def full(self) -> bool:
        return sum(self.sizes.values()) > self.limit

    def spill(self, keep: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts) of whole subtrees, the largest first, until `keep` entries are left."""
        left = sum(self.sizes.values())
        keys, counts = [], []
        for word in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if left <= keep:
                break
            for k, c in self._entries(self.root.pop(word), self.words - 1, word):
                keys.append(k)
                counts.append(c)
            left -= self.sizes.pop(word)
        return np.array(keys, np.uint64), np.array(counts, np.uint64)


class _Counter:
    """Tries of a task, one per language, with the numbers of their words."""

    def __init__(self, words: int, limit: int):
        self.words, self.limit = words, limit
        self.tries: dict[str, HatTrie] = {}
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[int, int] = {}
        self.ids: list[int] = []

    def number(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of distinct ids."""
        out = []
        for i in ids.tolist():
            at = self.numbers.get(i)
            if at is None:
                at = self.numbers[i] = len(self.ids)
                self.ids.append(i)
            out.append(at)
        return np.array(out, np.uint64)

    def spilled(self, lang: str, keep: int = 0) -> Iterator[tuple[int, bytes]]:
        """(part, run): key columns are the language's hash and word ids."""
        keys, counts = self.tries[lang].spill(keep)
        if not len(keys):
            return
        ids = np.array(self.ids, np.uint64)
        columns = [ids[(keys >> np.uint64(WORD_BITS * (self.words - 1 - k)) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)]
                   for k in range(self.words)]
        columns = [np.full(len(keys), _lang_hash(lang)), *columns, counts]
        for part, some in runs.dealt(runs.combine(columns), PREFIX, PARTS):
            yield part, runs.pack(some)

    def all_spilled(self) -> Iterator[tuple[int, bytes]]:
        for lang in list(self.tries):
            yield from self.spilled(lang)
        self.tries.clear()
        self.clear()


def _gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = columns[0].copy()
        for c in columns[1:]:
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + c)
    return out


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))


class _Bitmap:
    """Whether an n-gram of a language may be frequent."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(lang: str, columns: list[np.ndarray], size: int) -> np.ndarray:
        return (_gram_hash([np.full(len(columns[0]), _lang_hash(lang)), *columns]) & np.uint64(size - 1)).astype(np.int64)

    def has(self, lang: str, columns: list[np.ndarray]) -> np.ndarray:
        at = self.places(lang, columns, len(self.bits) * 8)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _bitmap(frequent: DataFrame, words: int) -> _Bitmap:
    """Of frequent(lang, ids...): its size follows their number up to a fixed bound, and its bytes are put together in Spark."""
    spark = frequent.sparkSession
    n = frequent.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(1 + k).to_numpy().view(np.uint64) for k in range(words)]
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs.tolist()):
                mine = langs == lang
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_Bitmap.places(lang, [c[mine] for c in columns], size)) + 1)], ["at"])

    places = frequent.select("lang", *[f"w{k + 1}" for k in range(words)]).mapInArrow(run, "at long")
    found = (places.groupBy(F.bitmap_bucket_number("at").alias("block"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    bits = np.zeros(size // 8, np.uint8)
    for r in found:
        # places and blocks of Spark count from 1
        block = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["block"] - 1) * len(block)
        bits[at:at + len(block)] = block
    return _Bitmap(bits)


def _vocabulary(texts: DataFrame, least: int) -> DataFrame:
    """(lang, id, word, f) of the words that stand `least` times or more; a row of each language without an id has the sum of all its words.

    A task adds its words up until it holds HELD_WORDS of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[int, int]] = {}
        spelled: dict[int, str] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                ids = [None, *own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array([None, *map(spelled.__getitem__, own)], pa.string()),
                     pa.array([sum(own.values()), *own.values()], pa.int64())], ["lang", "id", "word", "f"])
            counts.clear()
            spelled.clear()

        for lang, words in _word_runs(batches):
            ids, first, n = np.unique(words.ids, return_index=True, return_counts=True)
            own = counts.setdefault(lang, {})
            get = own.get
            for i, at, c in zip(ids.view(np.int64).tolist(), first.tolist(), n.tolist()):
                held = get(i)
                if held is None:
                    own[i] = c
                    if i not in spelled:
                        spelled[i] = words.word(at)
                else:
                    own[i] = held + c
            if len(spelled) > HELD_WORDS:
                yield from flush()
        yield from flush()

    found = texts.mapInArrow(run, "lang string, id long, word string, f long")
    summed = found.groupBy("lang", "id").agg(F.min("word").alias("word"), F.sum("f").alias("f"))
    return written(summed.where((F.col("f") >= least) | F.col("id").isNull()), "vocabulary")


def _languages(words: DataFrame) -> DataFrame:
    """(lang, lang_id), sent to the tasks while they are few."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([_lang_hash(lang) for lang in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids.view(np.int64))], ["lang", "lang_id"])

    return sized(words.select("lang").distinct().mapInArrow(run, "lang string, lang_id long"))


def _counted(texts: DataFrame, langs: DataFrame, words: int, shorter: _Bitmap, least: int, limit: int = TRIE_ENTRIES,
             fan_in: int = runs.FAN_IN) -> DataFrame:
    """(lang, w1.., f) of the n-grams of `words` words that stand `least` times or more."""
    shared = texts.sparkSession.sparkContext.broadcast(shorter.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counter, number = _Counter(words, limit), TaskContext.get().partitionId() << 32
        frequent = _Bitmap(shared.value)

        def rows(made) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for part, data in made:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary())],
                                                 ["part", "run", "data"])
                number += 1

        for lang, found in _word_runs(batches):
            n = len(found.ids) - words + 1
            if n < 1:
                continue
            same = found.piece[words - 1:] == found.piece[:n]
            short = frequent.has(lang, [found.ids[k:len(found.ids) - words + 2 + k] for k in range(words - 1)])
            at = np.flatnonzero(same & short[:-1] & short[1:])
            if not len(at):
                continue
            used = np.unique(np.concatenate([found.ids[at + k] for k in range(words)]))
            # a part of so few places has no more words than there are numbers
            for some in np.array_split(at, 1 if len(used) <= 1 << WORD_BITS else -(-words * len(at) // (1 << WORD_BITS))):
                used = np.unique(np.concatenate([found.ids[some + k] for k in range(words)]))
                if len(counter.ids) + len(used) > 1 << WORD_BITS:
                    yield from rows(counter.all_spilled())
                numbers = counter.number(used)
                keys = np.zeros(len(some), np.uint64)
                for k in range(words):
                    keys = keys << np.uint64(WORD_BITS) | numbers[np.searchsorted(used, found.ids[some + k])]
                trie = counter.tries.setdefault(lang, HatTrie(words, limit=limit))
                trie.add(*np.unique(keys, return_counts=True))
                if trie.full():
                    yield from rows(counter.spilled(lang, limit // 2))
        yield from rows(counter.all_spilled())

    spilled = written(texts.mapInArrow(run, "part long, run long, data binary"), "spilled-runs")
    names = [f"w{k + 1}" for k in range(words)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for columns in runs.blocks(data.as_py()):
                    often = columns[-1] >= np.uint64(least)
                    yield pa.RecordBatch.from_arrays([pa.array(c[often].view(np.int64)) for c in columns], ["lang_id", *names, "f"])

    one = runs.merged(spilled, PARTS, PREFIX, fan_in)
    made = one.select("data").mapInArrow(read, "lang_id long, " + ", ".join(f"{w} long" for w in names) + ", f long")
    return written(made.join(langs, "lang_id").select("lang", *names, "f"), f"grams-{words}")


def scored(frequent: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, key, a, l, r, score) of the candidates of frequent(lang, key, f) that no longer one covers.

    `key` is an array of word ids; all n-grams that are frequent enough, single words included, are there.
    """
    cuts = frequent.where("size(key) > 1").select("lang", "key", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k")) \
        .select("*", F.slice("key", F.lit(1), F.col("k")).alias("first"), F.expr("slice(key, k + 1, size(key) - k)").alias("rest"))
    first = frequent.select("lang", F.col("key").alias("first"), F.col("f").alias("l"))
    rest = frequent.select("lang", F.col("key").alias("rest"), F.col("f").alias("r"))
    score = F.expr(f"(CAST(a AS DECIMAL(28, 0)) * CAST({SCALE} AS DECIMAL(7, 0))) DIV CAST(l + r AS DECIMAL(20, 0))")
    best = (cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
            .select("lang", "key", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
            .groupBy("lang", "key").agg(F.first("a").alias("a"), F.min("cut").alias("cut")))
    # a candidate's inner phrases, each with the longer one's count
    longer = frequent.where("size(key) > 2").select("lang", F.col("f").alias("over"), F.explode(F.expr(
        "flatten(transform(sequence(2, size(key) - 1), n -> transform(sequence(1, size(key) - n + 1), i -> slice(key, i, n))))")).alias("key"))
    over = longer.groupBy("lang", "key").agg(F.max("over").alias("over"))
    return (best.join(over, ["lang", "key"], "left")
            .where(F.expr(f"over IS NULL OR CAST(100 AS DECIMAL(4, 0)) * over < CAST({covered} AS DECIMAL(4, 0)) * a"))
            .select("lang", "key", "a", "cut.l", "cut.r", "cut.score"))


def frequent_grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, most_words: int = MOST_WORDS,
                   limit: int = TRIE_ENTRIES, fan_in: int = runs.FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(frequent(lang, key, f), words): all n-grams of up to `most_words` words that stand `least` times or more, and what `_vocabulary` gives."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), text_or_empty(text_col).alias("text"))
    words = _vocabulary(texts, least)
    langs = _languages(words)
    grams = written(words.where("id is not null").select("lang", F.col("id").alias("w1"), "f"), "grams-1")
    frequent = grams.select("lang", F.array("w1").alias("key"), "f")
    for n in range(2, most_words + 1):
        grams = _counted(texts, langs, n, _bitmap(grams, n - 1), least, limit, fan_in)
        frequent = frequent.unionByName(grams.select("lang", F.array(*[f"w{k + 1}" for k in range(n)]).alias("key"), "f"))
    return frequent, words


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, most_words: int = MOST_WORDS,
            top: int = TOP, covered: int = COVERED, limit: int = TRIE_ENTRIES, fan_in: int = runs.FAN_IN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `top` phrases of each language.

    A-Z are lower-cased; pieces end at `.,;:!?` and line ends, words are separated by spaces and tabs inside them.  A null text is empty, a null
    language `und`; an empty text or table gives no phrase.  Very long texts are read in parts that end between pieces, so no n-gram is lost; repeated rows
    count as often as they stand there.  Equal scores and counts rank by the phrase's UTF-8 bytes.  Other columns are not read.
    Words are told apart by 64-bit hashes.
    """
    frequent, words = frequent_grams(docs, lang_col, text_col, least, most_words, limit, fan_in)
    candidates = scored(frequent, covered)
    # ties are kept, so the texts of the first ranks alone are looked up
    first = candidates.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    # first of each part of a language, then of the language
    for group in (["lang", "salt"], ["lang"]):
        order = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("a"))
        first = first.withColumn("place", F.rank().over(order)).where(F.col("place") <= top).drop("place")
    first = written(first.drop("salt"), "first-phrases")
    spelled = (first.select("lang", "key", F.posexplode("key").alias("at", "id"))
               .join(words.select("lang", "id", "word"), ["lang", "id"])
               .groupBy("lang", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ")
                                           .alias("phrase")))
    totals = words.where("id is null").select("lang", F.col("f").alias("n"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (first.join(spelled, ["lang", "key"]).withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= top)
            .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
