"""Exact Jaccard join of word n-gram sets, with skips and answers taken over between related sets.

Two sets link when 100 * intersection >= PERCENT * union.  Equal sets are one vertex.

* Index: the grams of a set stand in one order for all sets, rare ones first (a fixed table of counters says which are
  common), and only as many of the first are indexed as a link needs.  A list is in the order of (size, position) and cut into
  blocks: sizes that cannot link end the scan, and a block whose positions leave too few grams behind is skipped whole.
* Answers: in a list of more than LIST_ROWS sets no pair is formed.  All members are compared with one of them, the
  centre, and what they answer among each other is derived from that: a set is then the grams by which it differs from the centre
  (missing or added, its *difference*), and with S(y) the sets, D(y) the missing and E(y) the added ones

      |S(y) & S(z)| = |S(x)| - |D(y)| - |D(z)| + |diff(y) & diff(z)|

  so a link needs a number of common differences that is known for each set.  Sets so near to the centre that none is needed
  link at once; the others are indexed by their differences, rarest first, as the sets were before.  What every near copy shares is in no
  difference, so the long lists fall apart; a list that stays long is dealt by a centre of its own once more.
* Pairs inside one component need no answer and are skipped.

In every round two members of a cell link when 2 * (100 + PERCENT) * |common| >= the sum of their weights (`_weights`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import components, text_or_empty, written
from shelfspark.llm.paragraphs import _word_hashes
from shelfspark.llm.repeats import _mixed
from shelfspark.llm.runs import pack, unpack
from shelfspark.session import sized

GRAM_WORDS = 3
PERCENT = 90
# counters that tell common grams; a fixed number whatever the corpus
COUNTERS = 1 << 22
SLICES = 64
# members of a list beyond which answers are derived from a centre
LIST_ROWS = 256
# entries of a list that are skipped together
SKIP_BLOCK = 16
# rounds of centres; what is then still in long lists is compared pair by pair, in tasks that Spark splits
ROUNDS = 6
# pairs in long lists that are compared without a centre, being few
PLAIN_PAIRS = 200_000
# of a set's parity bitmap
BITS = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CLASS_BITS = 5


def _weights(percent: int) -> tuple[int, int]:
    """(unit, half): whole sets of n grams have weight unit * n, and link when half * 2 * |common| >= the sum of both.

    100 * I >= percent * (n + m - I) is the same as (100 + percent) * I >= percent * (n + m); doubled, so that
    half a centre is a whole number.
    """
    return 2 * percent, 100 + percent


def gram_sets(texts: list[bytes], gram_words: int = GRAM_WORDS) -> Iterator[np.ndarray]:
    """Distinct hashes of the word n-grams of each text, ascending; a text of fewer words is one gram, one without words none."""
    with np.errstate(over="ignore"):
        for words in _word_hashes(texts):
            n = len(words)
            if n == 0:
                yield np.empty(0, np.uint64)
                continue
            size = min(n, gram_words)
            grams = np.full(n - size + 1, size, np.uint64)
            for k in range(size):
                grams = grams * _BASE + words[k:n - size + 1 + k]
            yield np.unique(_mixed(grams))


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [t.as_py().encode("utf-8", "surrogatepass").lower() for t in batch.column(at)]


def common_counters(texts: DataFrame, gram_words: int = GRAM_WORDS) -> np.ndarray:
    """For each counter a class: 0, or the binary logarithm of how many sets have its grams where that is far above the mean.

    Every gram of every text is counted.  A task hands its counters on in SLICES packed rows, which are added up in two steps of
    bounded groups; their sum is COUNTERS numbers whatever the input.  The classes only choose the order of grams, no result hangs on them.
    """
    width = COUNTERS // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(COUNTERS, np.uint32)
        for batch in _slices(batches):
            for grams in gram_sets(_texts(batch, 0), gram_words):
                np.add.at(counts, (grams & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        packed = [pack([counts[at:at + width]], width) for at in range(0, COUNTERS, width)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES)), pa.array([TaskContext.get().partitionId() % SLICES] * SLICES, pa.int64()),
                                          pa.array(packed, pa.binary())], ["slice", "part", "data"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for data in table.column("data"):
            total += unpack(data.as_py())[0]
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([0], pa.int64()), "data": pa.array([pack([total], width)], pa.binary())})

    schema = "slice long, part long, data binary"
    found = texts.select("text").mapInArrow(run, schema)
    for keys in (["slice", "part"], ["slice"]):
        found = found.groupBy(*keys).applyInArrow(add, schema)
    counts = np.zeros(COUNTERS, np.float64)
    for row in found.collect():
        counts[row["slice"] * width:(row["slice"] + 1) * width] = unpack(bytes(row["data"]))[0]
    mean = counts.mean()
    common = counts > mean + 6 * np.sqrt(mean) + 4
    classes = np.zeros(COUNTERS, np.uint8)
    classes[common] = np.minimum(np.log2(counts[common]), (1 << _CLASS_BITS) - 1).astype(np.uint8)
    return classes


def _ordered(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Grams as numbers whose order is the order of all sets: class first, then hash."""
    made = classes[(grams & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(63 - _CLASS_BITS) | grams >> np.uint64(1 + _CLASS_BITS)
    made.sort()
    return made


def _set_id(grams: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(_mixed(np.array([(_mixed(grams + _BASE)).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def _list(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _parities(grams: np.ndarray) -> np.ndarray:
    """BITS parities of a set: two sets differ in at least as many grams as parities."""
    counts = np.bincount((grams & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.slice(first, rows)


def _prefixes(texts: DataFrame, classes: np.ndarray, gram_words: int, percent: int) -> DataFrame:
    """(doc_id, n, id, prefix, bits): the size of each set, its hash, its first grams that can be the first of a common part, parities."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n, ids, kept, bits = [], [], [], []
            for grams in gram_sets(_texts(batch, 1), gram_words):
                grams = _ordered(grams, classes)
                n.append(len(grams))
                ids.append(_set_id(grams))
                # |common| >= percent / 100 * n, whatever the other's size
                kept.append(grams[:len(grams) - -(-percent * len(grams) // 100) + 1])
                bits.append(_parities(grams))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(ids, pa.int64()), _list(kept), _list(bits)],
                                             ["doc_id", "n", "id", "prefix", "bits"])

    return written(texts.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, id long, prefix array<long>, bits array<long>"),
                   "set-prefixes")


def _sets(texts: DataFrame, classes: np.ndarray, wanted: DataFrame, gram_words: int) -> DataFrame:
    """(id, n, grams): the texts of wanted(id, low, n), from the rows that have the id's smallest doc_id.

    A set travels as its text, which is smaller than its hashes, and is hashed where two sets meet.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            made = [_set_id(_ordered(grams, classes)) for grams in gram_sets(_texts(batch, 1), gram_words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64()), batch.column(1)], ["doc_id", "id", "grams"])

    made = (texts.select("doc_id", "text").mapInArrow(run, "doc_id long, id long, grams string")
            .join(sized(wanted), "id").where("doc_id <=> low"))
    return written(made.groupBy("id").agg(F.first("n").alias("n"), F.first("grams").alias("grams")), "sets")


def _grams_of(column: pa.Array, gram_words: int) -> Iterator[np.ndarray]:
    """The sets of a column of texts or of lists of grams; neighbours that are the same text are hashed once."""
    if not pa.types.is_string(column.type):
        for value in column:
            yield value.values.to_numpy().view(np.uint64)
        return
    texts = column.to_pylist()
    fresh = [at for at, text in enumerate(texts) if at == 0 or text != texts[at - 1]]
    made = gram_sets([texts[at].encode("utf-8", "surrogatepass").lower() for at in fresh], gram_words)
    for first, last in zip(fresh, [*fresh[1:], len(texts)]):
        grams = next(made)
        for _ in range(first, last):
            yield grams


def skipping_pairs(ids: np.ndarray, root: np.ndarray, n: np.ndarray, pos: np.ndarray, s: np.ndarray, weight: np.ndarray,
                   percent: int = PERCENT, block: int = SKIP_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one list that may link with this gram as their first common one, and lie in two components."""
    half = 2 * _weights(percent)[1]
    order = np.lexsort((pos, n))
    ids, root, n, rest, weight = ids[order], root[order], n[order], (s - pos)[order], weight[order]
    left, right = [], []
    for first in range(0, len(ids), block):
        mine = slice(first, first + block)
        most, least, largest = rest[mine].max(), weight[mine].min(), n[mine].max()
        for second in range(first, len(ids), block):
            if percent * n[second] > 100 * largest:
                break
            other = slice(second, second + block)
            if half * min(most, rest[other].max()) < least + weight[other].min():
                continue
            fits = ((half * np.minimum(rest[mine][:, None], rest[other]) >= weight[mine][:, None] + weight[other])
                    & (percent * n[other] <= 100 * n[mine][:, None]) & (root[mine][:, None] != root[other]))
            if second == first:
                fits = np.triu(fits, 1)
            x, y = np.nonzero(fits)
            left.append(ids[mine][x])
            right.append(ids[other][y])
    if not left:
        return ids[:0], ids[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def block_pairs(columns: list[np.ndarray], starts: np.ndarray, size: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs of many lists of one size, none longer than a block: place by place for all lists at once."""
    half = 2 * _weights(percent)[1]
    ids, root, n, pos, s, weight = columns
    left, right = [], []
    for i in range(size):
        for j in range(i + 1, size):
            x, y = starts + i, starts + j
            fits = ((half * np.minimum(s[x] - pos[x], s[y] - pos[y]) >= weight[x] + weight[y]) & (root[x] != root[y])
                    & (percent * np.maximum(n[x], n[y]) <= 100 * np.minimum(n[x], n[y])))
            left.append(ids[x[fits]])
            right.append(ids[y[fits]])
    if not left:
        return ids[:0], ids[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def _list_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) of lists(members)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            names = ["id", "root", "n", "pos", "s", "weight"]
            flat = [column.flatten().field(name).to_numpy().astype(np.int64) for name in names]
            offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
            sizes = np.diff(offsets)
            made = [block_pairs(flat, offsets[:-1][sizes == size], size, percent) for size in np.unique(sizes[sizes <= SKIP_BLOCK]).tolist()]
            made += [skipping_pairs(*[f[i:i + n] for f in flat], percent=percent)
                     for i, n in zip(offsets[:-1][sizes > SKIP_BLOCK].tolist(), sizes[sizes > SKIP_BLOCK].tolist())]
            a, b = (np.concatenate([m[k] for m in made]) if made else np.empty(0, np.int64) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lists.select("members").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, gram_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keep = []
            for x, y in zip(_grams_of(batch.column(2), gram_words), _grams_of(batch.column(3), gram_words)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # only the sets of these pairs move
    needed = sized(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    some = sets.select("id", "grams").join(needed, "id", "left_semi")
    x = some.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    y = some.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _near_enough(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The pairs that parities do not rule out."""
    pairs = written(pairs, "candidates")
    # only the parities of these pairs move
    needed = sized(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    some = vertices.select("id", "n", "bits").join(needed, "id", "left_semi")
    x = some.select(F.col("id").alias("a"), F.col("bits").alias("x"), "n")
    y = some.select(F.col("id").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m"))
    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda done, k: done + k)
    both = F.col("n") + F.col("m")
    return pairs.join(x, "a").join(y, "b").where((both - differ) * (100 + percent) >= 2 * percent * both).select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs in two components."""
    a = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    b = roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))


def _links_of(near: DataFrame, sets: DataFrame, gram_words: int, percent: int) -> DataFrame:
    """Links among the pairs, as many as their components need: each set's smallest partner first, then pairs still apart."""
    if near.isEmpty():
        return near
    first = written(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs")
    stars = written(_verified(first, sets, gram_words, percent), "stars")
    rest = written(_apart(near.join(first, ["a", "b"], "left_anti"), components(stars)), "rest")
    return written(stars.unionByName(_verified(rest, sets, gram_words, percent)), "links")


def _differences(long: DataFrame, held: DataFrame, half: int, gram_words: int) -> DataFrame:
    """long(cell, centre, id) -> (cell, centre, id, n, weight, common, link, grams): each member seen from its centre.

    held(cell, id, n, weight, grams) are the members of the round; the new cell is named by the old and the centre.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            weight, link, made = [], [], []
            old = batch.column(4).to_numpy()
            of_centre = batch.column(5).to_numpy()
            for at, (y, x) in enumerate(zip(_grams_of(batch.column(6), gram_words), _grams_of(batch.column(7), gram_words))):
                differs = np.setxor1d(y, x, assume_unique=True)
                # |x| + |y| - 2 * common = differs
                common = (len(x) + len(y) - len(differs)) // 2
                weight.append(int(old[at]) + 2 * half * (len(x) - common) - half * len(x))
                link.append(2 * half * common >= int(old[at]) + int(of_centre[at]))
                made.append(differs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight, pa.int64()), pa.array(link, pa.bool_()), _list(made)],
                                             ["cell", "centre", "id", "n", "weight", "link", "grams"])

    y = long.join(held, ["cell", "id"])
    x = held.select("cell", F.col("id").alias("centre"), F.col("weight").alias("of_centre"), F.col("grams").alias("from"))
    return written(y.join(x, ["cell", "centre"])
                   .select(F.xxhash64("cell", "centre").alias("cell"), "centre", "id", "n", "weight", "of_centre", "grams", "from")
                   .mapInArrow(run, "cell long, centre long, id long, n int, weight long, link boolean, grams array<long>"), "differences")


def _indexed(members: DataFrame, half: int) -> tuple[DataFrame, DataFrame]:
    """(postings, links) of members(cell, id, root, n, weight, grams): their differences, rarest of the cell first.

    A set's partner has at least the cell's least weight, and about as many differences as the set itself, so that many have to be
    common; sets that need none link with the member of the least weight.
    """
    least = written(members.groupBy("cell").agg(F.min(F.struct("weight", "id")).alias("least")), "least")
    seen = written(members.join(sized(least), "cell").select(
        "cell", "id", "root", "n", "weight", "grams", F.col("least.weight").alias("lw"), F.col("least.id").alias("least")), "members")
    links = seen.where("weight + lw <= 0 and id <> least").select(F.least("id", "least").alias("a"), F.greatest("id", "least").alias("b"))
    # two linked sets differ in (100 - percent) / (100 + percent) of their sizes' sum at most, and so do the numbers of their differences
    percent = half - 100
    apart = F.floor(F.col("n") * (100 + percent) * (100 - percent) / (percent * (100 + percent)))
    needed = F.greatest(F.ceil((F.col("weight") + F.col("lw")) / (2 * half)), F.size("order") - apart, F.lit(1))
    each = written(seen.select("cell", "id", F.explode("grams").alias("tok")), "difference-grams")
    often = each.groupBy("cell", "tok").agg(F.count("*").alias("f"))
    # a difference that one member alone has is common to none
    ranked = (each.join(often, ["cell", "tok"]).groupBy("cell", "id")
              .agg(F.sort_array(F.collect_list(F.struct("f", "tok"))).alias("order")))
    placed = seen.drop("grams").join(ranked, ["cell", "id"])
    kept = F.slice("order", F.lit(1), F.greatest(F.size("order") - needed.cast("int") + 1, F.lit(0)))
    return placed.select("cell", "id", "root", "n", "weight", F.size("order").alias("s"), F.posexplode(kept).alias("pos", "o")) \
        .where("o.f > 1").select("cell", "o.tok", "id", "root", "n", "pos", "s", "weight"), links


def _round(postings: DataFrame, percent: int, list_rows: int) -> tuple[DataFrame, DataFrame]:
    """(lists, long): lists(members) of up to `list_rows` sets, and long(cell, centre, id) of longer ones; only lists that touch two components."""
    def sizes(rows: DataFrame) -> DataFrame:
        return (rows.groupBy("cell", "tok").agg(F.count("*").alias("many"), F.min("weight").alias("least"), F.min("root").alias("low"),
                                                F.max("root").alias("high")).where("many > 1 and low < high").drop("low", "high"))

    # a set that leaves too few grams behind even for the list's least weight has no partner here
    half = 2 * _weights(percent)[1]
    fits = half * (F.col("s") - F.col("pos")) >= F.col("weight") + F.col("least")
    some = written(postings.join(sizes(postings), ["cell", "tok"]).where(fits).drop("many", "least"), "lists")
    shared = written(some.join(sizes(some), ["cell", "tok"]).where(fits).drop("least"), "shared-lists")
    lists = (shared.where(F.col("many") <= list_rows).groupBy("cell", "tok")
             .agg(F.collect_list(F.struct("id", "root", "n", "pos", "s", "weight")).alias("members")))
    long = shared.where(F.col("many") > list_rows).drop("many")
    # a set that stands in most of the long lists is the centre of them, so that a member has few centres
    often = long.groupBy("cell", "id").agg(F.count("*").alias("often"))
    centres = (long.join(often, ["cell", "id"]).groupBy("cell", "tok")
               .agg(F.max(F.struct("often", "id")).alias("best")).select("cell", "tok", F.col("best.id").alias("centre")))
    return lists, written(long.join(sized(centres), ["cell", "tok"]), "long")


def _plain_pairs(long: DataFrame, percent: int) -> DataFrame:
    """Pairs of long lists one by one, for what no centre took apart."""
    half = 2 * _weights(percent)[1]
    x, y = long.alias("x"), long.alias("y")
    fits = ((F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root"))
            & (half * F.least(F.expr("x.s - x.pos"), F.expr("y.s - y.pos")) >= F.expr("x.weight + y.weight"))
            & (percent * F.greatest("x.n", "y.n") <= 100 * F.least("x.n", "y.n")))
    return x.join(y, ["cell", "tok"]).where(fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _links(texts: DataFrame, vertices: DataFrame, classes: np.ndarray, gram_words: int, percent: int, list_rows: int, rounds: int,
           plain_pairs: int) -> DataFrame:
    """(id, root) of all linked vertices(id, n, prefix, bits, low)."""
    unit, half = _weights(percent)
    postings = vertices.select(F.lit(0).cast("long").alias("cell"), "id", F.col("id").alias("root"), "n",
                               F.posexplode("prefix").alias("pos", "tok"), F.col("n").alias("s"),
                               (F.col("n").cast("long") * unit).alias("weight"))
    lists, long = _round(postings, percent, list_rows)
    pairs = written(_near_enough(_list_pairs(lists, percent), vertices, percent), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(long.select("id")).distinct()
    wanted = written(vertices.select("id", "low", "n").join(ids, "id", "left_semi"), "wanted")
    sets = _sets(texts, classes, wanted, gram_words)
    held = sets.select(F.lit(0).cast("long").alias("cell"), "id", "n", (F.col("n").cast("long") * unit).alias("weight"), "grams")
    found = _links_of(pairs, sets, gram_words, percent)
    for left in range(rounds, -1, -1):
        size = long.groupBy("cell", "tok").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).first()["pairs"]
        if not size:
            break
        if left == 0 or size <= plain_pairs:
            pairs = written(_near_enough(_plain_pairs(long, percent), vertices, percent), "pairs")
            found = found.unionByName(_links_of(pairs, sets, gram_words, percent))
            break
        seen = _differences(written(long.select("cell", "centre", "id").distinct(), "members-of-centres"), held, half, gram_words)
        near = seen.where("link and id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
        found = written(found.unionByName(near), "links")
        roots = components(found)
        placed = seen.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        # what lies in one component has its answers
        open_cells = placed.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell")
        held = written(placed.join(sized(open_cells), "cell", "left_semi").select("cell", "id", "root", "n", "weight", "grams"), "held")
        postings, near = _indexed(held, half)
        lists, long = _round(postings, percent, list_rows)
        pairs = written(_near_enough(_list_pairs(lists, percent), vertices, percent), "pairs")
        found = written(found.unionByName(near).unionByName(_links_of(pairs, sets, gram_words, percent)), "links")
    return components(found)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS,
                       percent: int = PERCENT, list_rows: int = LIST_ROWS, rounds: int = ROUNDS, plain_pairs: int = PLAIN_PAIRS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of `docs`.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased.  component_id is the smallest doc_id that links reach, its own
    included.  A null or empty text, or one of white space, has no gram and links with nothing; one of fewer words than a gram is a single gram.  Very
    long texts are hashed in parts and are sets like any other.  Rows with equal sets are always in one component; rows without a doc_id take part, and a component
    of such rows alone has a null component_id.  Other columns are not read, an empty table gives an empty one.  Grams are told apart
    by 58 bits of a hash.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    classes = common_counters(texts, gram_words)
    rows = _prefixes(texts, classes, gram_words, percent)
    vertices = written(rows.where("n > 0").groupBy("id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"),
                                                             F.first("bits").alias("bits"), F.min("doc_id").alias("low")), "vertices")
    roots = _links(texts, vertices, classes, gram_words, percent, list_rows, rounds, plain_pairs)
    low = vertices.select("id", "low")
    # one row per linked set; a component's smallest id is a sum of few rows per task
    linked = written(roots.join(low, "id"), "linked")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    of_linked = linked.join(sized(lowest), "root").select("id", "component_id")
    of = written(low.join(of_linked, "id", "left").select("id", F.coalesce("component_id", "low").alias("component_id")), "components")
    return rows.select("doc_id", "n", "id").join(of, "id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
