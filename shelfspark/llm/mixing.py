"""Mixing sources to target weights: budgets down a tree, documents by seeded epochs.

A token budget is handed from the root to the leaves of a tree of columns, such as domain, language and
source.  Every node can give at most `max_epochs` times its tokens.  A node's budget is shared
among its children by weight; what a child cannot give goes to its siblings, and only
what the whole family cannot give goes to the level above.  Since a family's capacity is known
before it gets its budget, one pass from the top does both.

Everything is DataFrame functions.  No window spans a leaf's documents: running sums are
taken over hash buckets, and over the documents of the one bucket in which the budget ends.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import text_or_empty, written

MAX_EPOCHS = 4
SEED = 42
# hex digits of the order key that name a bucket: 4,096 buckets a leaf
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    picked = F.lit(1)
    for name, weight in weights.items():
        picked = F.when(F.col(level) == name, F.lit(weight)).otherwise(picked)
    return picked.cast("long")


def share(nodes: DataFrame, family: Sequence[str], name: str) -> DataFrame:
    """nodes(family..., name, w, cap, budget) with `given`: the family's budget by weight, filled up to each cap.

    Children are filled in the order of cap / w, so those that are full come first; the
    others share the rest by weight, rounded down to whole tokens.
    """
    big = lambda c: F.col(c).cast("decimal(19,0)")
    keys = [F.col(c) for c in family] or [F.lit(1)]
    order = Window.partitionBy(*keys).orderBy(F.col("cap").cast("double") / F.col("w"), name)
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    return (nodes.where("w > 0")
            .withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0)))
            .withColumn("w_left", F.sum("w").over(onward))
            .withColumn("full", big("cap") * big("w_left")
                        <= (F.col("budget") - F.col("filled")).cast("decimal(19,0)") * big("w"))
            .withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
            .withColumn("w_rest", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
            .withColumn("product", F.col("rest").cast("decimal(19,0)") * big("w"))
            .withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("product div w_rest")))
            .drop("filled", "w_left", "full", "rest", "w_rest", "product"))


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]],
                 target: Column, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves(levels..., tokens) with `budget`; `target` is the root's budget, an expression over `total` tokens."""
    capped = leaves
    for level in levels:
        capped = capped.withColumn(f"w_{level}", _weight(level, weights.get(level, {})))
    # a weight of 0 anywhere on the path closes the leaf
    open_path = F.least(*[F.col(f"w_{level}") for level in levels]) if len(levels) > 1 else F.col(f"w_{levels[0]}")
    capped = capped.withColumn("cap", F.when(open_path > 0, F.col("tokens") * max_epochs).otherwise(F.lit(0)))
    whole = capped.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"))
    root = whole.select(F.least(target.cast("long"), F.col("cap")).alias("budget"))
    # the root is one row
    parents, family = root, []
    for level in levels:
        nodes = (capped.groupBy(*family, level).agg(F.sum("cap").alias("cap"), F.first(f"w_{level}").alias("w")))
        joined = nodes.join(parents, family) if family else nodes.join(F.broadcast(parents))
        parents = share(joined, family, level).select(*family, level, F.col("given").alias("budget"))
        family = [*family, level]
    return leaves.join(parents, family)


def select_documents(docs: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], target: Column,
                     max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, levels..., n_tokens, copies) of the documents that the mixture takes.

    docs(id_col, levels..., n_tokens).  A leaf's budget is its whole tokens so many times (the
    full epochs) and a rest; the rest takes the documents of one more epoch in the order of a seeded
    hash of their ids, from the first until the rest is reached.  The document that
    crosses it is taken whole.  Null level names count as the empty name; rows with one id
    (or none) in a leaf stand at one place in the order, and are taken together.
    Documents without tokens take no budget; they come with every full epoch, and with
    the rest where their place is reached.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
                        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels])
    rows = written(named, "mixing-rows")
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, levels, weights, target, max_epochs).where("tokens > 0 and budget > 0")
    plan = written(budgets.select(*levels, F.expr("budget div tokens").alias("epochs"),
                                  F.expr("budget % tokens").alias("rest")), "leaf-plan")
    order_key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"),
                                  F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = rows.join(plan, list(levels)).withColumn("key", order_key) \
        .withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    along = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (placed.groupBy(*levels, "rest", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
            .withColumn("before", F.coalesce(F.sum("in_bucket").over(along), F.lit(0)))
            .where("before < rest and before + in_bucket >= rest")
            .select(*levels, F.col("bucket").alias("last_bucket"), "before"))
    marked = placed.join(written(ends, "leaf-ends"), list(levels), "left")
    inside = Window.partitionBy(*levels, "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*levels, "bucket", "key")
    last = (marked.where("bucket = last_bucket")
            .withColumn("start", F.col("before") + F.sum("n_tokens").over(inside) - F.sum("n_tokens").over(same))
            .withColumn("copies", F.col("epochs") + (F.col("start") < F.col("rest")).cast("long")))
    others = marked.where("last_bucket is null or bucket <> last_bucket").withColumn(
        "copies", F.col("epochs") + F.coalesce(F.col("bucket") < F.col("last_bucket"), F.lit(False)).cast("long"))
    out = ["doc_id", *levels, "n_tokens", "copies"]
    return last.select(*out).unionByName(others.select(*out)).where("copies > 0")


def mixed_documents(docs: DataFrame, levels_of: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], target: Column,
                    max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of `docs` as often as the mixture takes them; `levels_of` names the tree's columns from the root down."""
    levels = list(levels_of)
    slim = docs.select("doc_id", *[column.alias(name) for name, column in levels_of.items()],
                       word_count(text_or_empty()).alias("n_tokens"))
    taken = select_documents(slim, levels, weights, target, max_epochs, seed)
    # rows with one id and different texts or leaves each have their own number of copies
    taken = taken.groupBy("doc_id", "n_tokens", *levels).agg(F.max("copies").alias("copies"))
    names = [f"_{c}" for c in (*levels, "n_tokens")]
    left = docs.select("*", *[F.coalesce(column.cast("string"), F.lit("")).alias(f"_{name}") for name, column in levels_of.items()],
                       word_count(text_or_empty()).alias("_n_tokens"))
    right = taken.select(F.col("doc_id").alias("_doc_id"), *[F.col(c[1:]).alias(f"_t{c}") for c in names], "copies")
    match = left["doc_id"].eqNullSafe(right["_doc_id"])
    for c in names:
        match = match & (left[c] == right[f"_t{c}"])
    return (left.join(right, match).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select(*docs.columns))
