"""Keyed tables: compaction, repeated batches, jobs stopped between sinks."""

import os

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import keyed
from shelfspark.operators.tables import upsert
from shelfspark.schemas import SOURCES
from shelfspark.sources import manifest

SPEC = SOURCES["mebook"]
SINK = keyed.Sink("table", SPEC.key, keyed.upserted(SPEC), 4)


def versions(spark, first, n, keys, mark):
    return spark.range(first, first + n).select(
        F.concat(F.lit("k"), F.col("id") % keys).alias("url_obj_id"), F.col("id").alias("seq"), F.concat(F.lit(mark), "id").alias("title"),
        F.col("id").alias("upload_time"), F.col("id").alias("crawl_time"), F.lit("u").alias("url"), F.lit("s").alias("source_website"),
        F.lit("pdf").alias("type"), F.when(F.col("id") % 3 > 0, F.lit("d")).alias("description"), F.lit("t").alias("tag"))


def rows(frame):
    return sorted((tuple(str(v) for v in r) for r in frame.collect()))


def parts(root):
    return {os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if f.startswith("part-") and "/base=" in d}


def test_replay_compaction_and_untouched_buckets(spark, tmp_path):
    root = str(tmp_path)
    batches = [versions(spark, 0, 200, 50, "a"), versions(spark, 200, 90, 60, "b")]
    for at, batch in enumerate(batches):
        assert keyed.commit(spark, root, at, {SINK: batch})
    whole = upsert(None, batches[0].unionByName(batches[1]), SPEC)
    assert rows(keyed.read(spark, root, SINK).select(whole.columns)) == rows(whole)
    version = keyed.compact(spark, root, [SINK])
    assert keyed.deltas(spark, root, SINK) == 0
    assert rows(keyed.read(spark, root, SINK).select(whole.columns)) == rows(whole)
    # a merge without deltas changes nothing
    before = parts(root)
    assert keyed.compact(spark, root, [SINK]) == version and parts(root) == before
    # one key touches one bucket
    one = versions(spark, 1000, 1, 50, "c")
    keyed.commit(spark, root, 2, {SINK: one})
    keyed.compact(spark, root, [SINK])
    named = {e["path"] for e in manifest.entries(spark, root) if e["kind"] == "base"}
    assert sum(f"base=v{version}/" in p for p in named) == len(named) - 1
    whole = upsert(None, batches[0].unionByName(batches[1]).unionByName(one), SPEC)
    assert rows(keyed.read(spark, root, SINK).select(whole.columns)) == rows(whole)
    # a batch that comes again, before or after its compaction, is there already
    assert not keyed.commit(spark, root, 2, {SINK: versions(spark, 5000, 5, 50, "z")})
    assert keyed.applied(spark, root) == 2


def test_both_sinks_or_none(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    index = keyed.Sink("index", "doc_id", keyed.replaced("doc_id"), 2)

    def batch(n, mark):
        rows_ = versions(spark, n, 10, 6, mark)
        return {index: rows_.select(F.col("url_obj_id").alias("doc_id"), "title", "seq"), SINK: rows_}

    def state():
        return rows(keyed.read(spark, root, index)), rows(keyed.read(spark, root, SINK))
    keyed.commit(spark, root, 0, batch(0, "a"))
    before = state()
    real = keyed._write
    for stop_after in (1, 2):
        done = []

        def stopping(*args):
            if len(done) == stop_after:
                raise IOError("stopped")
            real(*args)
            done.append(args)
        monkeypatch.setattr(keyed, "_write", stopping)
        if stop_after == 2:
            monkeypatch.setattr(keyed, "_write", real)
            monkeypatch.setattr(manifest, "publish", lambda *a: (_ for _ in ()).throw(IOError("stopped")))
        with pytest.raises(IOError):
            keyed.commit(spark, root, 1, batch(10, "b"))
        assert state() == before
    monkeypatch.undo()
    assert keyed.commit(spark, root, 1, batch(10, "b"))
    after = state()
    assert after != before and not keyed.commit(spark, root, 1, batch(10, "b")) and state() == after
    keyed.compact(spark, root, [index, SINK])
    assert state() == after


def test_sums_empty_batches_and_unknown_sinks(spark, tmp_path):
    root = str(tmp_path)
    scores = keyed.Sink("scores", "keyword", keyed.summed("keyword", "score"), 2)
    with pytest.raises(ValueError):
        keyed.read(spark, root, scores)
    frame = spark.createDataFrame([("a", 5), ("b", 5), ("a", 10)], "keyword string, score long")
    keyed.commit(spark, root, 0, {scores: frame.limit(0)})
    assert keyed.read(spark, root, scores).count() == 0
    keyed.compact(spark, root, [scores])
    for at in (1, 2, 3):
        keyed.commit(spark, root, at, {scores: frame})
        if at == 2:
            keyed.compact(spark, root, [scores])
    assert rows(keyed.read(spark, root, scores)) == [("a", "45"), ("b", "15")]
