"""Conform, upsert, replace, delete, histories."""

import random

from pyspark.sql import functions as F

from shelfspark.operators import ranking, records, tables
from shelfspark.schemas import SOURCES, T_ISHARE, XICI_IP, SourceSpec


def test_upsert_keeps_first_and_takes_last(spark):
    rows = spark.createDataFrame([("k", 5, "u1", 0), ("k", None, "u2", 1)],
                                 "url_obj_id string, read_num int, url string, seq bigint")
    got = tables.upsert(None, rows, SOURCES["ishare"]).collect()
    assert [(r.read_num, r.url) for r in got] == [(None, "u1")]


def replay(existing, rows, update):
    table = {r["key"]: dict(r) for r in existing}
    for r in sorted(rows, key=lambda r: r["seq"]):
        if r["key"] in table:
            table[r["key"]].update({c: r[c] for c in update})
        else:
            table[r["key"]] = {c: r[c] for c in ("key", "a", "b")}
    return [(r["key"], r["a"], r["b"]) for r in table.values()]


def test_upsert_equals_a_replay_and_is_idempotent(spark):
    rng = random.Random(11)
    spec = SourceSpec("s", "d", (), "key", ("a",))
    order = lambda rows: sorted((r["key"], r["a"] or -1, r["b"] or -1) for r in rows)
    for size in (1, 60, 300):
        # one key holds a third of the rows
        rows = [{"key": "hot" if rng.random() < 0.34 else f"k{rng.randint(0, 20)}",
                 "a": rng.choice([None, rng.randint(0, 9)]), "b": rng.choice([None, rng.randint(0, 9)]),
                 "seq": i} for i in range(size)]
        existing = [{"key": "hot", "a": 1, "b": 2}, {"key": "old", "a": 3, "b": None}]
        new = spark.createDataFrame(rows, "key string, a int, b int, seq bigint")
        old = spark.createDataFrame(existing, "key string, a int, b int")
        merged = tables.upsert(old, new.repartition(3), spec)
        got = [r.asDict() for r in merged.collect()]
        want = [dict(zip(("key", "a", "b"), r)) for r in replay(existing, rows, ["a"])]
        assert order(got) == order(want)
        again = tables.upsert(merged, new, spec)
        assert order([r.asDict() for r in again.collect()]) == order(got)


def test_conform_names_each_fault(spark):
    rows = [("k1", "t", "7", "pdf"), (None, "t", "x", "pdf"), ("k3", "t" * 256, "1", "toolong")]
    df = spark.createDataFrame(rows, "url_obj_id string, title string, load_num string, type string")
    tagged = tables.conform(df, T_ISHARE)
    got = {r.title[:2]: r.reject for r in tagged.filter("url_obj_id is null or url_obj_id <> 'k1'").collect()}
    assert got == {"t": "null:url_obj_id;type:load_num", "tt": "long:title;long:type"}
    good = tables.accepted(tagged).collect()
    assert len(good) == 1 and (good[0].load_num, good[0].upload_time, str(good[0].size)) == (7, 0, "0.00")
    assert tables.rejected(tagged).count() == 2


def test_missing_live_time_is_refused(spark):
    df = spark.createDataFrame([("1.1.1.1", "80", None)], "ip string, port string, live_time bigint")
    row = tables.conform(df, XICI_IP).first()
    assert (row.type, row.speed, row.reject) == ("http", 0.0, "null:live_time")


def test_replace_and_delete(spark):
    df = spark.createDataFrame([("d", "a", 1), ("d", None, 2), ("e", "b", 1)], "doc_id string, t string, seq int")
    assert sorted((r.doc_id, r.t) for r in tables.replace_by_id(df).collect()) == [("d", None), ("e", "b")]
    left = tables.delete_by_key(df, spark.createDataFrame([("d",), ("d",)], "doc_id string"), "doc_id")
    assert [r.doc_id for r in left.collect()] == ["e"]


def test_random_pick_is_repeatable_and_moves_with_the_seed(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("ip"))
    picks = {seed: records.random_pick(df, "ip", seed).first().ip for seed in "abcdef"}
    assert len(set(picks.values())) > 1
    assert records.random_pick(df.repartition(7), "ip", "a").first().ip == picks["a"]


def test_histories(spark):
    words = ["aa", "bb", "aa", "z", "bb"]
    log = spark.createDataFrame([(1, w, i) for i, w in enumerate(words)], "user_id int, keyword string, s int")
    log = log.select("user_id", "keyword", F.timestamp_seconds(F.col("s") * 4000).alias("ts"))
    first = ranking.first_seen_history(log).orderBy("rank").collect()
    assert [r.keyword for r in first] == ["aa", "bb", "z"]
    assert [r.keyword for r in ranking.recent_searches(log).orderBy("rank").collect()] == ["bb", "aa"]
    early = log.filter(F.unix_seconds("ts") < 16000)
    assert [r.keyword for r in ranking.recent_searches(early).orderBy("rank").collect()] == ["aa", "bb"]


def test_scores_and_ties(spark):
    log = spark.createDataFrame([(k,) for k in ["b", "a", "b", "a", "c", ""]], "keyword string")
    top = ranking.hot_keywords(ranking.keyword_scores(log), 3).collect()
    assert [(r.keyword, r.score) for r in top] == [("b", 10), ("a", 10), ("c", 5)]
    assert ranking.keyword_scores(log, min_length=1).count() == 3


def test_records_of_the_fourth_site(spark):
    hits = spark.createDataFrame(
        [("http://w/1", ["名"], ["/d"], ["作者：某人", "分类：史", "x", "y", "intro"]),
         ("http://w/2", [], [], [])],
        "url string, name array<string>, download_url array<string>, info array<string>")
    got = records.build_ireadweek(hits, 5).orderBy("url").collect()
    assert (got[0].author, got[0].category, got[0].introduction, got[0].title) == ("某人", "史", "intro", "名")
    assert got[1].author is None and got[1].title is None


def test_book_blog_needs_the_download_label(spark):
    rows = [("u1", ["《a》pdf"], ["<p>内容简介 下载地址</p>"]), ("u2", ["b"], ["<p>内容简介</p>"]), ("u3", ["c"], [])]
    hits = spark.createDataFrame(rows, "url string, title array<string>, description array<string>")
    hits = hits.withColumn("upload_time", F.array(F.lit("2018年11月2日"))).withColumn("tag", F.array(F.lit("t")))
    got = records.build_mebook(hits, 5).collect()
    assert [(r.url, r.type, r.upload_time, r.description) for r in got] == [
        ("u1", "pdf", 1541116800000, "内容简介 下载地址")]
