"""Search and suggestions against brute force on small corpora."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import index as indexing
from shelfspark.operators import search, suggest
from shelfspark.operators.index import B, K1

FIELDS = {"title": "fine", "tag": "fine"}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    rows = []
    for doc in range(n):
        title = rng.choices(words, weights, k=rng.randint(0, 12))
        if rng.random() < 0.4:
            title.append("hot")
        rows.append((doc, " ".join(title), " ".join(rng.choices(words[:10], k=rng.randint(0, 3)))))
    queries = [(q, " ".join(rng.choices(words, k=rng.randint(1, 8)) + ["hot"] * rng.randint(0, 2)))
               for q in range(25)]
    return rows, queries + [(97, "hot"), (98, "unknown"), (99, "")]


def ranking(rows, queries, fields):
    """BM25 by the book: sum over words, best field, rounded, ties by id."""
    docs = {f: {r[0]: r[1 + i].split() for r in rows if r[1 + i]} for i, f in enumerate(("title", "tag"))}
    out = {}
    for query_id, text in queries:
        best = {}
        for f in fields:
            avg = sum(map(len, docs[f].values())) / len(docs[f])
            for doc, tokens in docs[f].items():
                tf, total = Counter(tokens), 0.0
                for term, qtf in Counter(text.split()).items():
                    if tf[term]:
                        df = sum(term in t for t in docs[f].values())
                        idf = math.log(1 + (len(docs[f]) - df + 0.5) / (df + 0.5))
                        total += qtf * idf * tf[term] * (K1 + 1) / (
                            tf[term] + K1 * (1 - B + B * len(tokens) / avg))
                if total:
                    best[doc] = max(best.get(doc, 0), total)
        out[query_id] = sorted(((-round(s, 6), d) for d, s in best.items()))
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows, queries = corpus(2, 150)
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, tag string").withColumn("url", F.lit("u"))
    index = indexing.write_index(docs, FIELDS, str(tmp_path_factory.mktemp("index")), ["title", "tag", "url"], 4)
    return rows, queries, index


def pages_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], -r.score, r.doc_id))
    return {q: [(s, d) for _, s, d in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("plain_pairs", [0, 10**9])
@pytest.mark.parametrize("fields", [("title",), ("title", "tag")])
def test_search_equals_brute_force(spark, built, fields, plain_pairs, monkeypatch):
    rows, queries, index = built
    if plain_pairs == 0:
        monkeypatch.setattr("shelfspark.session.BROADCAST_ROWS", 0)
    want = ranking(rows, queries, fields)
    df = spark.createDataFrame(queries, "query_id bigint, text string")
    for size in (3, 10):
        got = pages_of(search.search(df, index, fields, size=size, plain_pairs=plain_pairs))
        assert set(got) == {q for q, hits in want.items() if hits}
        for q, hits in got.items():
            assert [d for _, d in hits] == [d for _, d in want[q][:size]]
            assert all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(hits, want[q]))


def test_pages_join_to_the_full_ranking(spark, built):
    rows, queries, index = built
    want = ranking(rows, queries, ("title",))[97]
    seen = []
    for page in range(1, 9):
        hits = search.search_one("hot", index, ("title",), page).collect()
        assert [r["rank"] for r in hits] == list(range(10 * page - 9, 10 * page - 9 + len(hits)))
        seen += [r.doc_id for r in hits]
    assert seen == [d for _, d in want] and len(seen) > 40


def test_totals(spark, built):
    rows, queries, index = built
    want = {q: len(hits) for q, hits in ranking(rows, queries, ("title", "tag")).items()}
    df = spark.createDataFrame(queries, "query_id bigint, text string")
    got = search.total_hits(df, index, ("title", "tag")).collect()
    assert {r.query_id: r.total for r in got} == want
    assert all(r.pages == math.ceil(r.total / 10) for r in got)


def test_shown_hits(spark, built):
    rows, queries, index = built
    df = spark.createDataFrame([(1, "hot w1")], "query_id bigint, text string")
    shown = search.show_hits(search.search(df, index, ("title",)), df, index).collect()
    titles = {r[0]: r[1] for r in rows}
    assert len(shown) == 10
    for r in shown:
        plain = r.title.replace(search.PRE_TAG, "").replace(search.POST_TAG, "")
        assert plain == titles[r.doc_id] and search.PRE_TAG in r.title


def test_search_plan(spark, built):
    """No Python, no pairs without a key, no window over everything."""
    _, queries, index = built
    df = spark.createDataFrame(queries, "query_id bigint, text string")
    for pairs in (0, 10**9):
        plan = search.search(df, index, ("title",), plain_pairs=pairs)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "Python" not in plan and "SinglePartition" not in plan.split("== Physical Plan ==")[1]
    from shelfspark.operators.ranking import hot_keywords
    top = hot_keywords(spark.createDataFrame([("a", 1)], "keyword string, score bigint"))
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().toString()


def near(a, b):
    if a == b:
        return 0
    if a[:1] != b[:1] or abs(len(a) - len(b)) > 1:
        return None
    if len(a) == len(b):
        diff = [i for i in range(len(a)) if a[i] != b[i]]
        swap = len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]
        return 1 if len(diff) == 1 or swap else None
    short, long = sorted((a, b), key=len)
    return 1 if any(long[:i] + long[i + 1:] == short for i in range(1, len(long))) else None


def complete(docs, typed, fuzzy, size):
    found = {}
    for doc, title, inputs in docs:
        for words, weight in inputs:
            for word in words:
                dist = [near(typed, word[:n]) for n in range(1, len(word) + 1)]
                dist = [d for d in dist if d == 0 or (fuzzy and d == 1 and len(typed) >= 3)]
                if dist:
                    key = (-weight, min(dist), title, doc)
                    found[doc] = min(found.get(doc, key), key)
    return [(k[3], -k[0], k[1]) for k in sorted(found.values())[:size]]


@pytest.mark.parametrize("seed", [1, 2])
def test_suggestions_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(30)] + ["a" * 60, "b" * 51, "ab" * 100]
    docs = [(d, f"t{rng.randint(0, 9)}", [(rng.sample(vocab, rng.randint(1, 3)), 10), (rng.sample(vocab, 2), 7)])
            for d in range(60)]
    typed = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    typed += ["Ab", "a" * 50, "a" * 51, "", "b" * 51, "b" * 50, "ab" * 99 + "b", "ab" * 100, "a" * 5000]
    schema = "doc_id bigint, title string, suggest array<struct<input:array<string>,weight:int>>"
    completed = suggest.completions(spark.createDataFrame(docs, schema), size=4)
    queries = spark.createDataFrame(list(enumerate(typed)), "query_id int, text string")
    for fuzzy in (False, True):
        run = suggest.suggest_fuzzy if fuzzy else suggest.suggest_prefix
        got = {}
        for r in run(queries, completed, size=4).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.weight, r.distance if fuzzy else 0))
        for q, text in enumerate(typed):
            assert got.get(q, []) == complete(docs, text.lower(), fuzzy, 4), (text, fuzzy)


def test_no_more_suggestions_than_kept(spark):
    docs = spark.createDataFrame([(1, "t", [(["word"], 10)])],
                                 "doc_id bigint, title string, suggest array<struct<input:array<string>,weight:int>>")
    queries = spark.createDataFrame([(1, "wo")], "query_id int, text string")
    for run in (suggest.suggest_prefix, suggest.suggest_fuzzy):
        with pytest.raises(ValueError):
            run(queries, suggest.completions(docs, size=4), size=5)


def test_pages_of_any_depth(spark, tmp_path):
    """A page number near the integer limit empties its own query and no other."""
    docs = spark.createDataFrame([(f"d{i:03}", f"red book {i}") for i in range(60)], "doc_id string, title string")
    index = indexing.write_index(docs, {"title": "fine"}, str(tmp_path / "i"), ["title"], buckets=2)
    pages = {1: "1", 2: "2", 3: "2147483647", 4: "50", 5: "99999999999", 6: None, 7: "6"}
    df = spark.createDataFrame([(q, "red", p) for q, p in pages.items()], "query_id bigint, text string, page string")
    got = {}
    for r in search.search(df, index, ("title",)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    ids = [f"d{i:03}" for i in range(60)]
    first = list(zip(range(1, 11), ids))
    assert got == {1: first, 5: first, 6: first, 2: list(zip(range(11, 21), ids[10:20])), 7: list(zip(range(51, 61), ids[50:]))}
    totals = search.total_hits(df, index, ("title",)).collect()
    assert {r.total for r in totals} == {60}


def test_typing_distance(spark):
    cases = [("wigd", "widg", 1), ("midg", "widg", None), ("widg", "widg", 0), ("wdg", "widg", 1),
             ("widxg", "widg", 1), ("iwdg", "widg", None), ("wiabdg", "widg", None), ("读书人", "读人书", 1)]
    df = spark.createDataFrame(cases, "a string, b string, want int")
    got = df.select("a", "want", suggest.typing_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == r.want for r in got)


def test_json_titles(spark):
    df = spark.createDataFrame([(1, 2, 'b"'), (1, 1, "a")], "query_id int, rank int, title string")
    assert suggest.titles_json(df).first().titles == '["a","b\\""]'


def test_passages_cover_the_text_and_end_with_sentences(spark):
    from shelfspark.functions.analysis import passages
    texts = ["One. Two is here! Three?\nFour", "", None, "x" * 95, "word " * 30, "no end " * 3 + ". Last one here.", "短い。文です！" * 10]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in frame.select("t", passages(F.col("t"), 30).alias("p")).collect():
        assert "".join(row.p) == (row.t or "") and all(0 < len(p) <= 30 for p in row.p)
    one = frame.filter("i = 0").select(passages(F.col("t"), 14).alias("p")).first().p
    assert one == ["One. ", "Two is here! ", "Three?\nFour"]


def test_fragments_prefer_several_words_and_fall_back_to_the_text(spark):
    from shelfspark.operators.index import write_index
    from shelfspark.operators.search import highlight_fragments, search
    from shelfspark.session import scratch_path
    docs = spark.createDataFrame([
        (1, "t", "Nothing is said here at all, it goes on for a while. " * 3 + "The apple stands alone in this sentence of its own, more or less. "
            + "An apple and a pear meet here, which counts for more than one of them would do. " + "pear. " * 30),
        (2, "apple", "No such fruit in this one.")], "doc_id long, title string, description string")
    index = write_index(docs, {"title": "fine", "description": "fine"}, scratch_path(spark, "fragments"), ["title"], buckets=2)
    queries = spark.createDataFrame([(1, "apple pear")], "query_id long, text string")
    hits = search(queries, index, ["title", "description"])
    rows = {r.doc_id: r for r in highlight_fragments(hits, queries, index, docs, "description", most=1).collect()}
    assert rows[1].n_fragments == 1 and rows[1].description.startswith('An <span class="keyWord">apple</span> and a <span')
    assert rows[2].n_fragments == 0 and rows[2].description == "No such fruit in this one."


def test_history_ranks_inside_one_instant_of_one_user(spark):
    from shelfspark.operators.ranking import first_seen_history
    # a third of all searches are one user's in one hour, many at one time
    log = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("user_id"),
                                   F.concat(F.lit("k"), F.col("id") % 900).alias("keyword"),
                                   F.timestamp_seconds((F.col("id") % 5) * 60).alias("ts"))
    rows = first_seen_history(log, ranges=12).collect()
    want = {}
    for r in log.collect():
        key = r.user_id, r.keyword
        want[key] = min(want.get(key, r.ts), r.ts)
    users = {}
    for (user, keyword), ts in sorted(want.items(), key=lambda x: (x[1], x[0][1])):
        users.setdefault(user, []).append(keyword)
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.user_id, []).append(r.keyword)
    assert got == users and sorted(r["rank"] for r in rows if r.user_id == 7) == list(range(1, len(users[7]) + 1))


def test_walk_of_many_levels_keeps_its_plan(spark):
    from shelfspark.operators import links
    chain = spark.range(40).select(F.concat(F.lit("p"), "id").alias("src_url"), F.concat(F.lit("p"), F.col("id") + 1).alias("dst_url"), F.lit("next").alias("route"))
    back = spark.createDataFrame([("p20", "p3", "next"), ("p5", "q", "other")], chain.schema)
    seeds = spark.createDataFrame([("p0",), ("p0",)], "url string")
    out = links.walk_frontier(seeds, chain.unionByName(back), ["next"], repeat_last=True, buckets=8)
    assert {r.url: r.depth for r in out.collect()} == {f"p{i}": i for i in range(41)}
    # one scan of the visited pages, whatever the depth
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_pairs_are_added_up_where_postings_are_dealt_by_document(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} w{i % 7}") for i in range(200)], "doc_id bigint, title string")
    index = indexing.write_index(docs, {"title": "fine"}, str(tmp_path / "dealt"), stored=["title"], buckets=2)
    queries = spark.createDataFrame([(i, f"w{i % 4} w{i % 6}") for i in range(20)], "query_id bigint, text string")
    terms = search._weighted_terms(queries, index, ["title"], "fine")
    monkeypatch.setattr(search, "PAIRS_A_TASK", 50)
    dealt, plain = search._postings_by_document(terms, index), search._postings_of(terms, index)
    pairs = plain.count()
    assert dealt.rdd.getNumPartitions() >= pairs // 50 > 8
    parts = dealt.select("query_id", "doc_id", F.spark_partition_id().alias("part"))
    assert parts.select("doc_id", "part").distinct().count() == parts.select("doc_id").distinct().count()
    assert sorted(map(tuple, dealt.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    hits = search.search(queries, index, ["title"])
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, search.search(queries, index, ["title"]).collect()))


def test_many_queries_are_asked_in_groups_and_equal_ones_once(spark, built, monkeypatch):
    """More terms than one broadcast: no word meets all its queries in one task; queries that ask the same are ranked once."""
    rows, queries, index = built
    asked, plain = [], []
    score, by_word = search.score, search._postings_of

    def counting(some, *rest):
        asked.append(some.count())
        return score(some, *rest)

    def seen(*args, **kwargs):
        plain.append(args)
        return by_word(*args, **kwargs)

    monkeypatch.setattr(search, "score", counting)
    monkeypatch.setattr(search, "_postings_of", seen)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 60)
    again = [(100 + q, text) for q, text in queries]
    # two rows of one id are one query of both texts; an unnamed one has no hits
    mixed = [(300, "hot w1"), (300, "hot w2"), (301, "w3"), (301, "w3"), (None, "hot")]
    df = spark.createDataFrame(queries + again + mixed, "query_id bigint, text string")
    got = pages_of(search.search(df, index, ("title", "tag"), size=10).distinct())
    want = ranking(rows, queries, ("title", "tag"))
    for q, text in queries:
        assert got.get(q, []) == got.get(100 + q, []) == want[q][:10]
    assert set(got) == {q for q in want if want[q]} | {100 + q for q in want if want[q]} | {300, 301}
    assert asked == [len(set(t for _, t in queries)) + 4] and not plain
