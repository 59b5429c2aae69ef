"""Running jobs: same result as in one go, also after a restart."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import urls
from shelfspark.operators import keyed, ranking
from shelfspark.operators.extract import extract_fields
from shelfspark.operators.records import build_ishare
from shelfspark.operators.tables import accepted, conform, current_index, current_table, read_sink, upsert
from shelfspark.plans.record_plans import site_pages
from shelfspark.plans import ranking_plans
from shelfspark.schemas import PAGES, SOURCES
from shelfspark.sources.pages import stream_files
from shelfspark.streaming import jobs


def test_published_ingest_compacts_and_equals_one_upsert(spark, feed, tmp_path):
    folder, add = feed
    root, spec = str(tmp_path / "published"), SOURCES["ishare"]
    sinks = keyed.site_sinks(spec, 2)
    html, schema, seen = "<h1>{0}</h1><article>x</article>", "page_id bigint, url string, html string", []
    for at, part in enumerate(([(0, "http://a/1", html.format("one")), (10, "http://a/2", html.format("two"))],
                               [(12, "http://a/1", html.format("three"))], [(14, "http://a/3", html.format("x" * 300)), (17, None, "")])):
        seen += part
        add(spark.createDataFrame(part, schema))
        pages = site_pages(stream_files(spark, folder, PAGES), spec.site)
        jobs.start_published_ingest(pages, spec, root, now=7, compact_every=2, buckets=2).awaitTermination()
        assert keyed.deltas(spark, root, sinks[1]) == (1, 0, 1)[at]
    records = build_ishare(extract_fields(site_pages(spark.createDataFrame(seen, schema), spec.site), spec.fields), 7, keep=("page_id",))
    want = upsert(None, accepted(conform(records.withColumnRenamed("page_id", "seq"), spec.rules, keep=["seq"])).filter("url_obj_id is not null"), spec)
    index, table, rejects = (keyed.read(spark, root, sink) for sink in sinks)
    assert rows(table.select(want.columns)) == rows(want) and table.count() == 2
    assert index.count() == 3 and rejects.count() == 2


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def feed(tmp_path):
    """Write parts of a table into a folder, one file each."""
    folder = str(tmp_path / "in")

    def add(df):
        df.coalesce(1).write.mode("append").parquet(folder)
    return folder, add


def test_keyword_scores_restart(spark, feed, tmp_path):
    folder, add = feed
    root = str(tmp_path / "scores")
    parts = [["a", "b", "a"], ["b"], ["c", "a"]]
    log = []
    for part in parts:
        log += part
        add(spark.createDataFrame([(k,) for k in part], "keyword string"))
        jobs.start_keyword_scores(stream_files(spark, folder, spark.read.parquet(folder).schema), root).awaitTermination()
        batch = ranking.keyword_scores(spark.createDataFrame([(k,) for k in log], "keyword string"))
        assert rows(jobs.read_keyword_scores(spark, root)) == rows(batch)


def test_new_links_restart(spark, feed, tmp_path):
    folder, add = feed
    root = str(tmp_path / "links")
    seen = spark.createDataFrame([("s",)], "url string").select(urls.fingerprint(F.col("url")).alias("fingerprint"))
    for part in (["a", "b", "a", "s"], ["b", "c"], ["a"]):
        add(spark.createDataFrame([(u,) for u in part], "url string"))
        links = stream_files(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
        jobs.start_new_links(links, root, seen).awaitTermination()
    assert sorted(r.url for r in jobs.read_new_links(spark, root).collect()) == ["a", "b", "c"]


def test_ingest_equals_batch_upsert(spark, feed, tmp_path):
    folder, add = feed
    root, spec = str(tmp_path / "ingest"), SOURCES["ishare"]
    html = "<h1>{0}</h1><article>x</article><a href=\"/q\">{0}</a>"
    first = [(0, "http://a/1", html.format("one")), (10, "http://a/2", html.format("two"))]
    second = [(2, "http://a/1", html.format("three")), (4, "http://a/3", html.format("x" * 300)), (7, None, "")]
    schema = "page_id bigint, url string, html string"
    for part in (first, second):
        add(spark.createDataFrame(part, schema))
        pages = site_pages(stream_files(spark, folder, PAGES), spec.site)
        jobs.start_ingest(pages, spec, root, now=7).awaitTermination()
    all_pages = site_pages(spark.createDataFrame(first + second, schema), spec.site)
    records = build_ishare(extract_fields(all_pages, spec.fields), 7, keep=("page_id",))
    good = accepted(conform(records.withColumnRenamed("page_id", "seq"), spec.rules, keep=["seq"]))
    want = upsert(None, good, spec)
    got = current_table(spark, root, spec)
    assert rows(got) == rows(want.select(*got.columns)) and got.count() == 2
    assert {r.title for r in got.collect()} == {"three.v2.epub", "two"}
    # the long title breaks a table rule only; the page without an address reaches no sink
    assert current_index(spark, root, spec).count() == 3
    faults = {r.seq: (r.reject, r.sink) for r in read_sink(spark, root, spec, "rejects").collect()}
    assert faults[4] == ("long:title", "table") and faults[7][1] == "index"


@pytest.mark.parametrize("name", ["stream_new_links", "stream_ingest", "stream_hot_keywords"])
def test_stream_queries_read_a_table_of_part_files(spark, tmp_path, name):
    pages = spark.createDataFrame([(i, f"http://a.com/{i}", f"<h1>t{i}</h1><article>x</article><a href='/x{i % 3}'>x</a>") for i in range(8)],
                                  "page_id bigint, url string, html string")
    events = spark.createDataFrame([(i, f'{{"k": "w{i % 3}"}}') for i in range(8)], "user_id bigint, props string")
    for folder, parts in (("one", 1), ("many", 4)):
        for table, df in (("pages", pages), ("events", events)):
            to = tmp_path / folder / f"{table}.parquet"
            if parts == 1:
                written = tmp_path / f"{table}-written"
                df.coalesce(1).write.parquet(str(written))
                to.parent.mkdir(exist_ok=True)
                next(written.glob("part-*.parquet")).rename(to)
            else:
                df.repartition(parts).write.parquet(str(to))
    one, many = (rows(ranking_plans.QUERIES[name](spark, str(tmp_path / folder))) for folder in ("one", "many"))
    assert one and one == many
