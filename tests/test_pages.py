"""Extraction, links and walks on small pages."""

import os
import subprocess
import sys
import time

import pyarrow as pa
from pyspark.sql import functions as F

from shelfspark.functions import text
from shelfspark.operators import extract, links
from shelfspark.schemas import SOURCES, FieldSpec
from shelfspark.sources.pages import inline_rows, scan_seen

PAGE = """<div id="main" class="a b"><h1>T &amp; x<br>y</h1><p>one<b>two</b><p>three</p>
<ul class=c><li>h<li><a href="/1">x</a><li><a href="/2" title="0.5秒">y</a></ul>
<div><div>p</div><div class="b">q<span>r</span></div></div></div><script>"<p>no</p>"</script><p>end"""


def cut(spark, page, *fields):
    df = spark.createDataFrame([(1, "http://a/", page)], "page_id bigint, url string, html string")
    return extract.extract_fields(df, [FieldSpec(*f) for f in fields]).first()


def test_selectors(spark):
    row = cut(spark, PAGE, ("h1", "#main h1"), ("all", "h1", "all_text"), ("p", "p", "all_text"),
              ("href", "ul.c > li a[href]", "attr:href"), ("li", "li", "html"),
              ("nth", "#main > div > div:nth(2)"), ("both", ".a.b span"), ("none", ".zz"),
              ("titled", 'a[title="0.5秒"]'))
    assert row.h1 == ["T & x", "y"] and row["all"] == ["T & xy"]
    assert row.p == ["onetwo", "three", "end"]
    assert row.href == ["/1", "/2"]
    assert row.li == ["<li>h", '<li><a href="/1">x</a>', '<li><a href="/2" title="0.5秒">y</a>']
    assert row.nth == ["q"] and row.both == ["r"] and row.none == [] and row.titled == ["y"]


def test_empty_and_broken_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", "</p><p>a</b>"), (3, "u", "")],
                               "page_id bigint, url string, html string")
    got = extract.extract_fields(df, [FieldSpec("p", "p", "all_text")]).orderBy("page_id").collect()
    assert [r.p for r in got] == [[], ["a"], []]


def test_positions_inside_the_panel(spark):
    spec = {f.name: f for f in SOURCES["pipipan"].fields}
    facts = "".join(f"<div><span>f{i}</span></div>" for i in range(1, 8))
    page = ('<div id="main-container"><div><div><div><div>x</div><div><div>y</div><div><div>' + facts
            + "</div></div><div><div><div>1</div><div><span>t1</span><span>t2</span></div></div></div>"
            + "</div></div></div></div></div>")
    row = cut(spark, page, *[(n, spec[n].selector, spec[n].take) for n in ("read_num", "upload_time", "tag")])
    assert (row.read_num, row.upload_time, row.tag) == (["f6"], ["f4"], ["t1", "t2"])


def test_field_processors(spark):
    df = spark.createDataFrame([(1, "u", "<a>x</a><a>y</a>")], "page_id bigint, url string, html string")
    row = extract.extract_fields(df, [FieldSpec("a", "a", column_fn=text.join_hits)]).first()
    assert row.a == "x,y"


def test_table_rows(spark):
    page = ("<table id=ip_list><tr><th>ip<tr><td>1.1.1.1<td>80<td><div class=bar title=\"0.5秒\"></div>"
            "<tr><td>2.2.2.2</td><td>81</td></table>")
    df = spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")
    hits = extract.extract_fields(df, [FieldSpec("rows", "#ip_list tr", "html")])
    rows = extract.table_rows(hits, "rows", "td", ["page_id"]).select(
        "cells", extract.row_attribute(F.col("row"), "title").alias("speed")).collect()
    assert [(r.cells, r.speed) for r in rows] == [(["1.1.1.1", "80"], "0.5秒"), (["2.2.2.2", "81"], None)]


def test_cells_are_direct_text(spark):
    """Text before, between and after inner elements counts; empty cells and inner text do not."""
    row = '<tr><TD>a</TD><td></td><td>\n<i title="0.5秒">x</i>\n</td><td>b &amp; c</td></tr>'
    df = spark.createDataFrame([(1, [row])], "page_id bigint, rows array<string>")
    cells = extract.table_rows(df, "rows", "td", ["page_id"], header_rows=0).first().cells
    assert cells == ["a", "\n", "\n", "b & c"]


def test_links_in_all_forms(spark):
    page = """<a href="/a?x=1&amp;y=2">1</a> <A HREF='/b'>2</A> <a class=x href = /c>3</a> <a data-href="/no">4</a>
        <a href=''>5</a><link href=/d/><a title='q' href="&lt;/e&amp;lt;">"""
    df = spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")
    got = [r.href for r in extract.extract_links(df).orderBy("link_no").collect()]
    assert got == ["/a?x=1&y=2", "/b", "/c", "", "/d/", "</e&lt;"]


def test_error_pages_are_no_records(spark):
    pages = [(1, "u", '<div class="view_title"><h3>t</h3></div>'), (2, "u", "<p>未找到</p>")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert [r.page_id for r in extract.site_fields(df, SOURCES["pipipan"]).collect()] == [1]


def test_deep_page_takes_linear_time():
    cutter = extract._Cutter([("t", "all_text", extract.parse_selector("article p")), ("h", "text", extract.parse_selector(".x"))])
    page = "<article><p>" + "<b>x</i>" * 125_000 + "</p></article>"
    start = time.time()
    hits = cutter.cut(page)
    assert hits["t"] == ["x" * 125_000] and time.time() - start < 10


def test_workers_find_the_package(tmp_path):
    """A driver started in another folder, with the package on its own path only."""
    code = ("import sys; sys.path.insert(0, sys.argv[1])\n"
            "from shelfspark.session import build_session\n"
            "from shelfspark.operators.extract import extract_fields\n"
            "from shelfspark.schemas import FieldSpec\n"
            "spark = build_session('other', 'local[1]')\n"
            "df = spark.createDataFrame([(1, 'u', '<a>x</a>')], 'page_id bigint, url string, html string')\n"
            "assert extract_fields(df, [FieldSpec('a', 'a')]).first().a == ['x']\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_seen_file(spark, tmp_path):
    good = "a" * 40
    path = tmp_path / "requests.seen"
    path.write_bytes(f"{good}\r\r\nxyz\r\r\n{good}\n{'b' * 40}\r\n\r\n".encode())
    assert sorted(r[0] for r in scan_seen(spark, str(path)).collect()) == [good, "b" * 40]


def test_new_links_and_domain_table(spark):
    found = spark.createDataFrame([("http://a.b/1",), ("http://a.b/1",), ("http://c/2",)], "url string")
    seen = spark.createDataFrame([("http://c/2",)], "u string").select(F.sha1("u").alias("fingerprint"))
    assert [r.url for r in links.new_links(found, seen).collect()] == ["http://a.b/1"]
    domains = inline_rows(spark, [("b",), ("x.y",)], "domain string")
    kept = links.in_domain_table(found, domains)
    assert [r.url for r in kept.collect()] == ["http://a.b/1", "http://a.b/1"]


def test_walk_keeps_to_the_routes(spark):
    edges = [("h", "c1", "cat"), ("h", "x", "other"), ("c1", "l1", "list"), ("c1", "c1", "list"),
             ("l1", "d1", "detail"), ("l1", "h", "detail"), ("h", "d2", "detail")]
    df = spark.createDataFrame(edges, "src_url string, dst_url string, route string")
    seeds = spark.createDataFrame([("h",)], "url string")
    got = {r.url: r.depth for r in links.walk_frontier(seeds, df, ["cat", "list", "detail", "detail"]).collect()}
    assert got == {"h": 0, "c1": 1, "l1": 2, "d1": 3}


def test_next_pages_long_and_circular(spark):
    chain = [(f"p{i}", f"p{i + 1}") for i in range(37)] + [("a", "b"), ("b", "c"), ("c", "a")]
    df = spark.createDataFrame(chain, "src_url string, dst_url string")
    starts = spark.createDataFrame([("p0",), ("p30",), ("a",), ("z",)], "url string")
    got = {(r.start, r.url): r.hop for r in links.walk_next_pages(starts, df).collect()}
    want = {("p0", f"p{i}"): i for i in range(38)} | {("p30", f"p{i}"): i - 30 for i in range(30, 38)}
    want |= {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("z", "z"): 0}
    assert got == want


def test_a_batch_of_pages_leaves_in_small_parts():
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(100)), "html": [None if i == 7 else f"<h1>t{i}</h1>" for i in range(100)]})
    parts = list(extract._cut_parts(iter([batch]), [("title", "text", "h1")], ["page_id"], "html", ["page_id", "title"]))
    assert max(p.num_rows for p in parts) == extract.PAGES_AT_ONCE
    made = pa.Table.from_batches(parts).to_pylist()
    assert made == [{"page_id": i, "title": [] if i == 7 else [f"t{i}"]} for i in range(100)]
