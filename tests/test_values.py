"""Literal cases of the single-value expressions."""

import hashlib
import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from shelfspark.functions import analysis, ordered_sets, text, times, urls
from shelfspark.operators.catalog import gen_suggests
from shelfspark.operators.records import proxy_speed, proxy_type, proxy_url

NOW = 1_706_788_800_000


def test_upload_time_relative(values):
    shown = ["3小时前", "昨天10:30", "前天08:05", "5天前", "2018-11-02", "unknown", "", None, "2018-13-40",
             "99999999999999999999天前"]
    assert values(lambda v: times.upload_time_ms(v, NOW), shown) == [
        1706778000000, 1706697000000, 1706601900000, 1706356800000, 1541116800000, NOW, NOW, NOW, NOW, NOW]


def test_upload_time_cn(values):
    shown = ["发布 2018年11月2日 分类", "no date", None, "18年1月1日", "2018年2月31日"]
    assert values(lambda v: times.upload_time_cn(v, NOW), shown) == [1541116800000, NOW, NOW, NOW, NOW]


def test_dates(values):
    assert values(times.date_to_ms, ["2018-11-2", "1969-12-31", "x", None]) == [
        1541116800000, -86400000, None, None]
    assert values(times.ms_to_date, [1541116800000, 1541203199999, -1, None], "bigint") == [
        "2018-11-02", "2018-11-02", "1969-12-31", None]
    assert values(times.date_part, ["2018-11-02T00:00:00", "2018-11-02", "x", None]) == [
        "2018-11-02", "2018-11-02", "x", None]


def test_dates_do_not_depend_on_the_session_zone(spark, values):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert values(times.date_to_ms, ["2018-11-2"]) == [1541116800000]
        assert values(times.ms_to_date, [1541116800000], "bigint") == ["2018-11-02"]
        assert values(lambda v: times.upload_time_ms(v, NOW), ["昨天10:30"]) == [1706697000000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_duration(values):
    assert values(times.duration_ms, ["26分钟", "3小时", "2天", "x", "x天", None]) == [
        1560000, 10800000, 172800000, None, None, None]


def test_extensions(values):
    assert values(text.ext_unknown, ["a.b.pdf", "plain", "x.", None]) == ["pdf", "unknown", "", None]
    assert values(text.ext_none, ["a.b.pdf", "plain", ".pdf", None]) == ["pdf", "None", "None", None]
    assert values(text.ext_bracket, ["《x》（y）epub+mobi", "《x》pdf", "x pdf", "《x》1pdf", "(a)b)c"]) == [
        "epub+mobi", "pdf", "unknown", "unknown", "c"]


def test_small_texts(values):
    assert values(text.clean_size, ["\r\n\t1.2 MB\t"]) == ["1.2 MB"]
    assert values(lambda v: text.text_after(v, "作者："), ["作者：某人", "某人", None]) == ["某人", None, None]
    assert values(lambda v: text.text_before(v, "秒"), ["0.5秒", "7"]) == ["0.5", "7"]
    assert values(text.safe_page, ["3", "x", None, "2.5", " 4 "]) == [3, 1, 1, 1, 4]
    assert values(text.to_count, ["12", "1.5", "99999999999", "-3", ""]) == [12, None, None, -3, None]
    assert values(text.strip_tags, ["<p>a<br>b</p> 1 < 2", "<!-- x\ny -->z"]) == ["ab 1 < 2", "z"]
    assert values(lambda v: text.truncate(v, 3), ["abcdef", "ab"]) == ["abc", "ab"]


def test_hits(values):
    assert values(text.take_first, [[None, "", "a", "b"], [], None], "array<string>") == ["a", None, None]
    assert values(text.join_hits, [["a", "b"], []], "array<string>") == ["a,b", ""]
    step = [lambda h: F.nullif(h, F.lit("x")), F.upper]
    assert values(lambda v: text.map_hits(v, *step), [["a", "x", "b"]], "array<string>") == [["A", "B"]]


def test_ids(values):
    url = "http://a.b/ü"
    assert values(urls.url_id, [url]) == [hashlib.md5(url.encode()).hexdigest()]
    assert values(urls.fingerprint, [url]) == [hashlib.sha1(url.encode()).hexdigest()]


def test_resolve_link_as_urljoin(spark):
    bases = ["http://a.b/c/d?x", "http://a.b", "https://a.b/c/", "http://a.b/c/d/e#f", "http://a.b/?q=1#z"]
    hrefs = ["/e", "../e", "//z/q", "https://y/1", "javascript:;", "e", "./e", "../../e", "e/../f", "?p=2",
             "#top", "", "/x/../y", "e//f", "../", ".", "..", "g?y=./x", "/a/./b/", "mailto:a@b", "e/./"]
    rng = random.Random(3)
    hrefs += ["/".join(rng.choice(["a", "..", ".", "b"]) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = [(b, h, urljoin(b, h)) for b in bases for h in hrefs]
    df = spark.createDataFrame(rows, "base string, href string, want string")
    wrong = (df.withColumn("got", urls.resolve_link(F.col("base"), F.col("href")))
             .filter("got <> want or got is null").collect())
    assert wrong == []


def test_hosts_and_domains(values):
    links = ["http://a.B.com:80/x", "https://u@b.com", "http://ab.com/", "ftp://x/b.com", "b.com"]
    assert values(urls.host, links) == ["a.b.com", "b.com", "ab.com", "x", ""]
    assert values(lambda v: urls.in_domains(v, ["b.com"]), links) == [True, True, False, False, False]
    assert values(urls.host_suffixes, ["http://a.b.com/"]) == [["a.b.com", "b.com", "com"]]


def test_routes(values):
    from shelfspark.schemas import SOURCES
    found = values(lambda v: urls.route(v, SOURCES["ishare"].routes),
                   ["http://iask.sina.com.cn/c/12.html", "http://x.cn/f/aB1.html", "http://x.cn/f/a-1.html"])
    assert found == ["category", "detail", "other"]
    found = values(lambda v: urls.route(v, SOURCES["mebook"].routes),
                   ["http://m/category/novel", "http://m/category/x/page/2", "http://m/123.html", "http://m/"])
    assert found == ["list", "list", "detail", "other"]


def test_proxy_cells(values):
    rows = [["i", "p", "", "", "", "HTTP", "HTTPS"], ["i", "p", "", "", "", "HTTP"],
            ["i", "p", "", "", "", "socks"]]
    assert values(proxy_type, rows, "array<string>") == ["https", "http", "socks"]
    assert values(proxy_speed, ["0.5秒", "", None, "x秒"]) == [0.5, 0.0, 0.0, None]
    assert values(lambda v: proxy_url(v, F.lit("1.2.3.4"), F.lit("80")), ["http"]) == ["http://1.2.3.4:80"]


def test_ordered_sets_follow_a_dict(spark):
    rng = random.Random(5)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 6))],
             [rng.choice("abcd") for _ in range(rng.randint(0, 6))]) for _ in range(80)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    s, a, b = ordered_sets, F.col("a"), F.col("b")
    got = df.select("a", "b", s.union(a, b).alias("u"), s.intersection(a, b).alias("i"),
                    s.difference(a, b).alias("d"), s.symmetric_difference(a, b).alias("x"),
                    s.is_subset(a, b).alias("sub"), s.is_superset(a, b).alias("sup"),
                    s.add(a, F.lit("z")).alias("add"), s.discard(a, F.lit("a")).alias("dis"),
                    s.is_proper_subset(a, b).alias("lt")).collect()
    for r in got:
        left, right = list(dict.fromkeys(r.a)), list(dict.fromkeys(r.b))
        assert r.u == list(dict.fromkeys(left + right))
        assert r.i == [m for m in left if m in right]
        assert r.d == [m for m in left if m not in right]
        assert r.x == r.d + [m for m in right if m not in left]
        assert (r["sub"], r["sup"]) == (set(left) <= set(right), set(left) >= set(right))
        assert r["add"] == left + ["z"] and r.dis == [m for m in left if m != "a"]
        assert r["lt"] == (set(left) <= set(right) and left != right)


def test_tokens(values):
    assert values(analysis.fine_tokens, ["The Book-2 读书人 好", "", None]) == [
        ["the", "book", "2", "读书", "书人", "好"], [], []]
    assert values(analysis.coarse_tokens, ["Das 读书人x"]) == [["das", "读书人", "x"]]
    assert values(analysis.suggestion_words, [["a", "book", "book"]], "array<string>") == [["book"]]


def test_term_counts(values):
    rng = random.Random(1)
    rows = [[rng.choice("abcde") for _ in range(rng.randint(0, 30))] for _ in range(40)]
    got = values(analysis.term_counts, rows, "array<string>")
    for row, counts in zip(rows, got):
        assert [(c.term, c.tf) for c in counts] == sorted((t, row.count(t)) for t in set(row))


def test_highlight_gives_back_the_text(values):
    texts = ["Red, red book!", "读书人 and 书", "", "none here", "<b>red</b>"]
    terms = F.array(F.lit("red"), F.lit("书人"))
    marked = values(lambda v: analysis.highlight(v, terms, "[", "]"), texts)
    assert marked == ["[Red], [red] book!", "读[书人] and 书", "", "none here", "<b>[red]</b>"]
    assert [m.replace("[", "").replace("]", "") for m in marked] == texts


def test_suggestion_words_by_field(spark):
    df = spark.createDataFrame([("red book", "book pdf"), ("red book", None), ("", "a")], "t string, u string")

    def run(**kw):
        rows = df.select(gen_suggests([(F.col("t"), 10), (F.col("u"), 7)], **kw).alias("s")).collect()
        return [[(list(e.input), e.weight) for e in r.s] for r in rows]

    assert run() == [[(["red", "book"], 10), (["pdf"], 7)], [(["red", "book"], 10)], []]
    assert run(dedup=False)[0] == [(["red", "book"], 10), (["book", "pdf"], 7)]


def test_long_numbers_do_not_end_a_job(spark):
    """Twenty digits in every expression that reads a number."""
    n, now = "9" * 20, 1_700_000_000_000
    texts = [f"{n}小时前", f"昨天{n}:00", "昨天99999999999999999:00", f"前天10:{n}", f"{n}天前", "999999999999小时前", f"{n}-1-1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    rows = df.select(times.upload_time_ms(t, now).alias("ms"), times.ms_to_date(times.upload_time_ms(t, now)).alias("day"),
                     times.upload_time_cn(F.lit(f"{n}年1月1日"), now).alias("cn"), times.duration_ms(F.concat(F.lit(n), F.lit("天"))).alias("d"),
                     text.to_count(F.lit(n)).alias("count"), times.ms_to_date(F.lit(-(1 << 62))).alias("far")).collect()
    assert all(r.ms == now and r.cn == now and r.d is None and r["count"] is None and r.far is None for r in rows)
