"""Canonical URLs and the filtered set of seen requests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.requests import canonical_url, request_fingerprint
from shelfspark.operators import seen

# url -> canonical form
FORMS = {
    "HTTP://Example.COM": "http://example.com/",
    "http://example.com:/a b": "http://example.com/a%20b",
    "http://example.com/?b=2&a=1&a=0": "http://example.com/?a=0&a=1&b=2",
    "http://example.com/p?a=%7e&b=x y+z#part": "http://example.com/p?a=~&b=x+y+z",
    "http://example.com/p?z&&y=": "http://example.com/p?y=&z=",
    "http://example.com/%7Euser/%2fa/%3F%41%c3%a9": "http://example.com/~user/%2Fa/%3FA%C3%A9",
    "http://example.com/é?q=é": "http://example.com/%C3%A9?q=%C3%A9",
    " http://example.com/x? ": "http://example.com/x",
    "http://example.com/?a=1%262": "http://example.com/?a=1%262",
    "http://example.com/?k=a=b": "http://example.com/?k=a%3Db",
    "no url at all": "no url at all",
    "": "",
}


def test_canonical_forms(values):
    assert values(canonical_url, list(FORMS)) == list(FORMS.values())
    assert values(canonical_url, list(FORMS.values())) == list(FORMS.values())
    assert values(canonical_url, [None]) == [None]


def test_fingerprint_covers_method_and_body(values):
    def sha(text):
        return hashlib.sha1(text.encode()).hexdigest()
    url = "http://example.com/?b=2&a=1"
    assert values(request_fingerprint, [url]) == [sha("GEThttp://example.com/?a=1&b=2")]
    assert values(lambda u: request_fingerprint(u, F.lit("post"), F.lit("x=1")), [url]) == [sha("POSThttp://example.com/?a=1&b=2x=1")]
    # one page, four spellings
    same = ["http://e.com/?a=1&b=%7e", "http://e.com/?b=~&a=1", "http://E.com?b=~&a=1#top", "HTTP://e.com/?a=1&&b=~"]
    assert len(set(values(request_fingerprint, same))) == 1


@pytest.mark.parametrize("bits", [seen.LEAST_BITS, 1 << 20])
def test_no_new_request_is_dropped_and_no_seen_one_passes(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(seen, "LEAST_BITS", bits)
    root = str(tmp_path)
    urls = spark.range(3000).select(F.concat(F.lit("http://h"), F.col("id") % 7, F.lit("/p?i="), "id").alias("url"), "id")
    assert seen.new_requests(urls, root).count() == 3000
    for first in (0, 1000):
        older = urls.filter((F.col("id") >= first) & (F.col("id") < first + 1200))
        seen.append_seen(seen.distinct_requests(older).select("fingerprint"), root, buckets=4)
    found = seen.new_requests(urls.unionByName(urls), root)
    assert {int(r.url.rsplit("=", 1)[1]) for r in found.collect()} == set(range(2200, 3000)) and found.count() == 800
    # few of the new ones need the exact comparison
    fresh = seen.distinct_requests(urls.filter("id >= 2200"))
    for generation in seen.generations(spark, root):
        assert seen.maybe_seen(fresh, generation).filter("maybe").count() <= 40
    assert seen.new_requests(urls.limit(0), root).count() == 0
