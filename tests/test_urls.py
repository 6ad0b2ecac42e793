from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hostweave.functions import urls
from hostweave.operators import collect
from hostweave.sources.tables import bulk_urls

CANONICAL = {
    "HTTP://WWW.Foo.com//a//b/?utm_source=x&id=1#f": "https://foo.com/a/b?id=1",
    "https://a.com": "https://a.com/",
    "https://a.com/x?Ref=2&refer=3": "https://a.com/x?refer=3",
    "a.com:8080/x;p=1": "https://a.com:8080/x",
    "https://a.com/x;p/y;q?&&a=&=b&gclid": "https://a.com/x;p/y?a=&=b",
    "https://a.com#frag?x=1": "https://a.com/",
    "https://..www.a.com///": "https://a.com/",
}
REASONS = {
    "HTTP://WWW.Foo.com/": "not_http", "mailto:a@b.co": "not_http", "https:///x": "no_host",
    "https://netflix.com/": "noise_host", "https://foo.gov.in/": "excluded_tld",
    "https://foo.org/": "excluded_tld", "https://a.ac.uk/": "excluded_tld",
    "https://gov.com/": None, "https://a.com/search?q=1": "path_fragment",
    "https://a.com/search/x": None, "https://a.com/file.PDF": "file_extension",
    "http://127.0.0.1/x": "local_address", "http://localhost:80/": "local_address",
    "  https://ok.shop/a ": None,
    "https://www.google.com/url?q=https%3A%2F%2Fb.shop%2Fx%20y&sa=1": None,
    "https://duckduckgo.com/l/?uddg=https%3A%2F%2Fb.shop%2F": None,
    "https://www.google.com/url?q=ftp": "path_fragment",
    "https://a.com/100%": None,
}


def test_canonical_form_and_idempotence(spark):
    df = spark.createDataFrame([(u,) for u in CANONICAL], "u string")
    once = df.withColumn("c", urls.canonical_url(F.col("u")))
    rows = once.withColumn("cc", urls.canonical_url(F.col("c"))).collect()
    assert {r.u: r.c for r in rows} == CANONICAL
    assert all(r.c == r.cc for r in rows)


def test_reject_reasons(spark):
    df = spark.createDataFrame([(u,) for u in REASONS], "href string")
    got = {r.href: r.reject_reason for r in collect.clean_urls(df).collect()}
    assert got == REASONS


def test_label_matching_keeps_lookalikes(spark):
    df = spark.createDataFrame(
        [("https://netflix.com/",), ("https://m.x.com/",), ("https://mybing.shop/",),
         ("https://bing.com/",)], "href string")
    got = {r.href: r.reject_reason for r in collect.clean_urls(df, match="label").collect()}
    assert got == {"https://netflix.com/": None, "https://m.x.com/": "noise_host",
                   "https://mybing.shop/": None, "https://bing.com/": "noise_host"}
    with pytest.raises(ValueError):
        collect.clean_urls(df, match="fuzzy")


def test_rejected_link_does_not_take_the_host(spark):
    rows = [("j", 0, 0, 0, "https://a.com/x.pdf"), ("j", 0, 0, 1, "https://a.com/y"),
            ("j", 1, 0, 0, "https://www.a.com/z"), ("k", 0, 0, 0, "https://a.com/z")]
    links = spark.createDataFrame(
        rows, "job_id string, query_idx int, page_no int, rank int, href string")
    got = {(r.job_id, r.host): r.url for r in
           collect.first_per_host(collect.clean_urls(links)).collect()}
    assert got == {("j", "a.com"): "https://a.com/y", ("k", "a.com"): "https://a.com/z"}


def test_hot_host_is_combined_before_the_shuffle(spark):
    """A third of all links on one host: the result is the first one, in any layout."""
    rows = spark.range(30_000).select(
        F.lit("j").alias("job_id"), (F.col("id") % 7).alias("query_idx"),
        (F.col("id") % 3).alias("page_no"), F.col("id").alias("rank"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://hot.shop/"), F.col("id")))
        .otherwise(F.concat(F.lit("https://s"), F.col("id"), F.lit(".shop/"))).alias("href"))
    firsts = [
        collect.first_per_host(collect.clean_urls(rows.repartition(n))).where("host = 'hot.shop'")
        .collect()[0] for n in (1, 13)
    ]
    assert firsts[0] == firsts[1]
    assert firsts[0].url == "https://hot.shop/0"
    plan = collect.first_per_host(collect.clean_urls(rows))._jdf.queryExecution().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_bulk_lists(spark):
    df = spark.createDataFrame([(1, "a.com, https://WWW.b.org/x\n\tc.shop/?utm_x=1,")],
                               "list_id int, raw string")
    got = [(r.pos, r.url, r.skipped) for r in bulk_urls(df).orderBy("pos").collect()]
    assert got == [(0, "https://a.com/", False), (1, "https://b.org/x", True),
                   (2, "https://c.shop/", False)]


def test_form_encoding(spark):
    text = 'a b*~("é")+&=%'
    from urllib.parse import quote_plus
    got = spark.range(1).select(urls.quote_plus(F.lit(text)).alias("q")).collect()[0].q
    assert got == quote_plus(text)
