import pytest
from pyspark.sql import functions as F

from commentlens.functions import html, urls

CASES = [
    ("http://example.com", True, True, "name"),
    ("see http://example.com now", True, False, "name"),
    ("HTTPS://EXAMPLE.COM/A", True, True, "name"),
    ("http://10.0.0.1/x", True, True, "private_ip"),
    ("http://192.168.1.20:8080", True, True, "private_ip"),
    ("http://172.16.0.9", True, True, "private_ip"),
    ("http://localhost:80/", True, True, "private_host"),
    ("ftp://8.8.8.8/file", True, True, "public_ip"),
    ("http://[2001:db8::1]/p", True, True, "ipv6"),
    ("http://[::ffff:1.2.3.4]", True, True, "ipv6"),
    ("http://user:pw@example.com", True, True, "name"),
    ("http://xn--bcher-kva.example", True, True, "name"),
    ("http://bücher.example/ü?q=ü#ü", True, True, "name"),
    ("http://a-b.c-d.org", True, True, "name"),
    ("http://nodots", False, False, None),
    ("example.com", False, False, None),
    ("http://-bad.com", False, False, None),
    ("", False, False, None),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, s string")
    rows = df.orderBy("i").select(
        urls.contains_url(F.col("s")), urls.is_only_url(F.col("s")), urls.host_class(F.col("s"))).collect()
    assert [(c, tuple(r)) for c, r in zip(CASES, rows) if tuple(r) != c[1:]] == []


def test_long_hosts_do_not_exhaust_the_stack(spark):
    long = ["http://" + "a" * 20_000, "http://" + "a-" * 10_000 + "a.com", "http://" + "a." * 10_000,
            "http://" + "x:" * 10_000, "http://" + "é" * 20_000]
    df = spark.createDataFrame([(s,) for s in long], "s string")
    assert df.filter(urls.contains_url(F.col("s"))).count() <= len(long)


@pytest.mark.parametrize("markup, expected", [
    ('a<img src="x" alt="smile">b<script>no()</script><p>c</p>', "asmilebc"),
    ("<!-- hidden --><style>p{}</style>x", "x"),
])
def test_visible_text(spark, markup, expected):
    df = spark.createDataFrame([(markup,)], "h string")
    assert df.select(html.visible_text(F.col("h"))).first()[0] == expected


def test_links_and_parameters(spark):
    df = spark.createDataFrame([("https://w.org/watch?v=a&lc=Ug1", html.CHANNEL_PREFIX + "UC9")], "u string, p string")
    assert tuple(df.select(html.query_parameter(F.col("u"), "lc"), html.channel_id(F.col("p"))).first()) == ("Ug1", "UC9")


def test_markup_with_any_quoting(spark):
    cases = [
        ("a &amp; b &lt;c&gt; &amp;amp; &nosuch; &#8364;&#x1F600;&#128; &#0;&#xD800; &apos;&nbsp;x &", "a & b <c> &amp; &nosuch; €😀€ \uFFFD\uFFFD '\xa0x &"),
        ("<p title=\"a > b\">x</p><img alt='one \"two\"'><img data-alt=\"no\" ALT = three><img alt=\"\" src='>'>y", 'xone "two"threey'),
        ("1 < 2 <b class='x'>bold</b><br/> <img title=\"alt='no'\" alt=yes>", "1 < 2 bold yes"),
        ("<!-- gone -->a<script>var x = '<p>';</script>b<style>p{}</style>", "ab"), ("<a title=\"open>text</a> end", "text end"), ("", ""),
    ]
    df = spark.createDataFrame(cases, "h string, want string")
    assert [(r[0], r[1]) for r in df.select(html.visible_text(F.col("h")), "want").collect()] == [(w, w) for _, w in cases]
    assert df.select(html.visible_text(F.lit(None).cast("string"))).first()[0] is None


def test_body_links(spark):
    cases = [
        ('<a href="http://x.org">', ["http://x.org"], []),
        ("<a class='b yt-simple-endpoint c' HREF=http://y.org>", ["http://y.org"], ["http://y.org"]),
        ('<a data-href="no" class="yt-simple-endpoint">', [], []),
        ('<abbr href="no"><a title="href=no" href=\'/watch?v=a&amp;b&#61;c\' class=yt-simple-endpoint-not>', ["/watch?v=a&amp;b=c"], []),
        (None, None, None),
    ]
    df = spark.createDataFrame([(h,) for h, _, _ in cases], "h string")
    got = df.select(html.link_targets(F.col("h")), html.link_targets(F.col("h"), html.BODY_LINK_CLASS)).collect()
    assert [tuple(r) for r in got] == [(a, b) for _, a, b in cases]
