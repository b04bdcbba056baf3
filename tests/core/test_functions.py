import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from linkweave.functions import html, labels, times, urls


def values(spark, column, *rows):
    frame = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i long, a string, b string" if isinstance(rows[0], tuple) else "i long, a string")
    return [r.x for r in frame.select("i", column.alias("x")).orderBy("i").collect()]


def test_normalize_url(spark):
    cases = [
        ("/blog/post", "https://example.com/feed.xml", "https://example.com/blog/post"),
        ("//other.com/x", "https://example.com/", "https://other.com/x"),
        ("post", "https://example.com/a/feed.xml", "https://example.com/a/post"),
        ("../x/./y", "https://example.com/a/b/feed.xml", "https://example.com/a/x/y"),
        ("?q=1", "https://example.com/a", "https://example.com/a?q=1"),
        ("/blog/post", None, ""),
        ("hhttps://example.com/x", None, ""),
        ("ftp://example.com/x", None, ""),
        ("javascript:alert(1)", "https://example.com/", ""),
        ("  ", "https://example.com/", ""),
        (None, None, ""),
        ("https://[example.com/x", None, ""),
        ("https://exa[mple.com/x", None, ""),
        ("http://[::1junk]/x", None, ""),
        ("//[bad/path", "https://example.com/", ""),
        (" https://Example.com/X?y#z ", None, "https://Example.com/X?y#z"),
        ("https://é.fr/ü|x", None, "https://é.fr/ü|x"),
    ]
    assert values(spark, urls.normalize_url("a", F.col("b")), *[c[:2] for c in cases]) == [c[2] for c in cases]


def test_add_urls_and_ids(spark):
    row = spark.range(1).select(
        urls.add_urls(F.array(F.lit("https://[example.com/x"), F.lit("https://example.com/good"), F.lit("https://example.com/good"))).alias("u"),
        (urls.unique_id(F.array(F.lit("b"), F.lit("a"))) == urls.unique_id(F.array(F.lit("a"), F.lit("b")))).alias("same"),
    ).first()
    assert row.u == ["https://example.com/good"] and row.same


def test_extract_urls(spark):
    assert values(spark, urls.extract_urls("a"), "see (https://a.b/c) and http://d/e>x 'https://f'", None, "") == [["https://a.b/c", "http://d/e"] + ["https://f"], [], []]


@pytest.mark.parametrize(
    "given, want",
    [
        ("https://example.com/story.", "https://example.com/story"),
        ("https://example.com/a_(b)", "https://example.com/a_(b)"),
        ("https://example.com/a_(b)).", "https://example.com/a_(b)"),
        ("https://example.com/x)]},.", "https://example.com/x"),
        ("https:///path", ""),
        ("example.com", ""),
        (None, ""),
    ],
)
def test_clean_candidate(spark, given, want):
    assert values(spark, urls.clean_candidate_url("a"), (given, "")) == [want]


def test_feed_keys(spark):
    given = ["HTTPS://Example.COM/Feed.XML", "https://example.com", "https://example.com/a?id=7#top", "", None]
    assert values(spark, urls.normalize_feed_url("a"), *given) == ["https://example.com/Feed.XML", "https://example.com/", "https://example.com/a?id=7", "/", "/"]
    assert values(spark, urls.normalize_content_url("a"), "https://WWW.a.com/x//#f", "http://a.com") == ["https://a.com/x", "http://a.com/"]


def test_hosts_and_keywords(spark):
    given = ["https://user:pw@Sub.Bit.ly:80/x", "https://notbit.ly/", "http://a.b/bit.ly", "http://[::1]:8/x"]
    assert values(spark, urls.host("a"), *given) == ["sub.bit.ly", "notbit.ly", "a.b", "::1"]
    assert values(spark, urls.is_shortened("a"), *given) == [True, False, False, False]
    assert values(spark, urls.host_matches("a", ["BIT", " "]), *given) == [True, True, False, False]
    assert values(spark, urls.url_matches("a", ["bit.ly"]), *given) == [True, True, True, False]
    assert values(spark, urls.text_matches("a", ["trump", "politics", "c++"]), "A Politics story", "A trumpet lesson", "trumpé", "Trump!", "c++ x", None) == [True, False, False, True, True, False]
    assert values(spark, urls.text_matches("a", []), "x") == [False]


def test_subreddits(spark):
    given = ["r/Python", "/r/Python/", "R/", "r/", None, "a b"]
    assert values(spark, urls.clean_subreddit_name("a"), *given) == ["Python", "Python", "", "", "", "a b"]
    assert values(spark, urls.valid_subreddit_name("a"), *given) == [True, True, False, False, False, False]


def test_dates(spark):
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    given = ["Mon, 05 Jan 2026 10:00:00 +0000", "05 Jan 2026 10:00:00 GMT", "2026-01-05T10:00:00.123Z", "2026-01-05T12:00:00+02:00", "2026-01-05 10:00:00", "garbage", "2026-02-30T00:00:00Z"]
    got = values(spark, times.utc_iso(times.provider_date("a", now)), *given)
    assert got == ["2026-01-05T10:00:00Z"] * 5 + ["2030-01-01T00:00:00Z"] * 2
    assert values(spark, times.contract_timestamp("a"), "nope", "2026-01-05T10:00:00.9Z") == [None, datetime(2026, 1, 5, 10)]
    clamped = values(spark, times.utc_iso(times.clamp_future(F.col("a").cast("timestamp"), now)), "2030-01-01 00:01:00", "2030-01-01 00:01:01", None)
    assert clamped == ["2030-01-01T00:01:00Z", "2030-01-01T00:00:00Z", None]
    assert values(spark, times.batch_instant("a"), "20260105T100000000007Z-0123abcd", "x") == [datetime(2026, 1, 5, 10, 0, 0, 7), None]
    ages = values(spark, times.relative_age(F.col("a").cast("timestamp"), now), "2029-12-31 23:59:55", "2029-12-31 23:57:00", "2029-12-31 22:00:00", "2029-12-28 00:00:00", "2029-12-18 00:00:00", "2029-11-01 00:00:00", "2028-06-01 00:00:00")
    assert ages == ["5s", "3m", "2h", "4d", "2w", "2mo", "1y"]


def test_labels(spark):
    assert values(spark, labels.contains_literal("a", "100%"), "Now 100% faster", "Just as fast", None) == [True, False, False]
    assert values(spark, labels.bluesky_link("a", F.lit("did"), "b"), ("h", "at://x/k"), ("", "at://x/k"), ("h", "")) == ["https://bsky.app/profile/h/post/k", "https://bsky.app/profile/did/post/k", ""]
    assert values(spark, labels.reddit_fullname("a", "b"), ("t3_x", "y"), (None, "y"), ("", "y"), ("", "")) == ["t3_x", "t3_y", "t3_y", None]
    assert values(spark, labels.displayed_link("a", "b"), ("", "o"), (None, "o")) == ["", "o"]
    assert values(spark, labels.exported_link("a", "b"), ("", "o"), ("u", "o")) == ["o", "u"]


def test_html(spark):
    assert html.parse_status('<p>Read <a href="https://a/b">the article</a> at &lt;x&gt;</p>') == ("Read the article at <x>", ["https://a/b"], "Read at <x>")
    page = '<link rel="alternate" type="application/atom+xml" href="/atom"><link rel="alternate" type="application/rss+xml" href="rss.xml">'
    assert values(spark, html.discovered_feed("a", "b"), (page, "https://x.example/blog/"), ("<p>", "https://x.example/")) == ["https://x.example/blog/rss.xml", ""]
    assert values(spark, urls.is_tag_url("a"), "https://m/tags/x", "https://m/Tags/", "https://m/tagsoup", "x") == [True, True, False, False]


def test_white_space_of_any_kind_is_stripped(spark):
    url = "\n\t https://Example.com/a \t"
    row = spark.createDataFrame([(url,)], "a string").select(
        urls.clean_candidate_url("a").alias("clean"), urls.normalize_feed_url("a").alias("feed"), urls.normalize_content_url("a").alias("content"), urls.clean_subreddit_name(F.lit("\tr/x\n")).alias("sub"),
        labels.normalize_text(F.lit("\n\tA  b\n")).alias("text"), urls.primary_link(F.array("a"), F.lit("x")).alias("primary"),
    ).first()
    assert row.asDict() == {"clean": "https://Example.com/a", "feed": "https://example.com/a", "content": "https://example.com/a", "sub": "x", "text": "a b", "primary": url}


def test_content_keys_of_relative_links(spark):
    assert values(spark, urls.normalize_content_url("a"), "/p/1/#x", "/p/1", "/?q/", "/", "", "HTTPS://www.S.example/p/1/#x") == ["/p/1", "/p/1", "?q/", "/", "/", "https://s.example/p/1"]


def test_absolute_feed_urls(spark):
    given = ["https://A.b/C#d", "a.b/c", "ftp://a/b", "", None, "http://a.b:80", "https://a.b:443/x", "https://a.b:80/x", "/x"]
    assert values(spark, urls.absolute_feed_url("a"), *given) == ["https://a.b/C", "", "", "", "", "http://a.b/", "https://a.b/x", "https://a.b:80/x", ""]


def test_discovered_feeds(spark):
    page = lambda *links: "<html><head>" + "".join(f"<link {x}>" for x in links) + "</head>"
    json, rss, atom = 'rel="alternate" type="application/json" href="/wp-json"', "type='application/rss+xml' rel='alternate nofollow' href='/rss?a=1&amp;b=2'", 'href=/atom rel=alternate type=application/atom+xml'
    feed = 'rel="alternate" type="application/feed+json" href="/feed.json"'
    cases = [(page(json), ""), (page(json, atom, rss), "https://x.example/rss?a=1&b=2"), (page(feed, atom), "https://x.example/feed.json"), (page(atom, feed), "https://x.example/atom"), (page('rel="alternates" type="application/rss+xml" href="/n"'), ""), (None, "")]
    assert values(spark, html.discovered_feed("a", F.col("b")), *[(p, "https://x.example/p") for p, _ in cases]) == [want for _, want in cases]


def test_feeds_that_a_page_only_talks_of(spark):
    rss, atom = ('<link rel="alternate" type="application/rss+xml" href="/rss">', '<link rel="alternate" type="application/atom+xml" href="/atom">')
    unseen = [f"<!--{rss}-->", f"<!-- <b> {rss}\n-- > {rss} -->", f"<script>var a = '{rss}'</script>", f"<SCRIPT src='x'>\n{rss}</Script >", f"<style>{rss}</style>", f"<!-- <script> --><!--{rss}--><script></script>", f"<script>'<!--'{rss}</script>"]
    cases = [(c, "") for c in unseen] + [(c + atom, "https://x.example/atom") for c in unseen] + [(atom + c + "<p>", "https://x.example/atom") for c in unseen]
    cases += [(atom + f"<!-- {rss}", "https://x.example/atom"), (f"<!-- a -->{rss}<!-- b -->", "https://x.example/rss"), (f"<scripts>{rss}", "https://x.example/rss"), ("", "")]
    assert values(spark, html.discovered_feed("a", F.col("b")), *[(p, "https://x.example/p") for p, _ in cases]) == [want for _, want in cases]


@pytest.mark.parametrize(
    "given, want",
    [
        ("2026-05-22T20:00:00+09:00", "2026-05-22T11:00:00Z"),
        ("2026-05-22T20:00:00.123456789Z", "2026-05-22T20:00:00Z"),
        ("2026-05-22T20:00:00.1+0000", "2026-05-22T20:00:00Z"),
        ("2026-05-22T20:00Z", "2026-05-22T20:00:00Z"),
        ("2026-05-22 20:00:00", "2026-05-22T20:00:00Z"),
        ("Fri, 22 May 26 20:00:00 GMT", "2026-05-22T20:00:00Z"),
        ("Fri, 22 May 2026 20:00 +0200", "2026-05-22T18:00:00Z"),
        ("22 September 1999 20:00:00 UT", "1999-09-22T20:00:00Z"),
        ("Friday, 22-May-26 20:00:00 EST", "2026-05-22T20:00:00Z"),
        ("May 22, 2026 8:05 PM", "2026-05-22T20:05:00Z"),
        ("Fri May 22 20:00:00 2026", "2026-05-22T20:00:00Z"),
        ("20260522T200000Z", "2026-05-22T20:00:00Z"),
        ("2026-05-22", "2026-05-22T00:00:00Z"),
        ("yesterday", None),
        ("", None),
        (None, None),
    ],
)
def test_dates_of_providers(spark, given, want):
    assert values(spark, times.utc_iso(times.parse_date("a")), (given, "")) == [want]


def test_rss_of_version_1_and_namespaced_dates(spark):
    from linkweave.sources import providers

    item = "<item><title>T</title><link>https://p.example/1</link><dc:date>2026-01-05T10:00:00+00:00</dc:date></item>"
    names = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    rdf = f'<?xml version="1.0"?><rdf:RDF {names}><channel><title>C</title><link>https://s.example/</link></channel>{item}</rdf:RDF>'
    rss = f'<rss {names}><channel><title>C</title><link>https://s.example/</link>{item}</channel></rss>'
    bodies = spark.createDataFrame([("u", rdf), ("v", rss), ("w", "<rss"), ("x", None)], "feed_url string, body string")
    rows = providers.rss_posts(bodies, F.lit("2030-01-01").cast("timestamp")).collect()
    assert [(r.source, r.author, r.description, r.urls, r.posted_at.strftime("%Y-%m-%d %H")) for r in rows] == [("https://s.example/", "C", "T", ["https://p.example/1"], "2026-01-05 10")] * 2


def test_batches_are_kept_by_days(spark):
    from linkweave.operators import merges

    rows = spark.createDataFrame([(i, datetime(2026, 1, i)) for i in range(1, 11)] + [(99, None)], "i int, at timestamp_ntz")
    kept = lambda days: sorted(r.i for r in merges.retain_batches(rows, F.col("at"), F.lit(datetime(2026, 1, 10)).cast("timestamp_ntz"), days).collect())
    assert kept(3) == [7, 8, 9, 10, 99] and kept(0) == [*range(1, 11), 99]


def test_odd_feeds():
    from linkweave.sources.feeds import parse

    item = lambda n, more="": f"<item><title>t{n}</title><link>https://x.example/{n}</link>{more}</item>"
    links = lambda body: [e["link"] for e in parse(body)["entries"] if e["link"]]
    assert links("<rss><channel>" + item(1) + item(2) + item(3) + "<item><title>cut</title><li") == [f"https://x.example/{n}" for n in (1, 2, 3)]
    assert links("<rss><channel>" + item(1, "</b></i>") + "<item><title>open" + item(2) + "</channel></rss>") == ["https://x.example/1", "https://x.example/2"]
    assert links("<rss><channel>" + item(1, "<description><![CDATA[<feed > <item><link>no</link>]]></description>") + "</channel></rss>") == ["https://x.example/1"]
    assert links('<feed xmlns="http://www.w3.org/2005/Atom" xml:base="https://b.example/d/"><entry><link href="e"/></entry><entry><link href="http://[bad"/></entry></feed>') == ["https://b.example/d/e", "http://[bad"]
    feed = parse('<x:feed xmlns:x="http://www.w3.org/2005/Atom" xmlns:m="urn:m"><m:title>no</m:title><x:title>T &amp;amp; t</x:title><x:entry><x:author><x:title>no</x:title></x:author></x:entry></x:feed>')
    assert (feed["title"], feed["entries"][0]["title"]) == ("T &amp; t", None)
    assert parse("<html><feed></feed></html>") is None and parse("plain") is None and parse("") is None and parse(None) is None
    assert parse("<rss><channel>" + "<a 'b" * 200_000)["entries"] == []
    assert links("<!DOCTYPE rss [<!ENTITY e 'x'>]><rss><channel>" + "".join(map(item, range(20_000))) + "</channel></rss>")[-1] == "https://x.example/19999"


def test_plain_fragments_read_as_the_parser_reads_them(spark):
    common = ['<p>', '</p>', '<a href="https://a.b/?x=1&amp;y=2">', '<a class="u" href="h" rel="x">', "</a>", "<br/>", "<br />", " text ", "&amp;", "&lt;b&gt;", "&nbsp;", "&#39;", '<A HREF="Z">', '<span class="i">', "</span>", "é "]
    common += ["<a>", '<a href="">', '<a title="a href=" href="q">', "amp", "lt;", "\n", '<a\nhref="n">', '<a href="1" href="2">', "&quot;", "<em>"]
    odd = ["&copy;", "a & b", "<", ">", "<!-- c -->", "<script>", "</script>", "<a href='s'>", "</a >", "<p/>", "<img alt=x>"]
    draw = random.Random(5)
    rows = [("".join(draw.choice(common + odd if i % 2 else common) for _ in range(draw.randint(0, 8))),) for i in range(3000)]
    rows += [(None,), ("x" * 300_000,), ("<p>" * 50_000,), ('<a href="k">z</a>' * 20_000,)]
    plain = F.col("plain")
    frame = spark.createDataFrame(rows, "c string").repartition(4).withColumn("plain", html.is_plain(F.coalesce("c", F.lit(""))))
    got = html.status_parts(frame, "c").select("c", plain, "parts").collect()
    assert [r.c for r in got if tuple(r.parts) != html.parse_status(r.c)] == []
    assert len(got) == 3004 and sum(r.plain for r in got) > 500


def test_references_without_a_semicolon_are_text_if_asked_for(spark):
    cut = '<title>a &amp;&amp</title><a href="https://x.example/?a&amp=1">b &amp &copy; &amp;lt;</a>&am'
    assert html.parse_status(cut)[0] == "a && b & © < &am"
    assert html.parse_status(cut, finished=True) == ("a &&amp b &amp © < &am", ["https://x.example/?a&amp=1"], "a &&amp &am")
    frame = spark.createDataFrame([(cut,), ("<p>a &amp; b</p>",), (None,)], "c string")
    assert [tuple(r.parts) for r in html.status_parts(frame, "c", finished=True).collect()] == [html.parse_status(c, True) for c in (cut, "<p>a &amp; b</p>", None)]
