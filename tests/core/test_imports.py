import re
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from linkweave.functions import html, urls
from linkweave.plans import imports, source_queries


def test_status_texts_have_the_links_of_the_page(spark, small_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    rows = source_queries.table(spark, small_dir, "pages").transform(lambda d: html.status_parts(d.select("page_id", "html"), "html")).collect()
    for r in rows:
        assert r.parts.links == re.findall(r'<a\s[^>]*?href="([^"]*)"', pages[r.page_id])
        outside = re.sub(r"(?s)<a\s.*?</a>", "", pages[r.page_id])
        for word in re.findall(r"<p>(\w+) ", outside):
            assert word in r.parts.outside
        assert len(r.parts.text) >= len(r.parts.outside)


def plain(candidates, catalog, responses, now, days):
    """The import as a loop, with keys taken from URLs that are clean already."""

    def key(u):
        m = re.match(r"^(\w+)://([^/?#]*)([^?#]*)(\?[^#]*)?", u)
        return f"{m[1].lower()}://{m[2].lower()}{m[3] or '/'}{m[4] or ''}"

    def site(u):
        return re.sub(r"^www\.", "", re.match(r"^\w+://([^/?#:]*)", u)[1].lower())

    def state(r):
        if r is None or r["http"] >= 400 or not r["links"]:
            return "dead"
        if r["latest"] is None:
            return "unknown_date"
        return "abandoned" if r["latest"] < now - timedelta(days=days) else "active"

    known, seen, taken, out = {key(u) for u in catalog}, set(), set(), []
    fresh = []
    for u in candidates:
        if not re.match(r"^https?://[^/]", u):
            out.append("invalid")
        elif key(u) in known:
            out.append("present")
        elif key(u) in seen:
            out.append("duplicate_in_input")
        else:
            seen.add(key(u))
            fresh.append(u)
    for u in fresh:
        r = responses.get(u)
        status = state(r)
        if status == "active":
            a = r["links"][:10]
            for other in catalog:
                e = responses[other]
                if site(other) != site(u) or state(e) == "dead":
                    continue
                b = e["links"][:10]
                if a[0] == b[0] or len(set(a) & set(b)) >= 3 or (r["title"] and r["title"] == e["title"] and len(set(r["titles"][:10]) & set(e["titles"][:10])) >= 2):
                    status = "duplicate_content"
                    break
        if status == "active":
            if key(u) in taken:
                status = "duplicate_final"
            taken.add(key(u))
        out.append(status)
    return Counter(out)


def test_import_matches_a_loop(spark, small_dir):
    """Hosts are cut to their last two names, so that sites have several feeds."""
    now, days = datetime(2026, 1, 1), 150
    p = source_queries.table(spark, small_dir, "pages").where("url not like '%:%:%'").withColumn("url", F.regexp_replace("url", r"^(\w+)://(?:[^/]*\.)?(example\.\w+)", "$1://$2"))
    p = p.withColumn("url", F.regexp_replace("url", "#.*", ""))
    pages = p.select("page_id", "url", "html").orderBy("page_id").collect()
    catalog = [r.url for r in pages if r.page_id % 3 == 0]
    candidates = [r.url for r in pages] + ["ftp://x.example/", "mailto:x"]
    title = lambda h: re.search(r"(?s)<title>(.*?)</title>", h)[1]
    landed = {r.url: {"http": 404 if r.page_id % 13 == 0 else 200, "links": re.findall(r'<a\s[^>]*?href="([^"]*)"', r.html), "latest": now - timedelta(days=r.page_id) if r.page_id % 17 else None, "title": title(r.html), "titles": title(r.html).split(" ")} for r in pages}
    responses = spark.createDataFrame(
        [(u, u, v["http"], False, v["latest"], "", v["title"], v["links"], v["titles"], len(v["links"])) for u, v in landed.items()],
        "url string, final_url string, http_status int, bad_xml boolean, latest timestamp_ntz, feed_link string, title string, links array<string>, titles array<string>, entries int",
    )
    table = spark.createDataFrame([(u,) for u in catalog], "feed_url string").withColumn("normalized_url", urls.normalize_feed_url("feed_url")).dropDuplicates(["normalized_url"])
    got = imports.classify(spark.createDataFrame(list(enumerate(candidates)), "seq long, url string"), table, responses, F.lit(now).cast("timestamp_ntz"), days)
    counts = {r.status: r.n for r in imports.summary(got).collect()}
    assert counts == dict(plain(candidates, catalog, landed, now, days))
    new = imports.accepted(table, got, F.lit(now))
    assert new.count() == counts.get("active", 0)


def test_pages_that_share_a_url_have_their_own_responses(spark):
    links = [f"https://x.example/{i}" for i in range(4)]
    rows = [(1, "https://a.example/f", 200, links), (2, "https://a.example/f", 404, []), (3, "https://b.example/f", 404, []), (4, "https://b.example/f", 200, links)]
    responses = spark.createDataFrame(
        [(i, u, http, False, datetime(2025, 12, 31), "", "", found, [], len(found)) for i, u, http, found in rows],
        "seq long, final_url string, http_status int, bad_xml boolean, latest timestamp_ntz, feed_link string, title string, links array<string>, titles array<string>, entries int",
    )
    catalog = spark.createDataFrame([(9, "https://c.example/", "https://c.example/")], "page_id long, feed_url string, normalized_url string")
    candidates = spark.createDataFrame([(i, u) for i, u, *_ in rows], "seq long, url string")
    got = imports.classify(candidates, catalog, responses, F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz"), 150, "page_id")
    assert sorted((r.seq, r.status) for r in got.collect()) == [(1, "active"), (2, "duplicate_in_input"), (3, "dead"), (4, "duplicate_in_input")]


def test_feed_titles_with_other_references_and_cut_ones_match_the_sql(spark, tmp_path):
    import duckdb

    titles = ["a &amp;&amp", "b &quot;c&quot; &lt;d", "&", "e&am", "&#38;", "x &copy; &amp;y"]
    pages = [(i, f"https://x{i}.example/p?a=1&b={i}", f"<title>{titles[i % len(titles)]}</title>") for i in range(36)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = source_queries.src14_fn29_rss_posts(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    from linkweave import catalog

    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES['src14_fn29_rss_posts']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
