"""Orders, limits of age and rules of imports over views of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, urls
from ..operators import aggregates, filters, merges, windows
from . import imports
from .merge_queries import FOLLOWS_SQL, synced_follows
from .registered import query
from .views import FEEDS_SQL, VOLUME_SQL, WEB_SQL, feeds, moment, table, volume_posts, web_posts

KEY_SQL = r"""lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END || regexp_extract(url, '(\?[^#]*)', 1)"""


@query(f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN {KEY_SQL} WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'https://h' || page_id || '.example/' ELSE 'http://h' || page_id || '.example:8080/A?b' END AS key FROM pages")
def fn09_absolute_feed_url(spark, sf):
    m, page = F.col("page_id") % 5, F.col("page_id").cast("string")
    given = (
        F.when(m == 0, F.concat(F.lit("\t"), "url", F.lit(" \n")))
        .when(m == 1, F.concat(F.lit("ftp://"), page))
        .when(m == 2, F.concat(page, F.lit(".example/feed")))
        .when(m == 3, F.concat(F.lit("HTTPS://H"), page, F.lit(".Example:443")))
        .otherwise(F.concat(F.lit("http://h"), page, F.lit(".example:8080/A?b#c")))
    )
    return table(spark, sf, "pages").select("page_id", urls.absolute_feed_url(given).alias("key"))


@query(
    r"""SELECT page_id, 'https://h' || page_id || '.example/p' AS feed_link, 'a title ' || page_id AS title,
      array_to_string([CASE WHEN i % 2 = 0 THEN 'https://x.example/' || page_id || '/' || i ELSE 'http://y.example/?q=' || i END FOR i IN range(page_id % 14) IF i < 10 AND i % 5 <> 4], ' ') AS links,
      array_to_string(['t ' || i FOR i IN range(page_id % 14) IF i < 10 AND i % 5 <> 4], '|') AS titles FROM pages"""
)
def fn41_entry_links_and_titles(spark, sf):
    """Links and titles in other forms than their keys; every fifth entry has neither."""
    page = F.col("page_id").cast("string")
    entries = F.when(F.col("page_id") % 14 > 0, F.sequence(F.lit(0), (F.col("page_id") % 14 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    link = lambda i: F.when(i % 5 == 4, "  ").when(i % 2 == 0, F.concat(F.lit(" HTTPS://www.X.example/"), page, F.lit("/"), i.cast("string"), F.lit("//#top"))).otherwise(F.concat(F.lit("http://Y.example?q="), i.cast("string")))
    title = lambda i: F.when(i % 5 == 4, "\t").otherwise(F.concat(F.lit("\tT \n "), i.cast("string")))
    responses = table(spark, sf, "pages").select(
        "page_id", "url", F.col("url").alias("final_url"), F.lit(200).alias("http_status"), F.lit(False).alias("bad_xml"), moment("2026-01-01").alias("latest"), F.concat(F.lit("https://www.h"), page, F.lit(".example/p/")).alias("feed_link"),
        F.concat(F.lit(" A  Title\n"), page).alias("title"), F.transform(entries, link).alias("links"), F.transform(entries, title).alias("titles"), F.size(entries).alias("entries"),
    )
    by_page = responses.withColumn("url", F.concat(F.lit("https://c.example/"), page))
    checked = imports.check(by_page.select(F.col("page_id").alias("seq"), "url"), by_page.drop("page_id"), moment("2026-01-01"), 365)
    return checked.select(F.col("seq").alias("page_id"), "feed_link", "title", F.array_join("links", " ").alias("links"), F.array_join("titles", "|").alias("titles"))


@query("SELECT event_id FROM events WHERE event_id % 9 = 0 OR ts >= (SELECT max(date_trunc('day', ts)) FROM events) - INTERVAL 1 MONTH")
def fil02_age_limit(spark, sf):
    """Not older than a month before the last day; every ninth date can't be parsed and stays."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    last = e.agg(F.max(F.date_trunc("day", "ts")).cast("timestamp_ntz").alias("now"))
    dated = e.withColumn("posted_at", F.when(F.col("event_id") % 9 != 0, F.col("ts"))).crossJoin(F.broadcast(last))
    return filters.age_limit(dated, F.col("now"), 1).select("event_id")


@query("WITH " + FEEDS_SQL + "SELECT count(*) AS n FROM feeds WHERE enabled AND deleted_at IS NULL AND contains(feed_url, '1')")
def agg04_filtered_feed_count(spark, sf):
    return aggregates.count_rows(filters.search_any(filters.by_status(feeds(spark, sf), "active"), "1", ["feed_url"]))


@query("WITH " + WEB_SQL + "SELECT unique_id, epoch(posted_at)::BIGINT AS seconds FROM posts ORDER BY posted_at DESC, unique_id DESC")
def srt1_newest_first(spark, sf):
    return windows.newest_first(web_posts(spark, sf)).select("unique_id", F.unix_seconds(F.col("posted_at").cast("timestamp")).alias("seconds"))


@query("WITH " + FEEDS_SQL + "SELECT feed_url, enabled, deleted_at IS NOT NULL AS removed FROM feeds ORDER BY enabled DESC, deleted_at IS NOT NULL, feed_url")
def srt2_catalog_order(spark, sf):
    return windows.catalog_order(feeds(spark, sf), "feed_url").select("feed_url", "enabled", F.col("deleted_at").isNotNull().alias("removed"))


@query("WITH " + FOLLOWS_SQL + "SELECT instance_name, acct FROM follows ORDER BY lower(instance_name), lower(acct)")
def srt4_follows_order(spark, sf):
    return windows.follows_order(synced_follows(spark, sf)[0], "instance_name", "acct").select("instance_name", "acct")


@query("WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[^ ]+')) AS word FROM documents) SELECT word, word < 'a' AS before_a, word >= '\u007f' AS beyond_ascii FROM w ORDER BY word")
def srt5_byte_order(spark, sf):
    """Words in the order of their bytes, whatever the language: capitals before small letters, others after both."""
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([^ ]+)"), F.lit(1))).alias("word")).distinct()
    return words.orderBy("word").select("word", (F.col("word") < "a").alias("before_a"), (F.col("word") >= "\u007f").alias("beyond_ascii"))


@query("WITH " + VOLUME_SQL + "SELECT source, count(*) AS n, count(*) FILTER (WHERE posted_at < DATE '1997-01-01') AS old FROM posts WHERE posted_at >= TIMESTAMP '1998-08-01' - INTERVAL 900 DAY GROUP BY source")
def ups18_retain_batches(spark, sf):
    """Applied batches of the last 900 days; a name without an instant would stay."""
    b = volume_posts(spark, sf).select("source", F.col("posted_at").cast("timestamp_ntz").alias("at"))
    kept = merges.retain_batches(b, F.col("at"), moment("1998-08-01"), 900)
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("at") < moment("1997-01-01")).alias("old"))


@query(
    """SELECT page_id, 'Hello ' || page_id || ' deep link tail' || CASE WHEN page_id % 2 = 0 THEN ' open' ELSE '' END AS text, 'Hello ' || page_id || ' tail' AS outside,
      'https://a.example/' || page_id || '?x=1&y=2 https://b.example/' || CASE WHEN page_id % 2 = 0 THEN ' https://c.example/' ELSE '' END AS links FROM pages"""
)
def fn22_fragments(spark, sf):
    """Nested anchors, one without a link, references in links, and an anchor that isn't closed."""
    page = F.col("page_id").cast("string")
    content = F.concat(
        F.lit("<p>Hello "), page, F.lit('</p><a href="https://a.example/'), page, F.lit('?x=1&amp;y=2"> deep <a href="https://b.example/"></a>link</a><a name="n"></a></a> tail <br>'),
        F.when(F.col("page_id") % 2 == 0, '<A HREF="https://c.example/">open').otherwise(""),
    )
    parts = html.status_parts(table(spark, sf, "pages").select("page_id", content.alias("content")), "content")
    return parts.select("page_id", F.col("parts.text").alias("text"), F.col("parts.outside").alias("outside"), F.array_join("parts.links", " ").alias("links"))
