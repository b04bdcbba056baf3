"""Counters, ledgers and state of collection cycles over views of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, labels, urls
from ..operators import aggregates, filters, merges, sinks, windows
from .registered import query
from .report_queries import SUBS_SQL, subreddits
from .views import CHECKPOINT_SQL, FEEDS_SQL, OBS_SQL, WEB_SQL, checkpoint_records, feeds, moment, observations, table, web_posts


@query("WITH " + WEB_SQL + "SELECT source_type, count(*) AS n FROM posts GROUP BY source_type")
def agg01_post_counts(spark, sf):
    posts = web_posts(spark, sf)
    parts = [aggregates.count_rows(filters.listing_filter(posts, source_type=t)).withColumn("source_type", F.lit(t)) for t in filters.SOURCE_TYPES]
    return windows.union_results(parts).where("n > 0")


@query(
    """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE coalesce(text, '') END AS description, doc_id % 5 <> 0 AS linked FROM documents),
    m AS (SELECT *, description = '' AS missing, regexp_matches(lower(description), '(^|[^\\p{L}\\p{N}_])(and)($|[^\\p{L}\\p{N}_])') AS hit FROM p)
    SELECT count(*) AS read, count(*) FILTER (WHERE NOT missing AND NOT linked) AS without_links, count(*) FILTER (WHERE missing) AS missing_fields,
      count(*) FILTER (WHERE NOT missing AND linked AND hit) AS filtered, count(*) FILTER (WHERE NOT missing AND linked AND NOT hit) AS kept FROM m"""
)
def agg12_skip_counters(spark, sf):
    link = F.when(F.col("doc_id") % 5 != 0, F.array(F.lit("https://x.example/"))).otherwise(F.array().cast("array<string>"))
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "").otherwise(labels.clean("text")).alias("description"), link.alias("urls"))
    kept = filters.drop_posts(filters.with_urls(d.where("description <> ''")), ["and"])
    return aggregates.skip_counters(d, kept, "doc_id", ["description"])


@query("WITH " + WEB_SQL + "SELECT sum(len(list_filter(urls, lambda u: contains(regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1), 'blog'))))::BIGINT AS removed FROM posts")
def agg12_removed_urls(spark, sf):
    posts = web_posts(spark, sf)
    return aggregates.removed_urls(posts, filters.drop_hosts(posts, ["blog"]))


@query(
    """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS unique_id, 'b' || (doc_id % 10) AS batch_id, doc_id % 3 + 1 AS n FROM documents),
    new AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY doc_id) = 1)
    SELECT batch_id, count(*) AS record_count, (SELECT count(*) FROM new WHERE new.batch_id = d.batch_id) AS posts_inserted, (SELECT coalesce(sum(n), 0) FROM new WHERE new.batch_id = d.batch_id)::BIGINT AS urls_inserted FROM d GROUP BY batch_id"""
)
def ups10_ledger_counts(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.sha2(labels.clean("text"), 256).alias("unique_id"), F.concat(F.lit("b"), (F.col("doc_id") % 10).cast("string")).alias("batch_id"),
        F.transform(F.sequence(F.lit(0), F.col("doc_id") % 3), lambda i: F.concat(F.lit("https://x.example/"), i.cast("string"))).alias("urls"),
    )
    new = merges.insert_ignore(d.limit(0).select("unique_id"), d, "unique_id", "doc_id")
    entries = merges.ledger_entries(d.select("batch_id").distinct(), d, new, merges.urls_of(new), moment("2026-01-01"))
    return entries.select("batch_id", "record_count", "posts_inserted", "urls_inserted")


@query(
    "WITH " + OBS_SQL + "," + CHECKPOINT_SQL + "," + FEEDS_SQL + """, live AS (SELECT normalized_url, user_id FROM feeds WHERE enabled AND deleted_at IS NULL),
    l AS (SELECT normalized_url, arg_max({'e': etag, 'm': last_modified}, seq) AS v FROM obs WHERE success GROUP BY normalized_url),
    v AS (SELECT normalized_url AS key, coalesce(v['e'], '') || '/' || coalesce(v['m'], '') AS value FROM l JOIN live USING (normalized_url) WHERE v['e'] IS NOT NULL OR v['m'] IS NOT NULL),
    c AS (SELECT source_type || '/' || source_key AS key, arg_max(cursor, seq) AS value FROM cp WHERE source_key IN (SELECT CAST(user_id AS VARCHAR) FROM live) GROUP BY source_type, source_key)
    SELECT * FROM v UNION ALL SELECT * FROM c"""
)
def ups21_set4_advance_state(spark, sf):
    o, c, live = observations(spark, sf), checkpoint_records(spark, sf), filters.live(feeds(spark, sf))
    keys = live.select(F.col("user_id").cast("string").alias("source_key")).join(c.select("source_type").distinct(), how="cross")
    cache, cursors = merges.advance_state(o.limit(0).select("normalized_url", "etag", "last_modified"), c.limit(0).select("source_type", "source_key", "cursor"), o, c, live, keys)
    shown = cache.select(F.col("normalized_url").alias("key"), F.concat(labels.clean("etag"), F.lit("/"), labels.clean("last_modified")).alias("value"))
    return shown.union(cursors.select(F.concat("source_type", F.lit("/"), "source_key"), "cursor"))


@query(
    "WITH " + FEEDS_SQL + "," + SUBS_SQL + """SELECT 1 AS catalog_version, (SELECT string_agg(normalized_url || ' ' || feed_url, ',' ORDER BY normalized_url) FROM feeds WHERE enabled AND deleted_at IS NULL) AS rss_feeds,
    (SELECT string_agg(name, ',' ORDER BY name) FROM subs WHERE enabled AND deleted_at IS NULL) AS subreddits"""
)
def snk03_catalog_snapshot(spark, sf):
    f, s = filters.live(feeds(spark, sf)), filters.live(subreddits(spark, sf)).select(F.col("name").alias("normalized_name"), "name")
    row = sinks.catalog_snapshot(f, s, moment("2026-01-01"), aggregates.catalog_revision(f, s))
    return row.select(
        "catalog_version",
        F.array_join(F.transform("rss_feeds", lambda x: F.concat(x["normalized_url"], F.lit(" "), x["feed_url"])), ",").alias("rss_feeds"),
        F.nullif(F.array_join(F.transform("subreddits", lambda x: x["name"]), ","), F.lit("")).alias("subreddits"),
    )


@query(
    """WITH r AS (SELECT doc_id AS seq, lower(source) || (doc_id % 3) AS k, doc_id % 11 <> 0 AND source IS NOT NULL AS ok FROM documents)
    SELECT seq, CASE WHEN NOT ok THEN 'invalid' WHEN k IN (SELECT lower(source) || '1' FROM documents WHERE source IS NOT NULL) OR seq > min(seq) FILTER (WHERE ok) OVER (PARTITION BY k) THEN 'exists' ELSE 'added' END AS result FROM r"""
)
def ups13_add_subreddits(spark, sf):
    d = table(spark, sf, "documents")
    known = d.where("source is not null").select(urls.normalize_subreddit_name(F.concat(F.lit("R/"), "source", F.lit("1"))).alias("normalized_name")).distinct()
    name = F.when(F.col("doc_id") % 11 == 0, "not valid!").otherwise(F.concat(F.lit("/r/"), "source", (F.col("doc_id") % 3).cast("string")))
    requests = d.select(F.col("doc_id").alias("seq"), name.alias("name")).withColumn("normalized_name", urls.normalize_subreddit_name("name"))
    return merges.add_to_catalog(known, requests, "normalized_name", urls.valid_subreddit_name("name") & F.col("name").isNotNull()).select("seq", "result")


@query(
    r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/rss' WHEN page_id % 3 = 1 THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/atom' ELSE '' END AS feed FROM pages"""
)
def fn30_discovered_feed(spark, sf):
    m, feed = F.col("page_id") % 3, F.lit('<link rel="alternate" type="application/rss+xml" href="/old">')
    head = F.concat(F.when(m == 2, "").otherwise('<link rel="alternate" type="application/atom+xml" href="/atom">'), F.when(m == 0, '<link href="/rss" type="application/rss+xml" rel="alternate">').otherwise(""))
    # a feed that a page has in a comment or a script only isn't one it names
    quoted = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<!-- "), feed, F.lit(" -->"))).otherwise(F.concat(F.lit("<script>'"), feed, F.lit("'</script>")))
    return table(spark, sf, "pages").select("page_id", html.discovered_feed(F.concat(quoted, head, "html"), "url").alias("feed"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS scope, max(c_custkey) AS seq FROM customer GROUP BY 1")
def set1_last_snapshots(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("mastodon").alias("source_type"), F.col("c_nationkey").cast("string").alias("scope"), F.col("c_custkey").alias("seq"), "c_name")
    return windows.last_snapshots(c).select("scope", "seq")
