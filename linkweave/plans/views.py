"""The library's tables as views of the given ones, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import html, urls
from ..operators.windows import first_wins

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso(column: str):
    return F.date_format(column, ISO)


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SRC-20: a scan; filters and column lists reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def web_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts from pages: links resolved on the page, newest page last; a repeated set of links is one post."""
    pages = table(spark, sf_dir, "pages")
    posts = pages.select(
        "page_id",
        F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1).alias("source"),
        F.element_at(F.array(*map(F.lit, ("rss", "reddit", "bluesky", "mastodon"))), (F.col("page_id") % 4 + 1).cast("int")).alias("source_type"),
        urls.canonical_hostname("url").alias("author"),
        html.title("html").alias("description"),
        F.col("url").alias("direct_link"),
        (moment("2026-01-01") + F.make_dt_interval(F.lit(0), F.col("page_id").cast("int"))).alias("posted_at"),
        urls.add_urls(html.anchor_hrefs("html"), "url").alias("urls"),
    )
    posts = posts.where(F.size("urls") > 0).withColumn("unique_id", urls.unique_id("urls"))
    return first_wins(posts, "unique_id", "page_id")


WEB_SQL = r"""
raw_posts AS (
  SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS source,
    ['rss', 'reddit', 'bluesky', 'mastodon'][CAST(page_id % 4 AS INT) + 1] AS source_type,
    regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') AS author,
    regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS description, url AS direct_link,
    TIMESTAMP '2026-01-01' + to_hours(CAST(page_id AS INT)) AS posted_at,
    list_transform(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1), lambda h: regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || h) AS found
  FROM pages
), id_posts AS (
  SELECT *, sha256(array_to_string(list_sort(urls), ',')) AS unique_id
  FROM (SELECT * EXCLUDE found, list_filter(found, lambda x, i: list_position(found, x) = i) AS urls FROM raw_posts)
  WHERE len(urls) > 0
), posts AS (
  SELECT * FROM id_posts QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY page_id) = 1
), post_urls AS (
  SELECT unique_id, CAST(i - 1 AS INT) AS position, urls[i] AS url, sha256(urls[i]) AS url_hash,
    CASE WHEN (i - 1) % 3 = 0 THEN replace(urls[i], 'http://', 'https://') WHEN (i - 1) % 3 = 1 THEN '' END AS unshortened_url
  FROM (SELECT unique_id, urls, unnest(range(1, len(urls) + 1)) AS i FROM posts)
)
"""


def web_urls(posts: DataFrame) -> DataFrame:
    """Links of web posts; every third is resolved, every third has an empty resolution."""
    rows = posts.select("unique_id", F.posexplode("urls").alias("position", "url"))
    resolved = F.when(F.col("position") % 3 == 0, F.replace("url", F.lit("http://"), F.lit("https://"))).when(F.col("position") % 3 == 1, "")
    return rows.withColumns({"url_hash": F.sha2("url", 256), "unshortened_url": resolved})


def volume_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("unique_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("posted_at"))


def volume_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    link = F.concat(F.lit("https://parts.example/"), F.col("l_partkey").cast("string"))
    return li.select(F.col("l_orderkey").alias("unique_id"), F.col("l_linenumber").alias("position"), link.alias("url"), F.lit(None).cast("string").alias("unshortened_url"))


VOLUME_SQL = """
posts AS (SELECT o_orderkey AS unique_id, o_orderpriority AS source, o_orderdate AS posted_at FROM orders),
post_urls AS (SELECT l_orderkey AS unique_id, l_linenumber AS position, 'https://parts.example/' || l_partkey AS url FROM lineitem)
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch observations from events; every fifth arrives 400 later."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ok = F.col("event_type") != "error"
    return e.select(
        F.concat(F.lit("https://feed"), F.col("user_id").cast("string"), F.lit(".example/rss")).alias("normalized_url"),
        "user_id",
        F.col("ts").cast("timestamp_ntz").alias("observed_at"),
        ok.alias("success"),
        F.when(~ok, 500).when(F.col("event_type") == "view", 304).otherwise(200).alias("status"),
        F.when(~ok, F.concat(F.lit("failed "), k.cast("string"))).alias("error"),
        F.when(k % 3 != 0, F.concat(F.lit("e"), k.cast("string"))).alias("etag"),
        F.when(k % 4 == 0, F.concat(F.lit("m"), k.cast("string"))).alias("last_modified"),
        F.when((F.col("event_type") != "view") & (k % 2 == 1), F.col("ts").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), k)).alias("latest_entry_at"),
        F.when((F.col("event_type") != "view") & (k % 5 != 0), F.concat(F.lit("https://site"), k.cast("string"), F.lit(".example/"))).alias("site_link"),
        (F.col("event_id") + F.when(F.col("event_id") % 5 == 0, 400).otherwise(0)).alias("seq"),
        "event_id",
        "event_type",
    )


OBS_SQL = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
obs AS (
  SELECT 'https://feed' || user_id || '.example/rss' AS normalized_url, user_id, ts AS observed_at, event_type <> 'error' AS success,
    CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 304 ELSE 200 END AS status,
    CASE WHEN event_type = 'error' THEN 'failed ' || k END AS error,
    CASE WHEN k % 3 <> 0 THEN 'e' || k END AS etag, CASE WHEN k % 4 = 0 THEN 'm' || k END AS last_modified,
    CASE WHEN event_type <> 'view' AND k % 2 = 1 THEN ts - to_hours(k) END AS latest_entry_at,
    CASE WHEN event_type <> 'view' AND k % 5 <> 0 THEN 'https://site' || k || '.example/' END AS site_link,
    event_id + CASE WHEN event_id % 5 = 0 THEN 400 ELSE 0 END AS seq, event_id, event_type
  FROM ev
)
"""
FOLD_SQL = """
barred AS (
  SELECT *, max(observed_at) OVER (PARTITION BY normalized_url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bar FROM obs
), accepted AS (
  SELECT *, max(seq) FILTER (WHERE success) OVER (PARTITION BY normalized_url) AS last_ok FROM barred WHERE bar IS NULL OR observed_at >= bar
), health AS (
  SELECT normalized_url,
    arg_max(observed_at, seq) AS last_fetched_at, max_by({'v': observed_at}, seq) FILTER (WHERE success) ['v'] AS last_success_at,
    arg_max(status, seq) AS last_status, max_by({'v': error}, seq) ['v'] AS last_error,
    count(*) FILTER (WHERE NOT success AND (last_ok IS NULL OR seq > last_ok)) AS consecutive_failures,
    max_by({'v': etag}, seq) FILTER (WHERE success) ['v'] AS etag,
    max_by({'v': last_modified}, seq) FILTER (WHERE success) ['v'] AS last_modified,
    max_by(latest_entry_at, seq) FILTER (WHERE success AND latest_entry_at IS NOT NULL) AS latest_entry_at,
    max_by(site_link, seq) FILTER (WHERE success AND site_link IS NOT NULL) AS site_link
  FROM accepted GROUP BY normalized_url
)
""".replace(") ['v']", ")['v']").replace("max_by({'v': error}, seq) ['v']", "max_by({'v': error}, seq)['v']")


def empty_health(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.HEALTH)


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of the events' users: every fifth disabled, every seventh removed."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return u.select(
        F.concat(F.lit("https://feed"), F.col("user_id").cast("string"), F.lit(".example/rss")).alias("normalized_url"),
        F.concat(F.lit("HTTPS://feed"), F.col("user_id").cast("string"), F.lit(".example/rss")).alias("feed_url"),
        (F.col("user_id") % 5 != 0).alias("enabled"),
        F.when(F.col("user_id") % 7 == 0, moment("2026-01-01")).alias("deleted_at"),
        "user_id",
    )


FEEDS_SQL = """
feeds AS (
  SELECT DISTINCT 'https://feed' || user_id || '.example/rss' AS normalized_url, 'HTTPS://feed' || user_id || '.example/rss' AS feed_url,
    user_id % 5 <> 0 AS enabled, CASE WHEN user_id % 7 = 0 THEN TIMESTAMP '2026-01-01' END AS deleted_at, user_id FROM events
)
"""


def follows_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follows from customers: nation is the instance, three snapshots of each."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_nationkey").cast("string").alias("scope"),
        (F.col("c_custkey") % 3).cast("string").alias("snapshot_id"),
        F.concat(F.lit("id"), (F.col("c_custkey") % 400).cast("string")).alias("account_id"),
        F.col("c_name").alias("acct"),
        F.col("c_custkey").alias("line"),
    )


def follows_snapshots(rows: DataFrame) -> DataFrame:
    """Snapshot 1 is the newest by time, but arrives before snapshot 2."""
    at = F.when(F.col("snapshot_id") == "1", moment("2026-01-03")).when(F.col("snapshot_id") == "2", moment("2026-01-02")).otherwise(moment("2026-01-01"))
    counts = rows.groupBy("scope", "snapshot_id").agg(F.count("*").alias("record_count"))
    return counts.select("scope", "snapshot_id", at.alias("observed_at"), "record_count", F.col("snapshot_id").cast("long").alias("seq"))


def checkpoint_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    return o.select(F.col("event_type").alias("source_type"), F.col("user_id").cast("string").alias("source_key"), F.col("event_id").cast("string").alias("cursor"), F.date_trunc("day", "observed_at").cast("timestamp_ntz").alias("observed_at"), "seq")


CHECKPOINT_SQL = """
cp AS (
  SELECT event_type AS source_type, CAST(user_id AS VARCHAR) AS source_key, CAST(event_id AS VARCHAR) AS cursor, date_trunc('day', ts) AS observed_at,
    event_id + CASE WHEN event_id % 5 = 0 THEN 400 ELSE 0 END AS seq FROM events
)
"""
