"""The reports that callers ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import aggregates, filters, joins, windows


def post_page(posts: DataFrame, post_urls: DataFrame, number: int = 1, size: int = 50, term: str | None = None, **exact) -> DataFrame:
    """RPT-1: one page of the filtered posts, newest first, with their links.

    The page is cut and fetched before the links are joined, so only its posts' links are read and gathered.
    """
    found = filters.search_posts(filters.listing_filter(posts, **exact), post_urls, term)
    page = windows.page(found, number, size, F.desc("posted_at"), F.desc("unique_id"))
    return joins.nested_urls(page, post_urls, page=True)


def post_totals(posts: DataFrame, post_urls: DataFrame, size: int = 50, term: str | None = None, **exact) -> DataFrame:
    """RPT-1, LIM-2: ``total, pages`` of the same selection."""
    found = filters.search_posts(filters.listing_filter(posts, **exact), post_urls, term)
    return found.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.ceil(F.col("total") / size), F.lit(1)))


def feed_list(feeds: DataFrame, health: DataFrame, status: str = "all", term: str | None = None) -> DataFrame:
    """RPT-2."""
    rows = filters.search_any(filters.by_status(feeds, status), term, ["feed_url"])
    rows = joins.feeds_with_health(rows, health)
    return rows.withColumns({"status": labels.status("enabled", "deleted_at"), "health": labels.health("deleted_at", "consecutive_failures", "last_status")})


def feed_page(feeds: DataFrame, health: DataFrame, number: int, size: int = 50, **selection) -> DataFrame:
    """RPT-2, LIM-2: the page nearest to the number asked for; the count and the page are two jobs."""
    rows = feed_list(feeds, health, **selection)
    at = windows.clamped_page(number, rows.count(), size)
    return windows.page(rows, at, size, F.desc("enabled"), F.col("deleted_at").isNotNull(), "feed_url")


def feed_counts(feeds: DataFrame, health: DataFrame) -> DataFrame:
    """RPT-3."""
    return aggregates.catalog_counts(joins.feeds_with_health(feeds, health), errors=True)


def source_list(catalog: DataFrame, state: DataFrame, posts: DataFrame, key: str, prefix: Column, status: str = "all", term: str | None = None) -> DataFrame:
    """RPT-4: catalog entries with their last fetch and newest post."""
    rows = filters.search_any(filters.by_status(catalog, status), term, [key]).join(state, key, "left")
    return joins.with_newest(rows, posts, F.concat(prefix, F.col(key)), F.lower("source")).withColumn("status", labels.status("enabled", "deleted_at"))


def follows_list(follows: DataFrame, posts: DataFrame, key: Column, source: Column) -> DataFrame:
    """RPT-5, RPT-6: follows with their newest post and, on each row, when the list was last synced."""
    synced = aggregates.last_synced(follows)
    return joins.with_newest(follows, posts, key, source).crossJoin(F.broadcast(synced))


def status_report(posts: DataFrame, post_urls: DataFrame, feeds: DataFrame, health: DataFrame, ledger: DataFrame) -> DataFrame:
    """RPT-7, AGG-8: counts and newest times in one row: one-row aggregates side by side."""
    bad = filters.failing(joins.feeds_with_health(feeds, health))
    return (
        posts.agg(F.count("*").alias("posts"), F.max("posted_at").alias("newest_post"))
        .crossJoin(post_urls.agg(F.count("*").alias("urls")))
        .crossJoin(filters.live(feeds).agg(F.count("*").alias("live_feeds")))
        .crossJoin(bad.agg(F.count("*").alias("failing_feeds")))
        .crossJoin(ledger.agg(F.count("*").alias("batches"), F.max("published_at").alias("last_published")))
    )
