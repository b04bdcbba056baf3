"""Filters on posts, listings and catalogs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, times, urls

SOURCE_TYPES = ("rss", "reddit", "bluesky", "mastodon")


def with_urls(posts: DataFrame) -> DataFrame:
    """FIL-1: posts that have a URL."""
    return posts.where(F.size("urls") > 0)


def age_limit(posts: DataFrame, now: Column, months: int = 3, column: str = "posted_at") -> DataFrame:
    """FIL-2: not older than so many months; a null (unparseable) date stays. The boundary stays too."""
    return posts.where(F.col(column).isNull() | (F.col(column) >= now - F.make_ym_interval(F.lit(0), F.lit(months))))


def drop_hosts(posts: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """FIL-3: URLs on matching hosts go, unique_id follows, posts without URLs go."""
    kept = F.filter("urls", lambda u: ~urls.host_matches(u, keywords))
    return with_urls(posts.withColumn("urls", kept)).withColumn("unique_id", urls.unique_id("urls"))


def drop_posts(posts: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """FIL-4: posts with a matching URL or a matching whole word in the description go."""
    keywords = list(keywords)
    return posts.where(~(urls.text_matches("description", keywords) | F.exists("urls", lambda u: urls.url_matches(u, keywords))))


def clean_posts(posts: DataFrame, now: Column, months: int, host_keywords: Iterable[str], post_keywords: Iterable[str]) -> DataFrame:
    """FIL-5: the fixed order: URLs, age, hosts, words, then future dates become now."""
    kept = drop_posts(drop_hosts(age_limit(with_urls(posts), now, months), host_keywords), post_keywords)
    return kept.withColumn("posted_at", times.clamp_future("posted_at", now))


def before_cursor(rows: DataFrame, key: str, position: str, is_cursor: Column) -> DataFrame:
    """FIL-6: of each key the rows before the first cursor row; all rows if it never comes."""
    cut = F.min(F.when(is_cursor, F.col(position))).over(Window.partitionBy(key))
    return rows.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col(position) < F.col("_cut"))).drop("_cut")


def listing_filter(posts: DataFrame, source: str | None = None, source_type: str | None = None, author: str | None = None) -> DataFrame:
    """FIL-7: exact values, trimmed to 200 characters, combined by AND; an unknown source type filters nothing."""
    for column, value in (("source", source), ("author", author)):
        if value and value.strip():
            posts = posts.where(F.col(column) == value.strip()[:200])
    if source_type in SOURCE_TYPES:
        posts = posts.where(F.col("source_type") == source_type)
    return posts


def live(catalog: DataFrame) -> DataFrame:
    """FIL-8."""
    return catalog.where(F.col("enabled") & F.col("deleted_at").isNull())


def search_posts(posts: DataFrame, post_urls: DataFrame, term: str | None, key: str = "unique_id") -> DataFrame:
    """FIL-9, JN-4: the term in a post's own fields or in one of its URLs. The URLs are reduced to keys first."""
    if not term or not term.strip():
        return posts
    own = F.lit(False)
    for column in ("description", "source", "author", "direct_link"):
        own = own | labels.contains_literal(column, term)
    hits = post_urls.where(labels.contains_literal("url", term) | labels.contains_literal("unshortened_url", term)).select(key).distinct().withColumn("_hit", F.lit(True))
    return posts.join(hits, key, "left").where(own | F.col("_hit").isNotNull()).drop("_hit")


def by_status(catalog: DataFrame, status: str = "all") -> DataFrame:
    """FIL-10."""
    return catalog if status == "all" else catalog.where(labels.status("enabled", "deleted_at") == status)


def failing(feeds: DataFrame) -> DataFrame:
    """FIL-11: live feeds with failures or a bad status."""
    return live(feeds).where((F.coalesce("consecutive_failures", F.lit(0)) > 0) | (F.coalesce("last_status", F.lit(0)) >= 400))


def search_any(rows: DataFrame, term: str | None, columns: Iterable[str]) -> DataFrame:
    """FIL-12."""
    if not term or not term.strip():
        return rows
    hit = F.lit(False)
    for column in columns:
        hit = hit | labels.contains_literal(column, term)
    return rows.where(hit)


def candidate_status(http_status: Column, bad_xml: Column, entries: Column, latest: Column, now: Column, days: int) -> Column:
    """FIL-13: dead, unknown_date, abandoned or active, in the order of the tests."""
    old = latest < now - F.make_dt_interval(F.lit(days))
    none = F.coalesce(entries, F.lit(0)) == 0
    return (
        F.when(http_status.isNull() | (http_status >= 400), "dead")
        .when(F.coalesce(bad_xml, F.lit(False)) & none | none, "dead")
        .when(latest.isNull(), "unknown_date")
        .when(old, "abandoned")
        .otherwise("active")
    )
