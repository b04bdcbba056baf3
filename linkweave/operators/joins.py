"""Joins of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, urls


def feeds_with_health(feeds: DataFrame, health: DataFrame) -> DataFrame:
    """JN-1: by the natural key, so health outlives removing and adding a feed."""
    return feeds.join(health, "normalized_url", "left")


def nested_urls(posts: DataFrame, post_urls: DataFrame, key: str = "unique_id", page: bool = False) -> DataFrame:
    """JN-3: each post with its links by position.

    ``page``: the posts are a page, so few that they are fetched once; their keys then reach the scan of the links as a filter,
    and neither the posts nor the search for them is computed again.
    """
    own = post_urls
    if page:
        rows = posts.collect()
        posts = posts.sparkSession.createDataFrame(rows, posts.schema)
        own = post_urls.where(F.col(key).isin([r[key] for r in rows]))
    else:
        own = post_urls.join(posts.select(key), key, "left_semi")
    links = F.array_sort(F.collect_list(F.struct("position", "url", labels.displayed_link("unshortened_url", "url").alias("shown"))))
    nested = own.groupBy(key).agg(links.alias("links"))
    return posts.join(nested, key, "left").withColumn("links", F.coalesce("links", F.array().cast(nested.schema["links"].dataType)))


def newest_by_source(posts: DataFrame, source: Column) -> DataFrame:
    """JN-5..7, AGG-5: ``key, newest_at, source``: newest post of each source; the least source stands for equal keys."""
    return posts.groupBy(source.alias("key")).agg(F.max("posted_at").alias("newest_at"), F.min("source").alias("source"))


def with_newest(rows: DataFrame, posts: DataFrame, key: Column, source: Column) -> DataFrame:
    """JN-2, JN-5..7: rows with the time of their source's newest post; a null key never matches."""
    newest = newest_by_source(posts, source).select(F.col("key").alias("_key"), "newest_at")
    return rows.join(newest, key == F.col("_key"), "left").drop("_key")


def links_of_posts(posts: DataFrame, post_urls: DataFrame, key: str = "unique_id") -> DataFrame:
    """JN-8."""
    return post_urls.join(posts.select(key), key)


def keep_children(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """JN-12: child rows whose parent is still there."""
    return children.join(parents.select(key), key, "left_semi")


def classify_candidates(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """JN-9: ``seq, url, key, status``: present, duplicate-in-input or new.

    ``candidates``: ``seq, url``; ``existing``: ``normalized_url``, removed feeds included.
    """
    keyed = candidates.withColumn("key", urls.normalize_feed_url("url"))
    first = keyed.groupBy("key").agg(F.min("seq").alias("first"))
    known = existing.select(F.col("normalized_url").alias("key")).distinct().withColumn("known", F.lit(True))
    out = keyed.join(first, "key").join(known, "key", "left")
    return out.select("seq", "url", "key", F.when(F.col("known"), "present").when(F.col("seq") > F.col("first"), "duplicate_in_input").otherwise("new").alias("status"))


def _subsets(values: Column, size: int) -> Column:
    """All subsets of ``size`` (2 or 3) of a sorted array without repeats, each as the digest of its members."""
    after = lambda i: F.slice(values, i + 2, F.size(values))
    digest = lambda *members: F.unhex(F.md5(F.concat_ws("\n", *members)))
    if size == 2:
        return F.flatten(F.transform(values, lambda x, i: F.transform(after(i), lambda y: digest(x, y))))
    triples = F.transform(values, lambda x, i: F.transform(after(i), lambda y, j: F.transform(after(i + j + 1), lambda z: digest(x, y, z))))
    return F.flatten(F.flatten(triples))


def _duplicate_keys(feeds: DataFrame, *keep: str) -> DataFrame:
    """``keep, site, rank, key``: two feeds of a site meet a rule just if they have a key of its rank in common."""
    one = lambda c: F.when(c != "", F.array(F.unhex(F.md5(c))))
    distinct = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.col(c))))
    titled = F.when(F.col("title") != "", F.transform(_subsets(distinct("titles"), 2), lambda k: F.unhex(F.md5(F.concat(k, F.col("title").cast("binary"))))))
    keys = {1: one(F.col("feed_key")), 2: one(F.col("feed_link")), 3: one(F.try_element_at("links", F.lit(1))), 4: _subsets(distinct("links"), 3), 5: titled}
    none = F.array().cast("array<binary>")
    ranked = lambda rank: lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("key"))
    each = F.flatten(F.array(*(F.transform(F.coalesce(k, none), ranked(rank)) for rank, k in keys.items())))
    return feeds.select(*keep, "site", F.explode(each).alias("k")).select(*keep, "site", "k.rank", "k.key")


#: Reasons by rank.
REASONS = ("same feed", "same channel link", "same newest link", "shared links", "shared titles")


def content_duplicates(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """JN-10, SET-2: ``id, duplicate_of, reason`` of active candidates that repeat a feed of their site.

    Both: ``id, site, status, feed_key, feed_link, title, links, titles``; ``existing`` also ``seq``. The first matching
    feed in order of ``seq`` counts, and the first rule that it meets. Feeds share three links just if they share a subset
    of three, so each feed has at most 120 such keys (of ten links) and 45 of two titles, and of the feeds with one key only the first two
    are looked at (two, as a candidate doesn't repeat itself): the work is linear in the feeds, whatever a whole site has in common.
    """
    c = candidates.where("status = 'active' and site <> ''")
    e = existing.where(F.col("status").isin("active", "abandoned", "unknown_date")).withColumnsRenamed({"id": "e_id", "seq": "e_seq"})
    of_id = _duplicate_keys(e, "e_id", "e_seq").groupBy("site", "rank", "key", "e_id").agg(F.min("e_seq").alias("e_seq"))
    place = F.row_number().over(Window.partitionBy("site", "rank", "key").orderBy("e_seq", "e_id"))
    first = of_id.withColumn("_n", place).where("_n <= 2").groupBy("site", "rank", "key").agg(F.array_sort(F.collect_list(F.struct("e_seq", "e_id"))).alias("es"))
    hits = _duplicate_keys(c, "id").join(first, ["site", "rank", "key"]).select("id", "rank", F.try_element_at(F.filter("es", lambda x: x["e_id"] != F.col("id")), F.lit(1)).alias("e"))
    best = hits.where("e is not null").groupBy("id").agg(F.min(F.struct("e.e_seq", "rank", "e.e_id")).alias("b"))
    return best.select("id", F.col("b.e_id").alias("duplicate_of"), F.element_at(F.array(*map(F.lit, REASONS)), F.col("b.rank")).alias("reason"))


def feeds_with_validators(feeds: DataFrame, cache: DataFrame) -> DataFrame:
    """JN-11: etag and last_modified of the last fetch."""
    return feeds.join(cache.select("normalized_url", "etag", "last_modified"), "normalized_url", "left")
