"""Landed provider payloads -> posts: ``source, source_type, author, description, direct_link, posted_at, urls``."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html, labels, times, urls
from . import feeds

REDDIT = "data struct<after:string,children:array<struct<data:struct<id:string,name:string,subreddit_name_prefixed:string,author:string,title:string,permalink:string,created_utc:double,url:string>>>>"
BLUESKY = (
    "feed array<struct<post:struct<uri:string,author:struct<handle:string,displayName:string,did:string>,"
    "record:struct<text:string,createdAt:string,facets:array<struct<features:array<struct<uri:string>>>>>,embed:string>>>, cursor string"
)
MASTODON = "array<struct<id:string,created_at:string,url:string,uri:string,content:string,card:struct<url:string>,account:struct<url:string,display_name:string,acct:string,username:string>>>"
BLUESKY_FOLLOWS = "follows array<struct<did:string,handle:string,displayName:string>>"
MASTODON_ACCOUNTS = "array<struct<id:string,acct:string,username:string,display_name:string,url:string>>"


def finished(posts: DataFrame) -> DataFrame:
    """FIL-1, FN-5: posts with URLs, and their id."""
    return posts.where(F.size("urls") > 0).withColumn("unique_id", urls.unique_id("urls"))


def rss_posts(bodies: DataFrame, now: Column) -> DataFrame:
    """SRC-14: ``bodies (feed_url, body)`` of RSS 0.9 to 2.0 or Atom; one post for each entry with a usable URL.

    An entry's link is resolved on the channel's link, or else the feed's URL; these also stand in for a missing title as the
    author, and for a missing site as the source. An entry without a date is of now, as is one whose date can't be
    parsed. A body that is no feed, or isn't there, gives no posts; of one that breaks off, the entries before count.
    """
    x = feeds.parsed(bodies.where(F.col("body").isNotNull())).where("feed is not null")
    of_feed = F.coalesce(labels.to_null("feed.link"), F.col("feed_url"))
    each = x.select(
        of_feed.alias("base"),
        F.coalesce(html.site_link(F.col("feed.link"), F.col("feed.links")), of_feed).alias("source"),
        F.coalesce(labels.to_null("feed.title"), of_feed).alias("author"),
        F.explode("feed.entries").alias("i"),
    )
    return finished(
        each.select(
            "source",
            F.lit("rss").alias("source_type"),
            "author",
            labels.clean("i.title").alias("description"),
            F.lit("").alias("direct_link"),
            times.provider_date(F.coalesce("i.published", "i.updated"), now).alias("posted_at"),
            urls.add_urls(F.array(labels.clean("i.link")), "base").alias("urls"),
        )
    )


def reddit_posts(listings: DataFrame) -> DataFrame:
    """SRC-15: ``listings (body)``; links to the site itself and others than http(s) are dropped."""
    d = listings.select(F.explode(F.from_json("body", REDDIT)["data"]["children"]).alias("c")).select("c.data.*")
    link = urls.normalize_url("url")
    return finished(
        d.select(
            F.concat(F.lit("https://www.reddit.com/"), labels.clean("subreddit_name_prefixed")).alias("source"),
            F.lit("reddit").alias("source_type"),
            labels.clean("author").alias("author"),
            labels.clean("title").alias("description"),
            F.concat(F.lit("https://www.reddit.com"), labels.clean("permalink")).alias("direct_link"),
            times.epoch("created_utc").alias("posted_at"),
            F.when((link != "") & ~F.startswith(link, F.lit("https://www.reddit.com/")), F.array(link)).otherwise(F.array().cast("array<string>")).alias("urls"),
            labels.reddit_fullname("name", "id").alias("fullname"),
        )
    )


def facet_links(facets: Column) -> Column:
    """FN-25."""
    found = F.flatten(F.transform(facets, lambda f: F.transform(f["features"], lambda x: x["uri"])))
    return F.coalesce(F.filter(found, lambda u: F.startswith(u, F.lit("http"))), F.array().cast("array<string>"))


def _uris(embed: str | None) -> list[str]:
    """The http ``uri`` values of a JSON text: an object's own before those inside of it, in the order of the text."""
    try:
        left, found = [json.loads(embed or "null")], []
    except (ValueError, RecursionError):
        return []
    while left:
        node = left.pop()
        if isinstance(node, dict):
            uri = node.get("uri")
            if isinstance(uri, str) and uri.startswith("http"):
                found.append(uri)
            node = list(node.values())
        if isinstance(node, list):
            left += reversed([x for x in node if isinstance(x, (dict, list))])
    return found


def _embed_links(embeds: pa.Array) -> pa.Array:
    return pa.array([_uris(x) for x in embeds.to_pylist()], pa.list_(pa.string()))


def embed_links(embed: Column) -> Column:
    """FN-26: every http ``uri`` of an embed, at any depth; what isn't JSON has none.

    An object's own comes before those inside of it. A variant sorts its keys and so forgets that order, therefore
    texts with a uri are parsed in Arrow batches; others aren't looked at.
    """
    walk = F.arrow_udf(_embed_links, T.ArrayType(T.StringType()))
    none = F.array().cast("array<string>")
    return F.coalesce(walk(F.when(F.contains(embed, F.lit("uri")), embed)), none)


def bluesky_posts(timelines: DataFrame, excluded: tuple[str, ...] = ("bsky.app", "bsky.social")) -> DataFrame:
    """SRC-16, FN-24: needs text and createdAt; links of facets, embed and text in that order, without excluded hosts."""
    p = timelines.select(F.explode(F.from_json("body", BLUESKY)["feed"]).alias("i")).select("i.post.*")
    p = p.withColumn("embedded", embed_links(F.col("embed")))
    text = F.col("record.text")
    found = F.concat(facet_links(F.col("record.facets")), F.col("embedded"), urls.extract_urls(text))
    kept = F.filter(urls.add_urls(found), lambda u: ~urls.in_domain(urls.host(u), excluded))
    return finished(
        p.where(labels.to_null(F.col("record.text")).isNotNull() & labels.to_null(F.col("record.createdAt")).isNotNull()).select(
            labels.bluesky_source("author.handle", "author.did").alias("source"),
            F.lit("bluesky").alias("source_type"),
            F.coalesce(labels.first_of("author.displayName", "author.handle"), F.lit("Unknown")).alias("author"),
            text.alias("description"),
            labels.bluesky_link("author.handle", "author.did", "uri").alias("direct_link"),
            times.parse_date("record.createdAt").alias("posted_at"),
            kept.alias("urls"),
        )
    )


def mastodon_posts(timelines: DataFrame) -> DataFrame:
    """SRC-17: needs created_at; links of anchors, bare text and card, without tag pages."""
    s = timelines.select(F.explode(F.from_json("body", MASTODON)).alias("s")).select("s.*").where(labels.to_null("created_at").isNotNull())
    parts = html.status_parts(s, "content")
    found = F.concat("parts.links", urls.extract_urls("parts.outside"), F.when(F.col("card.url").isNotNull(), F.array("card.url")).otherwise(F.array().cast("array<string>")))
    return finished(
        parts.select(
            F.coalesce(labels.first_of("account.url"), F.lit("")).alias("source"),
            F.lit("mastodon").alias("source_type"),
            F.coalesce(labels.first_of("account.display_name", "account.acct", "account.username"), F.lit("Unknown")).alias("author"),
            F.col("parts.text").alias("description"),
            F.coalesce(labels.first_of("url", "uri"), F.lit("")).alias("direct_link"),
            times.parse_date("created_at").alias("posted_at"),
            urls.add_urls(F.filter(found, lambda u: ~urls.is_tag_url(u))).alias("urls"),
        )
    )


def bluesky_follows(pages: DataFrame) -> DataFrame:
    """SRC-18: entries without did or handle are dropped."""
    f = pages.select(F.explode(F.from_json("body", BLUESKY_FOLLOWS)["follows"]).alias("f")).select("f.did", "f.handle", F.col("f.displayName").alias("display_name"))
    return f.where("did is not null and handle is not null")


def mastodon_follows(pages: DataFrame) -> DataFrame:
    """SRC-19: acct falls back to username."""
    a = pages.select(F.explode(F.from_json("body", MASTODON_ACCOUNTS)).alias("a")).select("a.*")
    return a.select(F.col("id").alias("account_id"), labels.first_of("acct", "username").alias("acct"), "display_name", "url").where("account_id is not null and acct is not null")
