"""Merges: (current table, records) -> next table. Arrival order is the column ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .windows import earlier_max, first_wins

HEALTH = ("last_fetched_at", "last_success_at", "last_status", "last_error", "consecutive_failures", "etag", "last_modified", "latest_entry_at", "site_link")


def outstanding(manifests: DataFrame, ledger: DataFrame) -> DataFrame:
    """UPS-1: batches that the ledger hasn't seen; a batch that it has is a no-op."""
    return manifests.join(ledger.select("batch_id"), "batch_id", "left_anti")


def insert_ignore(current: DataFrame, records: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """UPS-2, UPS-14, UPS-15: the new rows: the first arrival of each key that the table doesn't have."""
    return first_wins(records, key, order).join(current.select(key), key, "left_anti")


def insert_posts(current: DataFrame, records: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """UPS-2: (next posts, inserted posts with their URLs)."""
    new = insert_ignore(current, records, "unique_id").withColumn("first_seen_at", now)
    return current.unionByName(new.select(*current.columns)), new


def urls_of(posts: DataFrame) -> DataFrame:
    """UPS-3: a row for each URL: position and hash; a repeated URL keeps its first position."""
    rows = posts.select("unique_id", F.posexplode("urls").alias("position", "url"))
    return first_wins(rows, ["unique_id", "url"], "position").withColumn("url_hash", urls.build_hash("url"))


def fold_health(health: DataFrame, observations: DataFrame, range_: Column | None = None) -> DataFrame:
    """UPS-4, UPS-5, WIN-2, WIN-3: the health table after the observations, without a row loop.

    An observation older than one of its key that came before is ignored, an equally old one isn't. A success takes etag
    and last_modified even if null, and latest_entry_at and site_link only if not null. Everything is folded by (key, range
    of arrivals) first and the ranges of a key then (see ``earlier_max``), so a feed with very many rows isn't one task's.
    """
    key = "normalized_url"
    known = health.select(key, F.col("last_fetched_at").alias("_known"))
    o = earlier_max(observations, [key], "seq", "observed_at", "bar", known, range_).where(F.col("bar").isNull() | (F.col("observed_at") >= F.col("bar")))
    o = o.withColumn("last_ok", F.max(F.when(F.col("success"), F.col("seq"))).over(Window.partitionBy(key, "_range")))
    when_ok = lambda c: F.max_by(F.when(F.col("success"), c), F.when(F.col("success"), F.col("seq")))
    known_ = lambda c: F.max_by(F.col(c), F.when(F.col("success") & F.col(c).isNotNull(), F.col("seq")))
    ranges = o.groupBy(key, "_range").agg(
        F.max_by(F.struct(F.col("observed_at").alias("fetched"), F.col("status"), F.when(~F.col("success"), F.col("error")).alias("error")), "seq").alias("g_last"),
        when_ok(F.struct(F.col("observed_at").alias("at"), "etag", "last_modified")).alias("g_ok"),
        known_("latest_entry_at").alias("g_entry"),
        known_("site_link").alias("g_link"),
        F.count_if(~F.col("success") & (F.col("last_ok").isNull() | (F.col("seq") > F.col("last_ok")))).alias("g_fails"),
    )
    ranges = ranges.withColumn("_from", F.max(F.when(F.col("g_ok").isNotNull(), F.col("_range"))).over(Window.partitionBy(key)))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_range"))).alias(c)
    since = F.col("_from").isNull() | (F.col("_range") >= F.col("_from"))
    g = ranges.groupBy(key).agg(*(latest(c) for c in ("g_last", "g_ok", "g_entry", "g_link")), F.sum(F.when(since, F.col("g_fails")).otherwise(0)).alias("g_fails"))
    both = g.join(health, key, "full")
    seen, ok = F.col("g_last").isNotNull(), F.col("g_ok").isNotNull()
    pick = lambda test, new, old: F.when(test, new).otherwise(F.col(old)).alias(old)
    return both.select(
        key,
        pick(seen, F.col("g_last.fetched"), "last_fetched_at"),
        pick(ok, F.col("g_ok.at"), "last_success_at"),
        pick(seen, F.col("g_last.status"), "last_status"),
        pick(seen, F.col("g_last.error"), "last_error"),
        F.when(~seen, F.col("consecutive_failures")).when(ok, F.col("g_fails")).otherwise(F.coalesce("consecutive_failures", F.lit(0)) + F.col("g_fails")).cast("int").alias("consecutive_failures"),
        pick(ok, F.col("g_ok.etag"), "etag"),
        pick(ok, F.col("g_ok.last_modified"), "last_modified"),
        F.coalesce("g_entry", "latest_entry_at").alias("latest_entry_at"),
        F.coalesce("g_link", "site_link").alias("site_link"),
    )


def strictly_newer(current: DataFrame, records: DataFrame, keys: list[str], values: list[str], moment: str = "observed_at") -> DataFrame:
    """UPS-6, UPS-7: the next table: a record replaces only what is strictly older; of equals the first arrival stays."""
    first = records.groupBy(*keys, moment).agg(F.min_by(F.struct(*values), "seq").alias("v"))
    best = first.groupBy(*keys).agg(F.max_by(F.struct(moment, "v.*"), moment).alias("n"))
    both = best.join(current.select(*keys, F.struct(moment, *values).alias("o")), keys, "full")
    take = F.col("o").isNull() | (F.col(f"n.{moment}") > F.col(f"o.{moment}"))
    return both.select(*keys, F.when(F.col("n").isNotNull() & take, F.col("n")).otherwise(F.col("o")).alias("r")).select(*keys, "r.*")


def classify_newer(current: DataFrame, records: DataFrame, keys: list[str], moment: str = "observed_at", range_: Column | None = None) -> DataFrame:
    """AGG-16: ``records`` with ``applied``: strictly newer than all of its key before it and than the table."""
    bar = earlier_max(records, keys, "seq", moment, "_bar", current.select(*keys, F.col(moment).alias("_known")), range_)
    return bar.select(*records.columns, (F.col("_bar").isNull() | (F.col(moment) > F.col("_bar"))).alias("applied"))


#: The kinds of sources whose checkpoints are kept.
CHECKPOINT_SOURCES = ("reddit", "bluesky", "mastodon")


def checkpoint_counts(current: DataFrame, records: DataFrame, range_: Column | None = None) -> DataFrame:
    """UPS-6, AGG-16: ``batch_id, checkpoints_applied, checkpoints_skipped``: a record of an unknown source is skipped, not an error."""
    known = F.col("source_type").isin(*CHECKPOINT_SOURCES)
    marked = classify_newer(current, records.where(known), ["source_type", "source_key"], range_=range_).select("batch_id", "applied")
    marked = marked.unionByName(records.where(~F.coalesce(known, F.lit(False))).select("batch_id", F.lit(False).alias("applied")))
    return marked.groupBy("batch_id").agg(F.count_if("applied").alias("checkpoints_applied"), F.count_if(~F.col("applied")).alias("checkpoints_skipped"))


def won_snapshots(claims: DataFrame, snapshots: DataFrame) -> DataFrame:
    """UPS-7: ``scope, observed_at, record_count, snapshot_id`` of each scope whose newest snapshot is strictly newer than its claim.

    ``claims``: ``scope, observed_at, record_count``; ``snapshots``: the same with ``seq, snapshot_id``. Of equally new ones the first stays.
    """
    best = snapshots.groupBy("scope").agg(F.max_by(F.struct("observed_at", "record_count", "snapshot_id"), F.struct(F.col("observed_at"), -F.col("seq"))).alias("n"))
    return best.join(claims.select("scope", F.col("observed_at").alias("known")), "scope", "left").where("known is null or n.observed_at > known").select("scope", "n.*")


def snapshot_members(rows: DataFrame, won: DataFrame, member: str) -> DataFrame:
    """UPS-8, UPS-9: the members of the won snapshots with ``synced_at``. ``rows``: ``snapshot_id, scope, line`` and a member's columns.

    Of one snapshot's equal members the last by ``line`` wins.
    """
    new = rows.join(won.select("scope", "snapshot_id", F.col("observed_at").alias("synced_at")), ["scope", "snapshot_id"])
    about = [c for c in new.columns if c not in ("scope", "snapshot_id", "line", member)]
    return new.groupBy("scope", member).agg(F.max_by(F.struct(*about), "line").alias("_r")).select("scope", member, "_r.*")


def replace_snapshots(current: DataFrame, claims: DataFrame, snapshots: DataFrame, rows: DataFrame, member: str) -> tuple[DataFrame, DataFrame]:
    """UPS-7..9: (next rows, next claims). A strictly newer snapshot replaces all rows of its scope, even an empty one."""
    won = won_snapshots(claims, snapshots)
    kept = current.join(won.select("scope"), "scope", "left_anti")
    next_claims = claims.join(won.select("scope"), "scope", "left_anti").unionByName(won.select(*claims.columns))
    return kept.unionByName(snapshot_members(rows, won, member).select(*current.columns)), next_claims


def add_to_catalog(catalog: DataFrame, requests: DataFrame, key: str, valid: Column) -> DataFrame:
    """UPS-11, UPS-13: ``requests (seq, key, ...)`` with ``result``: added, exists or invalid."""
    marked = requests.withColumn("_valid", valid)
    first = marked.where("_valid").groupBy(key).agg(F.min("seq").alias("_first"))
    known = catalog.select(key).withColumn("_known", F.lit(True))
    out = marked.join(first, key, "left").join(known, key, "left")
    result = F.when(~F.col("_valid"), "invalid").when(F.col("_known").isNotNull() | (F.col("seq") > F.col("_first")), "exists").otherwise("added")
    return out.withColumn("result", result).drop("_valid", "_first", "_known")


def soft_delete(catalog: DataFrame, commands: DataFrame, key: str, now: Column) -> DataFrame:
    """UPS-12, UPS-13: the next catalog after ``commands (key, action)``: delete takes live rows, restore removed ones.

    One command for each key: reduce them to the last of each key first.
    """
    c = catalog.join(commands.select(key, "action"), key, "left")
    gone = F.col("deleted_at").isNotNull()
    delete, restore = (F.col("action") == "delete") & ~gone, (F.col("action") == "restore") & gone
    return c.withColumns(
        {
            "enabled": F.when(delete, False).when(restore, True).otherwise(F.col("enabled")),
            "deleted_at": F.when(delete, now).when(restore, None).otherwise(F.col("deleted_at")),
        }
    ).select(*catalog.columns)


def retain_posts(posts: DataFrame, post_urls: DataFrame, now: Column, months: int) -> tuple[DataFrame, DataFrame]:
    """UPS-17, JN-12: posts within so many months, and their URLs."""
    if months <= 0:
        raise ValueError("months must be positive")
    kept = posts.where(F.col("posted_at") >= now - F.make_ym_interval(F.lit(0), F.lit(months)))
    return kept, post_urls.join(kept.select("unique_id"), "unique_id", "left_semi")


def retain_ledger(ledger: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """UPS-17."""
    return ledger.where(F.col("published_at") >= now - F.make_dt_interval(F.lit(days)))


def retain_batches(batches: DataFrame, instant: Column, now: Column, days: int) -> DataFrame:
    """UPS-18: applied batches of so many days; 0 keeps all."""
    return batches if days == 0 else batches.where(instant.isNull() | (instant >= now - F.make_dt_interval(F.lit(days))))


def validator_cache(cache: DataFrame, observations: DataFrame) -> DataFrame:
    """UPS-19: etag and last_modified of the last successful observation; a key with neither goes."""
    key = "normalized_url"
    last = observations.where("success").groupBy(key).agg(F.max_by(F.struct("etag", "last_modified"), "seq").alias("n"))
    both = last.join(cache.select(key, F.struct("etag", "last_modified").alias("o")), key, "full").select(key, F.coalesce("n", "o").alias("r")).select(key, "r.*")
    return both.where(F.coalesce(F.nullif("etag", F.lit("")), F.nullif("last_modified", F.lit(""))).isNotNull())


def last_applied(current: DataFrame, records: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """UPS-20: the last arrival wins, whatever its time; records with an empty cursor are left out."""
    best = records.where(F.coalesce("cursor", F.lit("")) != "").groupBy(*keys).agg(F.max_by(F.struct(*values), "seq").alias("n"))
    both = best.join(current.select(*keys, F.struct(*values).alias("o")), keys, "full")
    return both.select(*keys, F.coalesce("n", "o").alias("r")).select(*keys, "r.*")


def emitted_checkpoints(listing: DataFrame, key: str, cursor: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """UPS-22: ``key, cursor``: the newest seen of each key, before any filter; with ``known``, only where it moved on."""
    newest = listing.groupBy(key).agg(F.max_by(cursor, order).alias("cursor"))
    if known is None:
        return newest
    old = known.select(key, F.col("cursor").alias("_known"))
    return newest.join(old, key, "left").where(~F.col("cursor").eqNullSafe(F.col("_known"))).drop("_known")


def ledger_entries(batches: DataFrame, records: DataFrame, new_posts: DataFrame, new_urls: DataFrame, now: Column) -> DataFrame:
    """UPS-10: ``batch_id, published_at, record_count, posts_inserted, urls_inserted`` of the batches of one commit.

    ``new_posts``: inserted posts with the ``batch_id`` that brought them; ``new_urls``: their URLs by ``unique_id``.
    """
    counts = lambda df, name: df.groupBy("batch_id").agg(F.count("*").alias(name))
    urls_of_batch = new_urls.join(new_posts.select("unique_id", "batch_id"), "unique_id")
    out = batches.select("batch_id")
    for frame, name in ((records, "record_count"), (new_posts, "posts_inserted"), (urls_of_batch, "urls_inserted")):
        out = out.join(counts(frame, name), "batch_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("published_at", now)


def advance_state(cache: DataFrame, cursors: DataFrame, observations: DataFrame, checkpoints: DataFrame, feeds: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """UPS-21: (validators, cursors) after a cycle, for what is still in the catalog.

    ``feeds``: ``normalized_url``; ``keys``: ``source_type, source_key``.
    """
    next_cache = validator_cache(cache, observations).join(feeds.select("normalized_url"), "normalized_url", "left_semi")
    next_cursors = last_applied(cursors, checkpoints, ["source_type", "source_key"], ["cursor"])
    return next_cache, next_cursors.join(keys.select("source_type", "source_key"), ["source_type", "source_key"], "left_semi")
