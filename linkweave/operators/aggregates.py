"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels


def count_rows(rows: DataFrame, name: str = "n") -> DataFrame:
    """AGG-1, AGG-4."""
    return rows.agg(F.count("*").alias(name))


def catalog_counts(catalog: DataFrame, errors: bool = False) -> DataFrame:
    """AGG-2, AGG-3: active, disabled, removed (and errors among live feeds) and total in one pass; zero when empty."""
    label = labels.status("enabled", "deleted_at")
    counts = [F.count_if(label == s).alias(s) for s in ("active", "disabled", "removed")]
    if errors:
        bad = (F.coalesce("consecutive_failures", F.lit(0)) > 0) | (F.coalesce("last_status", F.lit(0)) >= 400)
        counts.append(F.count_if((label == "active") & bad).alias("errors"))
    return catalog.agg(*counts, F.count("*").alias("total"))


def last_synced(follows: DataFrame) -> DataFrame:
    """AGG-6: null without follows."""
    return follows.agg(F.max("synced_at").alias("last_synced_at"))


def by_instance(follows: DataFrame) -> DataFrame:
    """AGG-7: the accounts of each instance, without regard to case."""
    accounts = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("acct").alias("k"), "acct", "account_id"))), lambda a: F.struct(a["acct"], a["account_id"]))
    return follows.groupBy("instance_name").agg(F.count("*").alias("n"), accounts.alias("accounts"))


def backlog(manifests: DataFrame, ledger: DataFrame, rejected: DataFrame) -> DataFrame:
    """AGG-9: ``state, batches, oldest`` of published, rejected and outstanding batches."""
    marked = (
        manifests.select("batch_id")
        .join(ledger.select("batch_id", F.lit(True).alias("p")), "batch_id", "left")
        .join(rejected.select("batch_id", F.lit(True).alias("r")), "batch_id", "left")
    )
    state = F.when(F.col("p"), "published").when(F.col("r"), "rejected").otherwise("outstanding")
    return marked.groupBy(state.alias("state")).agg(F.count("*").alias("batches"), F.min("batch_id").alias("oldest"))


def outcome(success: Column, status: Column) -> Column:
    """AGG-10."""
    return F.when(~success, "error").when(status == 304, "not_modified").otherwise("fetched")


def newest_entry(entries: Column | str, field: str = "published") -> Column:
    """AGG-13: entries without a date don't count; null if none has one."""
    return F.array_max(F.transform(entries, lambda e: e[field]))


#: Fixed value: what counts as a whole number in a status id.
WHOLE = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def highest_id(rows: DataFrame, key: str, id_: str, order: str) -> DataFrame:
    """AGG-14: the numerically highest id of each key, of any length; if one isn't a whole number, the first by ``order``."""
    c = F.col(id_)
    digits = F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^0+(?=.)", "")
    negative = c.rlike(r"^\s*-") & (digits != "0")
    size = F.char_length(digits)
    # as sign, length and digits numbers of any length are in order; of negative ones it is turned around
    number = F.struct(F.when(negative, -1).otherwise(1), F.when(negative, -size).otherwise(size), F.when(negative, F.translate(digits, "0123456789", "9876543210")).otherwise(digits))
    whole = c.rlike(WHOLE)
    return rows.where(c.isNotNull()).groupBy(key).agg(F.when(F.count_if(~whole) > 0, F.min_by(id_, order)).otherwise(F.max_by(id_, F.when(whole, number))).alias("highest"))


def manifest_totals(manifests: DataFrame) -> DataFrame:
    """AGG-17."""
    return manifests.select("batch_id", F.aggregate("files", F.lit(0).cast("long"), lambda n, f: n + f["record_count"]).alias("records"))


def catalog_revision(feeds: DataFrame, subreddits: DataFrame, version: int = 1) -> DataFrame:
    """AGG-18: one digest over both sorted lists. The lists meet in one row, as the digest is of one text."""
    lines = lambda df, key, name: df.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col(key), F.lit("\t"), F.col(name), F.lit("\n")))), "").alias(key))
    both = lines(feeds, "normalized_url", "feed_url").crossJoin(lines(subreddits, "normalized_name", "name"))
    return both.select(F.sha2(F.concat(F.lit(f"catalog.v{version}\nrss_feeds\n"), F.col("normalized_url"), F.lit("subreddits\n"), F.col("normalized_name")), 256).alias("revision"))


def skip_counters(posts: DataFrame, kept: DataFrame, key: str, required: list[str]) -> DataFrame:
    """AGG-12: ``read, without_links, missing_fields, filtered, kept`` of one cycle.

    A row that misses a field isn't counted for its links; what is complete but not in ``kept`` was filtered.
    """
    missing = F.lit(False)
    for column in required:
        missing = missing | labels.to_null(column).isNull()
    marked = posts.join(kept.select(key, F.lit(True).alias("_kept")), key, "left")
    no_links = F.size("urls") == 0
    return marked.agg(
        F.count("*").alias("read"),
        F.count_if(~missing & no_links).alias("without_links"),
        F.count_if(missing).alias("missing_fields"),
        F.count_if(~missing & ~no_links & F.col("_kept").isNull()).alias("filtered"),
        F.count_if(F.col("_kept")).alias("kept"),
    )


def removed_urls(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-12: how many URLs a filter took away; null counts as none."""
    total = lambda df, name: df.agg(F.coalesce(F.sum(F.size("urls")), F.lit(0)).alias(name))
    return total(before, "before").crossJoin(total(after, "after")).select((F.col("before") - F.col("after")).alias("removed"))
