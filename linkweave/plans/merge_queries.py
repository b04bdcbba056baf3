"""Merges, windows and state over views of the events, customers and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, filters, joins, merges, windows
from .registered import query
from .views import (
    CHECKPOINT_SQL, FEEDS_SQL, FOLD_SQL, OBS_SQL, VOLUME_SQL, WEB_SQL, checkpoint_records, empty_health, feeds, follows_rows, follows_snapshots,
    iso, moment, observations, table, volume_posts, volume_urls, web_posts,
)

TS = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def win1_first_wins(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return windows.first_wins(d, "h", "doc_id").select("doc_id", "source")


@query("WITH " + OBS_SQL + "," + FOLD_SQL + "SELECT normalized_url, seq FROM accepted")
def win2_not_late(spark, sf):
    return windows.not_late(observations(spark, sf), "normalized_url", "seq", "observed_at").select("normalized_url", "seq")


@query(
    "WITH "
    + OBS_SQL
    + """, l AS (SELECT *, max(seq) FILTER (WHERE success) OVER (PARTITION BY normalized_url) AS last_ok FROM obs)
    SELECT normalized_url, count(*) FILTER (WHERE NOT success AND (last_ok IS NULL OR seq > last_ok)) AS failures, bool_or(success) AS any_success FROM l GROUP BY normalized_url"""
)
def win3_failure_run(spark, sf):
    return windows.failure_run(observations(spark, sf), "normalized_url", "seq", "success")


HEALTH_COLUMNS = (
    "normalized_url, " + ", ".join(f"{TS.format(c)} AS {c}" for c in ("last_fetched_at", "last_success_at", "latest_entry_at"))
    + ", last_status, last_error, consecutive_failures, etag, last_modified, site_link"
)


def shown_health(health):
    times_ = ("last_fetched_at", "last_success_at", "latest_entry_at")
    return health.select("normalized_url", *(iso(c).alias(c) for c in times_), "last_status", "last_error", F.col("consecutive_failures").cast("long").alias("consecutive_failures"), "etag", "last_modified", "site_link")


def folded(spark, sf):
    return merges.fold_health(empty_health(spark), observations(spark, sf))


@query("WITH " + OBS_SQL + "," + FOLD_SQL + f"SELECT {HEALTH_COLUMNS} FROM health")
def ups04_ups05_fold_health(spark, sf):
    return shown_health(folded(spark, sf))


@query("WITH " + OBS_SQL + "," + FOLD_SQL + f"SELECT {HEALTH_COLUMNS} FROM health")
def str03_str04_fold_in_two_batches(spark, sf):
    """The same health from two batches in order of arrival, the second on the table that the first made."""
    o = observations(spark, sf)
    first = merges.fold_health(empty_health(spark), o.where("seq < 5000"))
    return shown_health(merges.fold_health(first, o.where("seq >= 5000")))


@query(
    """WITH d AS (SELECT sha256(coalesce(text, '')) AS h, doc_id FROM documents), cur AS (SELECT DISTINCT h FROM d WHERE doc_id % 4 = 0),
    new AS (SELECT h, min(doc_id) AS doc_id FROM d WHERE doc_id % 4 <> 0 AND h NOT IN (SELECT h FROM cur) GROUP BY h) SELECT h AS unique_id, doc_id FROM new"""
)
def ups02_insert_ignore(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("unique_id"), "doc_id")
    return merges.insert_ignore(d.where("doc_id % 4 = 0"), d.where("doc_id % 4 <> 0"), "unique_id", "doc_id")


@query("WITH " + WEB_SQL + "SELECT unique_id, position, url, url_hash FROM post_urls")
def ups03_post_urls(spark, sf):
    return merges.urls_of(web_posts(spark, sf)).select("unique_id", "position", "url", "url_hash")


@query(
    "WITH "
    + CHECKPOINT_SQL
    + f"SELECT source_type, source_key, {TS.format('max(observed_at)')} AS observed_at, arg_max(cursor, (observed_at, -seq)) AS cursor FROM cp GROUP BY ALL"
)
def ups06_strictly_newer(spark, sf):
    c = checkpoint_records(spark, sf)
    keys = ["source_type", "source_key"]
    first = merges.strictly_newer(c.limit(0).select(*keys, "observed_at", "cursor"), c.where("seq < 5000"), keys, ["cursor"])
    return merges.strictly_newer(first, c.where("seq >= 5000"), keys, ["cursor"]).select(*keys, iso("observed_at").alias("observed_at"), "cursor")


@query(
    "WITH "
    + CHECKPOINT_SQL
    + """, b AS (SELECT *, max(observed_at) OVER (PARTITION BY source_type, source_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bar FROM cp)
    SELECT source_type, count(*) FILTER (WHERE bar IS NULL OR observed_at > bar) AS applied, count(*) FILTER (WHERE observed_at <= bar) AS skipped FROM b GROUP BY source_type"""
)
def agg16_applied_and_skipped(spark, sf):
    c = checkpoint_records(spark, sf)
    known = c.limit(0).select("source_type", "source_key", "observed_at")
    return merges.classify_newer(known, c, ["source_type", "source_key"]).groupBy("source_type").agg(F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("skipped"))


FOLLOWS_SQL = """
f AS (SELECT CAST(c_nationkey AS VARCHAR) AS scope, CAST(c_custkey % 3 AS VARCHAR) AS snapshot_id, 'id' || (c_custkey % 400) AS account_id, c_name AS acct, c_custkey AS line FROM customer),
won AS (SELECT scope, CASE WHEN bool_or(snapshot_id = '1') THEN '1' WHEN bool_or(snapshot_id = '2') THEN '2' ELSE '0' END AS snapshot_id FROM f GROUP BY scope),
follows AS (SELECT scope AS instance_name, account_id, acct, CASE snapshot_id WHEN '1' THEN TIMESTAMP '2026-01-03' WHEN '2' THEN TIMESTAMP '2026-01-02' ELSE TIMESTAMP '2026-01-01' END AS synced_at
  FROM f JOIN won USING (scope, snapshot_id) QUALIFY row_number() OVER (PARTITION BY scope, account_id ORDER BY line DESC) = 1)
"""


def synced_follows(spark, sf):
    rows = follows_rows(spark, sf)
    current = rows.limit(0).select("scope", "account_id", "acct", moment("2026-01-01").alias("synced_at"))
    claims = follows_snapshots(rows).limit(0).select("scope", "observed_at", "record_count")
    followed, next_claims = merges.replace_snapshots(current, claims, follows_snapshots(rows), rows, "account_id")
    return followed.withColumnRenamed("scope", "instance_name"), next_claims


@query("WITH " + FOLLOWS_SQL + f"SELECT instance_name, account_id, acct, {TS.format('synced_at')} AS synced_at FROM follows")
def ups08_ups09_replace_snapshots(spark, sf):
    return synced_follows(spark, sf)[0].withColumn("synced_at", iso("synced_at"))


@query("WITH " + FOLLOWS_SQL + "SELECT w.scope, count(*) AS record_count FROM f JOIN won w USING (scope, snapshot_id) GROUP BY w.scope")
def ups07_snapshot_claims(spark, sf):
    return synced_follows(spark, sf)[1].select("scope", "record_count")


@query("WITH " + FOLLOWS_SQL + "SELECT instance_name, count(*) AS n, string_agg(acct || '/' || account_id, ',' ORDER BY lower(acct), acct, account_id) AS accounts FROM follows GROUP BY instance_name")
def agg07_follows_by_instance(spark, sf):
    g = aggregates.by_instance(synced_follows(spark, sf)[0])
    return g.select("instance_name", "n", F.array_join(F.transform("accounts", lambda a: F.concat(a["acct"], F.lit("/"), a["account_id"])), ",").alias("accounts"))


@query("WITH " + FOLLOWS_SQL + f"SELECT {TS.format('max(synced_at)')} AS last_synced_at FROM follows")
def agg06_last_synced(spark, sf):
    return aggregates.last_synced(synced_follows(spark, sf)[0]).select(iso("last_synced_at").alias("last_synced_at"))


@query(
    "WITH "
    + FEEDS_SQL
    + """, r AS (SELECT event_id AS seq, 'https://feed' || (user_id + 75) || '.example/rss' AS k, event_type <> 'signup' AS ok FROM events)
    SELECT seq, CASE WHEN NOT ok THEN 'invalid' WHEN k IN (SELECT normalized_url FROM feeds) OR seq > min(seq) FILTER (WHERE ok) OVER (PARTITION BY k) THEN 'exists' ELSE 'added' END AS result FROM r"""
)
def ups11_add_feeds(spark, sf):
    e = table(spark, sf, "events")
    requests = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("https://feed"), (F.col("user_id") + 75).cast("string"), F.lit(".example/rss")).alias("normalized_url"), "event_type")
    return merges.add_to_catalog(feeds(spark, sf), requests, "normalized_url", F.col("event_type") != "signup").select("seq", "result")


@query(
    "WITH "
    + FEEDS_SQL
    + f""", c AS (SELECT 'https://feed' || user_id || '.example/rss' AS normalized_url, CASE WHEN arg_max(event_type, event_id) IN ('click', 'view') THEN 'delete' ELSE 'restore' END AS action FROM events GROUP BY user_id)
    SELECT normalized_url, CASE WHEN action = 'delete' AND deleted_at IS NULL THEN false WHEN action = 'restore' AND deleted_at IS NOT NULL THEN true ELSE enabled END AS enabled,
      {TS.format("CASE WHEN action = 'delete' AND deleted_at IS NULL THEN TIMESTAMP '2026-02-02' WHEN action = 'restore' THEN NULL ELSE deleted_at END")} AS deleted_at FROM feeds JOIN c USING (normalized_url)"""
)
def ups12_soft_delete(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"))
    commands = last.select(F.concat(F.lit("https://feed"), F.col("user_id").cast("string"), F.lit(".example/rss")).alias("normalized_url"), F.when(F.col("t").isin("click", "view"), "delete").otherwise("restore").alias("action"))
    return merges.soft_delete(feeds(spark, sf), commands, "normalized_url", moment("2026-02-02")).select("normalized_url", "enabled", iso("deleted_at").alias("deleted_at"))


@query(
    """WITH s AS (SELECT lower(source) AS k, min(doc_id) AS seq FROM documents WHERE source IS NOT NULL GROUP BY 1)
    SELECT k AS normalized_name, seq FROM s WHERE k NOT IN (SELECT lower(source) FROM documents WHERE doc_id % 97 = 0 AND source IS NOT NULL)"""
)
def ups14_bootstrap(spark, sf):
    d = table(spark, sf, "documents").where("source is not null").select(F.lower("source").alias("normalized_name"), F.col("doc_id").alias("seq"))
    return merges.insert_ignore(d.where("seq % 97 = 0"), d, "normalized_name")


@query("WITH " + VOLUME_SQL + ", p AS (SELECT * FROM posts WHERE posted_at >= TIMESTAMP '1998-08-31' - INTERVAL 6 MONTH) SELECT (SELECT count(*) FROM p) AS posts, count(*) AS urls, count(DISTINCT unique_id) AS posts_with_urls FROM post_urls WHERE unique_id IN (SELECT unique_id FROM p)")
def ups17_retention(spark, sf):
    posts = volume_posts(spark, sf).withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz"))
    kept, links = merges.retain_posts(posts, volume_urls(spark, sf), moment("1998-08-31"), 6)
    return kept.agg(F.count("*").alias("posts")).crossJoin(links.agg(F.count("*").alias("urls"), F.count_distinct("unique_id").alias("posts_with_urls")))


@query(
    "WITH "
    + VOLUME_SQL
    + """SELECT source, count(*) AS n, min(posted_at)::DATE::VARCHAR AS oldest FROM posts WHERE posted_at >= TIMESTAMP '1998-12-01' - INTERVAL 90 DAY GROUP BY source"""
)
def ups17_ups18_ledger_retention(spark, sf):
    ledger = volume_posts(spark, sf).select("source", F.col("posted_at").cast("timestamp_ntz").alias("published_at"))
    kept = merges.retain_batches(merges.retain_ledger(ledger, moment("1998-12-01")), F.col("published_at"), moment("1998-12-01"), 0)
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.date_format(F.min("published_at"), "yyyy-MM-dd").alias("oldest"))


@query(
    "WITH "
    + OBS_SQL
    + """, l AS (SELECT normalized_url, arg_max({'e': etag, 'm': last_modified}, seq) AS v FROM obs WHERE success GROUP BY normalized_url)
    SELECT normalized_url, v['e'] AS etag, v['m'] AS last_modified FROM l WHERE v['e'] IS NOT NULL OR v['m'] IS NOT NULL"""
)
def ups19_validator_cache(spark, sf):
    o = observations(spark, sf)
    return merges.validator_cache(o.limit(0).select("normalized_url", "etag", "last_modified"), o)


@query("WITH " + CHECKPOINT_SQL + "SELECT source_type, source_key, arg_max(cursor, seq) AS cursor FROM cp GROUP BY ALL")
def ups20_last_applied(spark, sf):
    c = checkpoint_records(spark, sf)
    return merges.last_applied(c.limit(0).select("source_type", "source_key", "cursor"), c, ["source_type", "source_key"], ["cursor"])


@query("SELECT conv_id, max(turn) AS cursor FROM conversations GROUP BY conv_id HAVING max(turn) <> 3")
def ups22_emitted_checkpoints(spark, sf):
    c = table(spark, sf, "conversations")
    known = c.select("conv_id").distinct().withColumn("cursor", F.lit(3).cast("long"))
    return merges.emitted_checkpoints(c, "conv_id", "turn", "turn", known)


@query(
    """WITH s AS (SELECT *, min(turn) FILTER (WHERE role = 'assistant' AND turn >= 2) OVER (PARTITION BY conv_id) AS cut FROM conversations)
    SELECT conv_id, turn FROM s WHERE cut IS NULL OR turn < cut"""
)
def fil06_before_cursor(spark, sf):
    return filters.before_cursor(table(spark, sf, "conversations"), "conv_id", "turn", (F.col("role") == "assistant") & (F.col("turn") >= 2)).select("conv_id", "turn")


@query(
    "WITH " + WEB_SQL + f""", a AS (SELECT *, {TS.format("CASE WHEN posted_at > TIMESTAMP '2026-01-08 00:01:00' THEN TIMESTAMP '2026-01-08' ELSE posted_at END")} AS at2 FROM posts
      WHERE posted_at >= TIMESTAMP '2026-02-03' - INTERVAL 1 MONTH),
    h AS (SELECT at2, list_filter(urls, lambda u: NOT contains(regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1), 'blog')) AS urls, description FROM a)
    SELECT sha256(array_to_string(list_sort(urls), ',')) AS unique_id, at2 AS posted_at FROM h WHERE len(urls) > 0
      AND NOT regexp_matches(lower(description), '(^|[^\\p{{L}}\\p{{N}}_])(the)($|[^\\p{{L}}\\p{{N}}_])') AND len(list_filter(urls, lambda u: contains(lower(u), 'the'))) = 0"""
)
def fil01_fil05_clean_posts(spark, sf):
    posts = filters.age_limit(web_posts(spark, sf), moment("2026-02-03"), 1)
    return filters.clean_posts(posts, moment("2026-01-08"), 12, ["blog"], ["the"]).select("unique_id", iso("posted_at").alias("posted_at"))


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{L}\\p{N}_])(idiot|and)($|[^\\p{L}\\p{N}_])')")
def fil04_drop_posts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("description"), F.array(F.lit("https://x.example/")).alias("urls"))
    return filters.drop_posts(d, ["idiot", "and"]).select("doc_id")


@query(
    "WITH "
    + VOLUME_SQL
    + """, c AS (SELECT unique_id, count(*) AS n FROM post_urls WHERE unique_id IN (SELECT unique_id FROM posts WHERE source = '1-URGENT') GROUP BY 1) SELECT count(*) AS posts, sum(n)::BIGINT AS urls FROM c"""
)
def jn12_keep_children(spark, sf):
    parents = volume_posts(spark, sf).where("source = '1-URGENT'")
    c = joins.keep_children(volume_urls(spark, sf), parents, "unique_id").groupBy("unique_id").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("posts"), F.sum("n").alias("urls"))


@query(
    "WITH "
    + OBS_SQL
    + """, c AS (SELECT event_type, event_id, CASE WHEN event_type = 'view' AND event_id % 100 = 3 THEN event_id || '.5' WHEN event_type = 'click' AND event_id % 100 = 4 THEN event_id || 'e5'
        WHEN event_type = 'error' THEN '1' || lpad(CAST(event_id AS VARCHAR), 45, '0') WHEN event_type = 'purchase' THEN '-' || event_id ELSE '00' || event_id END AS c FROM obs)
    SELECT event_type, CASE event_type WHEN 'view' THEN arg_min(c, event_id) WHEN 'click' THEN arg_min(c, event_id) WHEN 'purchase' THEN arg_min(c, event_id) ELSE arg_max(c, event_id) END AS highest FROM c GROUP BY event_type"""
)
def agg14_highest_id(spark, sf):
    """Ids that are whole numbers of up to 46 digits, with leading zeros or negative; two types have some like 1.5 and 1e5, and so their first."""
    type_, id_ = F.col("event_type"), F.col("event_id").cast("string")
    c = (
        F.when((type_ == "view") & (F.col("event_id") % 100 == 3), F.concat(id_, F.lit(".5")))
        .when((type_ == "click") & (F.col("event_id") % 100 == 4), F.concat(id_, F.lit("e5")))
        .when(type_ == "error", F.concat(F.lit("1"), F.lpad(id_, 45, "0")))
        .when(type_ == "purchase", F.concat(F.lit("-"), id_))
        .otherwise(F.concat(F.lit("00"), id_))
    )
    return aggregates.highest_id(observations(spark, sf).select("event_type", "event_id", c.alias("c")), "event_type", "c", "event_id")


@query("WITH " + OBS_SQL + "SELECT CASE WHEN NOT success THEN 'error' WHEN status = 304 THEN 'not_modified' ELSE 'fetched' END AS outcome, count(*) AS n FROM obs GROUP BY 1")
def agg10_fetch_outcomes(spark, sf):
    return observations(spark, sf).groupBy(aggregates.outcome(F.col("success"), F.col("status")).alias("outcome")).agg(F.count("*").alias("n"))


@query("WITH " + OBS_SQL + f"SELECT normalized_url, {TS.format('max(latest_entry_at)')} AS newest FROM obs GROUP BY 1")
def agg13_newest_entry(spark, sf):
    own = observations(spark, sf).select("normalized_url", F.array(F.struct(F.col("latest_entry_at").alias("published"))).alias("entries"))
    g = own.groupBy("normalized_url").agg(F.max(aggregates.newest_entry("entries")).alias("n"))
    return g.select("normalized_url", iso("n").alias("newest"))


@query(
    "WITH "
    + FEEDS_SQL
    + """, subs AS (SELECT DISTINCT lower(source) AS k, source AS name FROM documents WHERE source IS NOT NULL)
    SELECT sha256('catalog.v1' || chr(10) || 'rss_feeds' || chr(10) || (SELECT string_agg(normalized_url || chr(9) || feed_url || chr(10), '' ORDER BY normalized_url) FROM feeds)
      || 'subreddits' || chr(10) || (SELECT string_agg(k || chr(9) || name || chr(10), '' ORDER BY k) FROM subs)) AS revision"""
)
def agg18_catalog_revision(spark, sf):
    subs = table(spark, sf, "documents").where("source is not null").select(F.lower("source").alias("normalized_name"), F.col("source").alias("name")).distinct()
    return aggregates.catalog_revision(feeds(spark, sf), subs)


@query(
    "WITH "
    + OBS_SQL
    + """, b AS (SELECT DISTINCT normalized_url AS batch_id, user_id FROM obs) SELECT CASE WHEN user_id % 3 = 0 THEN 'published' WHEN user_id % 4 = 0 THEN 'rejected' ELSE 'outstanding' END AS state, count(*) AS batches, min(batch_id) AS oldest FROM b GROUP BY 1"""
)
def agg09_ups01_backlog(spark, sf):
    b = observations(spark, sf).select(F.col("normalized_url").alias("batch_id"), "user_id").distinct()
    return aggregates.backlog(b, b.where("user_id % 3 = 0"), b.where("user_id % 3 <> 0 and user_id % 4 = 0"))


@query("WITH " + FEEDS_SQL + "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM feeds WHERE enabled AND deleted_at IS NULL)")
def set4_retain_keys(spark, sf):
    return windows.retain_keys(table(spark, sf, "events"), filters.live(feeds(spark, sf)), "user_id").select("event_id")


@query("SELECT CAST(o_orderpriority AS VARCHAR) AS batch_id, CAST(k AS VARCHAR) AS name, problem FROM (SELECT o_orderpriority, k, CASE WHEN p IS NULL THEN 'missing' ELSE 'undeclared' END AS problem FROM (SELECT DISTINCT o_orderpriority, o_custkey AS k, 1 AS d FROM orders WHERE o_custkey % 2 = 0) FULL JOIN (SELECT DISTINCT o_orderpriority, o_custkey AS k, 1 AS p FROM orders WHERE o_custkey % 3 = 0) USING (o_orderpriority, k) WHERE d IS NULL OR p IS NULL)")
def set3_file_differences(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("batch_id"), F.col("o_custkey").cast("string").alias("name"), "o_custkey").distinct()
    return windows.file_differences(o.where("o_custkey % 2 = 0"), o.where("o_custkey % 3 = 0"))
