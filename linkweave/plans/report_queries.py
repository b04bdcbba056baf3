"""Reports, joins, counts and exports over views of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html, labels, urls
from ..operators import aggregates, filters, joins, sinks, windows
from . import reports
from .merge_queries import FOLLOWS_SQL, TS, folded, synced_follows
from .registered import query
from .views import FEEDS_SQL, FOLD_SQL, OBS_SQL, VOLUME_SQL, WEB_SQL, feeds, iso, moment, observations, table, volume_posts, volume_urls, web_posts, web_urls

LINKS_SQL = "string_agg(position || ' ' || coalesce(unshortened_url, url), ' ' ORDER BY position)"


def shown_links(page):
    return page.withColumn("links", F.array_join(F.transform("links", lambda x: F.concat(x["position"].cast("string"), F.lit(" "), x["shown"])), " "))


@query(
    "WITH "
    + WEB_SQL
    + f""", hit AS (SELECT DISTINCT unique_id FROM post_urls WHERE contains(lower(url), 'th') OR contains(lower(coalesce(unshortened_url, '')), 'th')),
    pg AS (SELECT p.* FROM posts p LEFT JOIN hit h USING (unique_id) WHERE source_type = 'rss' AND (h.unique_id IS NOT NULL OR contains(lower(description), 'th')
      OR contains(lower(source), 'th') OR contains(lower(author), 'th') OR contains(lower(direct_link), 'th')) ORDER BY posted_at DESC, unique_id DESC LIMIT 50)
    SELECT unique_id, source, description, {TS.format('posted_at')} AS posted_at, (SELECT {LINKS_SQL} FROM post_urls u WHERE u.unique_id = pg.unique_id) AS links FROM pg"""
)
def rpt1_post_page(spark, sf):
    """Newest 50 RSS posts that match a search, with their links: the page size is the report's own limit."""
    posts = web_posts(spark, sf)
    page = reports.post_page(posts, web_urls(posts), term="TH", source_type="rss")
    return shown_links(page).select("unique_id", "source", "description", iso("posted_at").alias("posted_at"), "links")


@query(
    "WITH "
    + WEB_SQL
    + """, hit AS (SELECT DISTINCT unique_id FROM post_urls WHERE contains(lower(url), 'th') OR contains(lower(coalesce(unshortened_url, '')), 'th'))
    SELECT count(*) AS total, greatest(ceil(count(*) / 50), 1)::BIGINT AS pages FROM posts p LEFT JOIN hit h USING (unique_id) WHERE h.unique_id IS NOT NULL OR contains(lower(description), 'th')
      OR contains(lower(source), 'th') OR contains(lower(author), 'th') OR contains(lower(direct_link), 'th')"""
)
def rpt1_fil09_jn04_search_totals(spark, sf):
    posts = web_posts(spark, sf)
    return reports.post_totals(posts, web_urls(posts), term="th", source_type="no such type")


@query("WITH " + WEB_SQL + "SELECT unique_id FROM posts WHERE source_type = 'reddit' AND author = (SELECT min(author) FROM posts WHERE source_type = 'reddit')")
def fil07_listing_filter(spark, sf):
    posts = web_posts(spark, sf)
    author = posts.where("source_type = 'reddit'").agg(F.min("author")).first()[0]
    if author is None:  # no post has an author
        return posts.limit(0).select("unique_id")
    return filters.listing_filter(posts, source_type="reddit", author=f" {author} ").select("unique_id")


@query(
    "WITH "
    + VOLUME_SQL
    + """, pg AS (SELECT * FROM posts ORDER BY posted_at DESC, unique_id DESC LIMIT 50 OFFSET 100)
    SELECT unique_id, source, posted_at::DATE::VARCHAR AS day, coalesce((SELECT string_agg(position || ' ' || url, ' ' ORDER BY position, url) FROM post_urls u WHERE u.unique_id = pg.unique_id), '') AS links FROM pg"""
)
def jn03_lim1_volume_page(spark, sf):
    page = windows.page(volume_posts(spark, sf), 3, 50, F.desc("posted_at"), F.desc("unique_id"))
    nested = joins.nested_urls(page, volume_urls(spark, sf), page=True)
    return shown_links(nested).select("unique_id", "source", F.date_format("posted_at", "yyyy-MM-dd").alias("day"), "links")


@query(
    "WITH "
    + VOLUME_SQL
    + """, l AS (SELECT posted_at, unique_id FROM posts ORDER BY posted_at DESC, unique_id DESC LIMIT 1 OFFSET 499)
    SELECT p.unique_id FROM posts p, l WHERE (p.posted_at, p.unique_id) < (l.posted_at, l.unique_id) ORDER BY p.posted_at DESC, p.unique_id DESC LIMIT 50"""
)
def lim1_keyset_page(spark, sf):
    posts = volume_posts(spark, sf)
    last = posts.orderBy(F.desc("posted_at"), F.desc("unique_id")).offset(499).limit(1).first()
    if last is None:  # fewer posts than ten pages
        return posts.limit(0).select("unique_id")
    return windows.page_after(posts, 50, last.posted_at, last.unique_id).select("unique_id")


@query(
    "WITH "
    + VOLUME_SQL
    + """, n AS (SELECT count(*) AS n FROM posts), r AS (SELECT *, row_number() OVER (ORDER BY posted_at DESC, unique_id DESC) AS place FROM posts)
    SELECT unique_id, place FROM r, n WHERE place > (n // 2 // 50) * 50 AND place <= (n // 2 // 50) * 50 + 50"""
)
def lim1_deep_page(spark, sf):
    """The page in the middle of all posts, by the directory of their ranges: 50 is the page's size."""
    posts = volume_posts(spark, sf)
    directory = windows.page_directory(posts, 64)
    number = (directory.agg(F.sum("rows")).first()[0] or 0) // 2 // 50 + 1
    page = windows.directory_page(posts, directory, number, 50)
    place = F.row_number().over(Window.orderBy(F.desc("posted_at"), F.desc("unique_id"))) + (number - 1) * 50  # of one page
    return page.select("unique_id", place.cast("long").alias("place"))


FEED_LIST = (
    "SELECT normalized_url, CASE WHEN deleted_at IS NOT NULL THEN 'removed' WHEN enabled THEN 'active' ELSE 'disabled' END AS status, "
    "CASE WHEN deleted_at IS NOT NULL THEN 'removed' WHEN coalesce(consecutive_failures, 0) > 0 OR coalesce(last_status, 0) >= 400 THEN 'unhealthy' ELSE 'healthy' END AS health, last_status "
    "FROM feeds LEFT JOIN health USING (normalized_url)"
)


@query("WITH " + OBS_SQL + "," + FOLD_SQL + "," + FEEDS_SQL + FEED_LIST)
def rpt2_jn01_feed_list(spark, sf):
    return reports.feed_list(feeds(spark, sf), folded(spark, sf)).select("normalized_url", "status", "health", "last_status")


@query("WITH " + OBS_SQL + "," + FOLD_SQL + "," + FEEDS_SQL + ", l AS (" + FEED_LIST + " WHERE contains(lower(feed_url), 'feed1')), n AS (SELECT (ceil(count(*) / 20) - 1)::BIGINT AS skip FROM l) SELECT normalized_url FROM (SELECT f.*, row_number() OVER (ORDER BY enabled DESC, deleted_at IS NOT NULL, feed_url) AS r FROM feeds f WHERE contains(lower(feed_url), 'feed1')), n WHERE r > skip * 20")
def rpt2_lim2_srt2_clamped_page(spark, sf):
    """A page past the end is the last one; 20 is the report's page size here."""
    return reports.feed_page(feeds(spark, sf), folded(spark, sf), 999, 20, term="FEED1").select("normalized_url")


@query(
    "WITH " + OBS_SQL + "," + FOLD_SQL + "," + FEEDS_SQL + """SELECT count(*) FILTER (WHERE deleted_at IS NULL AND enabled) AS active, count(*) FILTER (WHERE deleted_at IS NULL AND NOT enabled) AS disabled,
    count(*) FILTER (WHERE deleted_at IS NOT NULL) AS removed, count(*) FILTER (WHERE deleted_at IS NULL AND enabled AND (coalesce(consecutive_failures, 0) > 0 OR coalesce(last_status, 0) >= 400)) AS errors,
    count(*) AS total FROM feeds LEFT JOIN health USING (normalized_url)"""
)
def rpt3_agg02_feed_counts(spark, sf):
    return reports.feed_counts(feeds(spark, sf), folded(spark, sf))


@query("WITH " + OBS_SQL + "," + FOLD_SQL + "," + FEEDS_SQL + "SELECT normalized_url FROM feeds JOIN health USING (normalized_url) WHERE enabled AND deleted_at IS NULL AND (consecutive_failures > 0 OR last_status >= 400)")
def fil11_failing_feeds(spark, sf):
    return filters.failing(joins.feeds_with_health(feeds(spark, sf), folded(spark, sf))).select("normalized_url")


@query("WITH " + FEEDS_SQL + "SELECT normalized_url FROM feeds WHERE deleted_at IS NULL AND NOT enabled AND contains(lower(feed_url), 'feed1')")
def fil10_fil12_status_and_search(spark, sf):
    return filters.search_any(filters.by_status(feeds(spark, sf), "disabled"), "Feed1", ["feed_url"]).select("normalized_url")


SUBS_SQL = """
subs AS (SELECT lower(o_orderpriority) AS name, min(o_orderkey) % 2 = 0 AS enabled, CASE WHEN o_orderpriority LIKE '5%' THEN TIMESTAMP '2026-01-01' END AS deleted_at FROM orders GROUP BY o_orderpriority),
st AS (SELECT lower(o_orderpriority) AS name, max(o_custkey) AS last_cursor FROM orders WHERE o_orderpriority NOT LIKE '1%' GROUP BY 1)
"""


def subreddits(spark, sf):
    o = table(spark, sf, "orders")
    subs = o.groupBy("o_orderpriority").agg((F.min("o_orderkey") % 2 == 0).alias("enabled"))
    return subs.select(F.lower("o_orderpriority").alias("name"), "enabled", F.when(F.startswith("o_orderpriority", F.lit("5")), moment("2026-01-01")).alias("deleted_at"))


@query("WITH " + SUBS_SQL + f"""SELECT s.name, CASE WHEN deleted_at IS NOT NULL THEN 'removed' WHEN enabled THEN 'active' ELSE 'disabled' END AS status, last_cursor, (SELECT max(o_orderdate)::DATE::VARCHAR FROM orders WHERE 'r/' || lower(o_orderpriority) = 'r/' || s.name AND o_orderstatus = 'F') AS newest FROM subs s LEFT JOIN st USING (name)""")
def rpt4_jn02_jn05_subreddits(spark, sf):
    o = table(spark, sf, "orders")
    state = o.where("o_orderpriority not like '1%'").groupBy(F.lower("o_orderpriority").alias("name")).agg(F.max("o_custkey").alias("last_cursor"))
    posts = o.where("o_orderstatus = 'F'").select(F.concat(F.lit("R/"), "o_orderpriority").alias("source"), F.col("o_orderdate").alias("posted_at"))
    rows = reports.source_list(subreddits(spark, sf), state, posts, "name", F.lit("r/"))
    return rows.select("name", "status", "last_cursor", F.date_format("newest_at", "yyyy-MM-dd").alias("newest"))


@query("WITH " + SUBS_SQL + "SELECT count(*) FILTER (WHERE deleted_at IS NULL AND enabled) AS active, count(*) FILTER (WHERE deleted_at IS NULL AND NOT enabled) AS disabled, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS removed, count(*) AS total FROM subs")
def agg03_subreddit_counts(spark, sf):
    return aggregates.catalog_counts(subreddits(spark, sf))


@query("SELECT lower(o_orderpriority) AS key, max(o_orderdate)::DATE::VARCHAR AS newest, min(o_orderpriority) AS source FROM orders GROUP BY 1")
def agg05_newest_by_source(spark, sf):
    newest = joins.newest_by_source(volume_posts(spark, sf), F.lower("source"))
    return newest.select("key", F.date_format("newest_at", "yyyy-MM-dd").alias("newest"), "source")


POSTS_OF_FOLLOWS = "SELECT 'https://i' || (o_custkey % 25) || '.example/@' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS source, o_custkey, o_orderdate AS posted_at FROM orders"


@query("WITH " + FOLLOWS_SQL + ", p AS (SELECT lower('Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS k, max(o_orderdate) AS m FROM orders GROUP BY 1)" + f"SELECT instance_name, account_id, m::DATE::VARCHAR AS newest, (SELECT {TS.format('max(synced_at)')} FROM follows) AS synced FROM follows LEFT JOIN p ON lower(acct) = k")
def rpt5_jn06_follows_by_handle(spark, sf):
    o = table(spark, sf, "orders")
    posts = o.select(F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("source"), F.col("o_orderdate").alias("posted_at"))
    rows = reports.follows_list(synced_follows(spark, sf)[0], posts, F.lower("acct"), F.lower("source"))
    return rows.select("instance_name", "account_id", F.date_format("newest_at", "yyyy-MM-dd").alias("newest"), iso("last_synced_at").alias("synced"))


@query("WITH " + FOLLOWS_SQL + ", p AS (SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS k, max(o_orderdate) AS m FROM orders GROUP BY 1), u AS (SELECT *, CASE WHEN account_id NOT LIKE '%7' THEN acct END AS url FROM follows) SELECT instance_name, lower(acct) AS acct, m::DATE::VARCHAR AS newest FROM u LEFT JOIN p ON url = k")
def rpt6_jn07_follows_by_url(spark, sf):
    o = table(spark, sf, "orders")
    posts = o.select(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("source"), F.col("o_orderdate").alias("posted_at"))
    f = synced_follows(spark, sf)[0].withColumn("url", F.when(~F.endswith("account_id", F.lit("7")), F.col("acct")))
    rows = reports.follows_list(f, posts, F.col("url"), F.col("source"))
    return windows.follows_order(rows.select("instance_name", F.lower("acct").alias("acct"), F.date_format("newest_at", "yyyy-MM-dd").alias("newest")), "instance_name", "acct")


@query(
    "WITH " + WEB_SQL + "," + OBS_SQL + "," + FOLD_SQL + "," + FEEDS_SQL + f"""SELECT (SELECT count(*) FROM posts) AS posts, (SELECT {TS.format('max(posted_at)')} FROM posts) AS newest_post, (SELECT count(*) FROM post_urls) AS urls,
    (SELECT count(*) FROM feeds WHERE enabled AND deleted_at IS NULL) AS live_feeds,
    (SELECT count(*) FROM feeds LEFT JOIN health USING (normalized_url) WHERE enabled AND deleted_at IS NULL AND (coalesce(consecutive_failures, 0) > 0 OR coalesce(last_status, 0) >= 400)) AS failing_feeds,
    (SELECT count(*) FROM orders) AS batches, (SELECT max(o_orderdate)::DATE::VARCHAR FROM orders) AS last_published"""
)
def rpt7_agg08_status_report(spark, sf):
    posts = web_posts(spark, sf)
    ledger = table(spark, sf, "orders").select(F.col("o_orderdate").alias("published_at"))
    r = reports.status_report(posts, web_urls(posts), feeds(spark, sf), folded(spark, sf), ledger)
    return r.withColumns({"newest_post": iso("newest_post"), "last_published": F.date_format("last_published", "yyyy-MM-dd")})


@query(
    "WITH " + OBS_SQL + "," + FOLD_SQL + "," + FEEDS_SQL + """, s AS (SELECT *, CASE WHEN deleted_at IS NOT NULL THEN 3 WHEN enabled THEN 1 ELSE 2 END AS section FROM feeds LEFT JOIN health USING (normalized_url))
    SELECT section, 1 AS place, normalized_url, CASE section WHEN 1 THEN feed_url WHEN 3 THEN '# ' || feed_url || '  (removed 2026-01-01T00:00:00Z)'
      ELSE '# ' || feed_url || '  (failures=' || coalesce(consecutive_failures, 0) || coalesce(' last_error=' || last_error, '') || ')' END AS line FROM s
    UNION ALL SELECT section, 0, '', '# --- ' || ['active', 'disabled', 'removed'][section] || ' (' || count(*) || ') ---' FROM s GROUP BY section
    UNION ALL SELECT 0, 0, '', '# active=' || count(*) FILTER (WHERE section = 1) || '  disabled=' || count(*) FILTER (WHERE section = 2) || '  removed=' || count(*) FILTER (WHERE section = 3) FROM s"""
)
def rpt8_snk05_feed_snapshot(spark, sf):
    return sinks.feed_snapshot(joins.feeds_with_health(feeds(spark, sf), folded(spark, sf)))


@query("WITH " + WEB_SQL + "SELECT CASE WHEN coalesce(unshortened_url, '') = '' THEN url ELSE unshortened_url END AS link FROM post_urls JOIN posts USING (unique_id)")
def snk04_jn08_exported_links(spark, sf):
    posts = web_posts(spark, sf)
    return sinks.exported_links(posts, web_urls(posts))


@query("WITH " + OBS_SQL + """SELECT event_id, '{"etag":' || coalesce('"' || etag || '"', 'null') || ',"event_id":' || event_id || ',"normalized_url":"' || normalized_url || '","success":' || success || '}' AS value FROM obs""")
def snk01_json_lines(spark, sf):
    o = observations(spark, sf).select("success", "normalized_url", "event_id", "etag")
    return sinks.json_lines(o).select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), "value")


@query("WITH " + OBS_SQL + "SELECT 'rss_observations' AS kind, CAST(NULL AS VARCHAR) AS scope, count(*) AS records FROM obs UNION ALL SELECT 'mastodon_follows', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'mastodon_follows', 'empty', 0")
def snk02_agg11_cycle_summary(spark, sf):
    o = observations(spark, sf)
    follows = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("scope"))
    claims = o.select(F.lit("mastodon_follows").alias("kind"), F.lit("empty").alias("scope")).distinct()
    return sinks.batch_content({"rss_observations": o, "mastodon_follows": follows}, claims)


@query(
    """WITH c AS (SELECT event_id AS seq, 'https://FEED' || (user_id * 2) || '.example/rss' || CASE WHEN event_id % 2 = 0 THEN '#top' ELSE '' END AS url, 'https://feed' || (user_id * 2) || '.example/rss' AS key FROM events)
    SELECT seq, key, CASE WHEN key IN (SELECT 'https://feed' || user_id || '.example/rss' FROM events) THEN 'present' WHEN seq > min(seq) OVER (PARTITION BY key) THEN 'duplicate_in_input' ELSE 'new' END AS status FROM c"""
)
def jn09_classify_candidates(spark, sf):
    e = table(spark, sf, "events")
    c = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("https://FEED"), (F.col("user_id") * 2).cast("string"), F.lit(".example/rss"), F.when(F.col("event_id") % 2 == 0, "#top").otherwise("")).alias("url"))
    return joins.classify_candidates(c, feeds(spark, sf)).select("seq", "key", "status")


SITE_SQL = r"""
pg AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') AS site,
  regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' AS link, lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title,
  list_transform(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1), lambda h: h) AS links FROM pages)
"""


def site_feeds(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(
        F.col("page_id").alias("id"),
        F.regexp_replace(urls.canonical_hostname("url"), r"^[^.]+\.", "").alias("site"),
        F.when(F.col("page_id") % 11 == 0, "dead").otherwise("active").alias("status"),
        urls.normalize_feed_url("url").alias("feed_key"),
        F.lit("").alias("feed_link"),
        F.lower(html.title("html")).alias("title"),
        html.anchor_hrefs("html").alias("links"),
        F.split(F.lower(html.title("html")), " ").alias("titles"),
        F.col("page_id").alias("seq"),
    )


@query(
    r"""WITH pg AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\.', ''), '^[^.]+\.', '') AS site, page_id % 11 <> 0 AS live,
      lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END || regexp_extract(url, '(\?[^#]*)', 1) AS feed_key,
      lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS links FROM pages),
    w AS (SELECT *, string_split(title, ' ') AS titles FROM pg),
    r AS (SELECT c.page_id AS id, e.page_id AS dup, CASE WHEN c.feed_key = e.feed_key THEN 'same feed' WHEN len(c.links) > 0 AND len(e.links) > 0 AND c.links[1] = e.links[1] THEN 'same newest link'
      WHEN len(list_distinct(list_intersect(c.links, e.links))) >= 3 THEN 'shared links' WHEN c.title <> '' AND c.title = e.title AND len(list_distinct(list_intersect(c.titles, e.titles))) >= 2 THEN 'shared titles' END AS reason
      FROM w c JOIN w e USING (site) WHERE c.live AND e.live AND c.page_id <> e.page_id)
    SELECT id, min(dup) AS duplicate_of, arg_min(reason, dup) AS reason FROM r WHERE reason IS NOT NULL GROUP BY id"""
)
def jn10_set2_content_duplicates(spark, sf):
    f = site_feeds(spark, sf)
    return joins.content_duplicates(f.drop("seq"), f)


@query(
    """WITH e AS (SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0.25 * count(*) THEN 404 ELSE 200 END AS st, count(*) FILTER (WHERE event_type = 'view') - 8 AS n,
      max(ts) FILTER (WHERE user_id % 10 <> 0 AND event_type = 'purchase') AS latest FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN st >= 400 OR n <= 0 THEN 'dead' WHEN latest IS NULL THEN 'unknown_date' WHEN latest < TIMESTAMP '2024-01-31' - INTERVAL 2 DAY THEN 'abandoned' ELSE 'active' END AS status FROM e"""
)
def fil13_candidate_status(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(
        F.when(F.count_if(F.col("event_type") == "error") > 0.25 * F.count("*"), 404).otherwise(200).alias("st"),
        F.greatest(F.count_if(F.col("event_type") == "view") - 8, F.lit(0)).alias("n"),
        F.max(F.when((F.col("user_id") % 10 != 0) & (F.col("event_type") == "purchase"), F.col("ts").cast("timestamp_ntz"))).alias("latest"),
    )
    return e.select("user_id", filters.candidate_status(F.col("st"), F.lit(False), F.col("n"), F.col("latest"), moment("2024-01-31"), 2).alias("status"))


@query("WITH " + OBS_SQL + "," + FEEDS_SQL + ", v AS (SELECT normalized_url, arg_max({'e': etag, 'm': last_modified}, seq) AS v FROM obs WHERE success GROUP BY 1) SELECT normalized_url, v['e'] AS etag, v['m'] AS last_modified FROM feeds LEFT JOIN (SELECT * FROM v WHERE v['e'] IS NOT NULL OR v['m'] IS NOT NULL) USING (normalized_url)")
def jn11_feeds_with_validators(spark, sf):
    from ..operators import merges

    o = observations(spark, sf)
    cache = merges.validator_cache(o.limit(0).select("normalized_url", "etag", "last_modified"), o)
    return joins.feeds_with_validators(feeds(spark, sf), cache).select("normalized_url", "etag", "last_modified")


@query("SELECT lower(source) AS name, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 7")
def srt3_lim3_limited_list(spark, sf):
    """The first seven names: a limit is what this operator is."""
    d = table(spark, sf, "documents").where("source is not null").groupBy(labels.normalize_text("source").alias("name")).agg(F.count("*").alias("n"))
    ordered = windows.catalog_order(d.withColumns({"enabled": F.lit(True), "deleted_at": F.lit(None).cast("timestamp")}), "name")
    return windows.limited(ordered, 7).select("name", "n")
