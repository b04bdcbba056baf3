"""Batches written from the given tables, published by the stream in several micro-batches, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import sinks
from ..sources import batches, lists
from ..streaming import publish
from .registered import query
from .stream_queries import work_folder
from .views import FOLD_SQL, OBS_SQL, WEB_SQL, iso, observations, table, web_posts

BATCHES = 4
#: The day a batch's follows were observed: the second batch has the newest, the third and fourth come too late.
OBSERVED = ("2026-01-02", "2026-01-04", "2026-01-03", "2026-01-01")
_WRITTEN: dict[tuple[str, str], str] = {}
_PUBLISHED: dict[tuple[str, str], publish.Store] = {}


def batch_id(number: int) -> str:
    return f"202601{number + 1:02d}T000000000000Z-{number:08x}"


def number_of(batch: str = "batch_id"):
    return (F.substring(batch, 7, 2).cast("int") - 1).alias("batch")


def files_of(spark: SparkSession, sf: str, landing: str, k: int) -> tuple[str, str] | None:
    """The files of batch ``k``: the rows whose id leaves ``k``; two more have the regions: one is of a version that no reader knows, one has bad lines."""
    if k >= BATCHES:
        kind = F.when((F.col("r_regionkey") % 2 == 1) & F.lit(k > BATCHES), "Rss").otherwise("rss")
        r = table(spark, sf, "region").orderBy(F.desc("r_name")).select(F.col("r_name").alias("unique_id"), F.lit("s").alias("source"), kind.alias("source_type"), *(F.lit("").alias(n) for n in ("author", "description", "direct_link")), F.lit("2026-01-01T00:00:00Z").alias("posted_at"), F.array(F.lit("https://x.example/")).alias("urls"))
        return sinks.batch_files(spark, landing, batch_id(k), {"posts": r}, [], "2026-01-01T00:00:00Z", contract_version=2 if k == BATCHES else 1)
    own = lambda df, key: df.where(F.col(key) % BATCHES == k).orderBy(key)
    posts = own(web_posts(spark, sf).withColumn("posted_at", iso("posted_at")), "page_id").select(*(f.split(" ")[0] for f in schemas.POST.split(", ")))
    o = own(observations(spark, sf), "event_id").withColumn("feed_url", F.col("normalized_url"))
    o = o.withColumns({c: iso(c) for c in ("observed_at", "latest_entry_at")})
    source = F.element_at(F.array(*map(F.lit, ("reddit", "bluesky", "mastodon", "later"))), (F.col("user_id") % 4 + 1).cast("int"))
    c = o.select(source.alias("source_type"), F.col("user_id").cast("string").alias("source_key"), F.col("event_id").cast("string").alias("cursor"), "observed_at", F.lit(None).cast("string").alias("source_url"))
    people = own(table(spark, sf, "customer"), "c_custkey").withColumn("id", F.col("c_custkey").cast("string"))
    bluesky = people.select(F.concat(F.lit("did:"), "id").alias("did"), F.col("c_name").alias("handle"), F.lit(None).cast("string").alias("display_name"))
    mastodon = lambda s: people.where(F.col("c_nationkey") % 2 == s).select(F.col("id").alias("account_id"), F.col("c_name").alias("acct"), *(F.lit(None).cast("string").alias(n) for n in ("display_name", "url")))
    at = f"{OBSERVED[k]}T00:00:00Z"
    snapshots = [("bluesky_follows", None, at, bluesky), *(("mastodon_follows", f"s{s}", at, mastodon(s)) for s in (0, 1))]
    kinds = {"posts": posts, "rss_observations": o.select(*(f.split(" ")[0] for f in schemas.OBSERVATION.split(", "))), "checkpoints": c}
    return sinks.batch_files(spark, landing, batch_id(k), kinds, snapshots, at)


def landed(spark: SparkSession, sf: str) -> str:
    """SNK-1: the landing folder with all batches, written once for an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        landing = f"{work_folder(spark)}/landing"
        for batch in sinks.at_once(spark, *(lambda k=k: files_of(spark, sf, landing, k) for k in range(BATCHES + 2))):
            sinks.land(spark, batch)
        _WRITTEN[key] = landing
    return _WRITTEN[key]


def published(spark: SparkSession, sf: str) -> publish.Store:
    """STR-1, STR-6: the store after a run of two micro-batches and one that finds nothing new, compacted, once for an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PUBLISHED:
        landing, folder = landed(spark, sf), work_folder(spark)
        store = publish.Store(spark, f"{folder}/store")
        for _ in range(2):
            publish.publish(spark, landing, store, f"{folder}/checkpoint", lambda: F.lit("2026-02-01").cast("timestamp"), most_batches=3)
        store.compact()
        _PUBLISHED[key] = publish.Store(spark, store.root, store.version())
    return _PUBLISHED[key]


def retained(spark: SparkSession, sf: str) -> publish.Store:
    """UPS-17: the same store after retention, compacted; ``published`` still reads the version before."""
    key = (spark.sparkContext.applicationId, sf, "retained")
    if key not in _PUBLISHED:
        store = publish.Store(spark, published(spark, sf).root)
        store.retain(F.lit("2026-02-05 12:00:00").cast("timestamp"), 1)
        store.compact()
        _PUBLISHED[key] = publish.Store(spark, store.root, store.version())
    return _PUBLISHED[key]


def of_batches(df: DataFrame) -> DataFrame:
    return df.select(number_of(), *(c for c in df.columns if c != "batch_id"))


@query("WITH " + WEB_SQL + "SELECT (page_id % 4)::INT AS batch, unique_id, len(urls)::INT AS n FROM posts UNION ALL SELECT unnest([4, 5]), r_name, 1 FROM region")
def src01_src07_landed_posts(spark, sf):
    rows = batches.records(spark, landed(spark, sf), "posts")
    return rows.select(number_of(), "record.unique_id", F.size("record.urls").alias("n"))


CP_SQL = """
cp AS (SELECT ['reddit', 'bluesky', 'mastodon', 'later'][(user_id % 4)::INT + 1] AS source_type, user_id::VARCHAR AS source_key, event_id::VARCHAR AS cursor, date_trunc('second', ts) AS observed_at,
  (event_id % 4)::INT AS batch, event_id FROM events)
"""


@query("WITH " + CP_SQL + "SELECT batch, source_type, source_key, cursor, epoch(observed_at)::BIGINT AS seconds FROM cp")
def src03_landed_checkpoints(spark, sf):
    rows = batches.records(spark, landed(spark, sf), "checkpoints")
    seconds = F.unix_seconds(F.to_timestamp("record.observed_at"))
    return rows.select(number_of(), "record.source_type", "record.source_key", "record.cursor", seconds.alias("seconds"))


SNAPSHOTS_SQL = """
f AS (SELECT (c_custkey % 4)::INT AS batch, '' AS scope, 'did:' || c_custkey AS member FROM customer
  UNION ALL SELECT (c_custkey % 4)::INT, 's' || (c_nationkey % 2), c_custkey::VARCHAR FROM customer),
s AS (SELECT *, ['2026-01-02', '2026-01-04', '2026-01-03', '2026-01-01'][batch + 1] AS day FROM f)
"""


@query("WITH " + SNAPSHOTS_SQL + "SELECT * FROM s")
def src04_src05_landed_follows(spark, sf):
    root = landed(spark, sf)
    files = batches.manifest_files(batches.manifests(spark, root))
    of_kind = lambda kind, member: batches.snapshot_rows(batches.records(spark, root, kind), files).select(
        number_of(), F.coalesce("scope", F.lit("")).alias("scope"), F.col(f"record.{member}").alias("member"), F.substring("observed_at", 1, 10).alias("day")
    )
    return of_kind("bluesky_follows", "did").union(of_kind("mastodon_follows", "account_id"))


@query(
    "WITH " + WEB_SQL + """, n AS (SELECT (page_id % 4)::INT AS batch, count(*) AS n, 1 AS files FROM posts GROUP BY 1 UNION ALL SELECT (event_id % 4)::INT, 2 * count(*), 2 FROM events GROUP BY 1
      UNION ALL SELECT (c_custkey % 4)::INT, 2 * count(*), 3 FROM customer GROUP BY 1 UNION ALL SELECT unnest([4, 5]), count(*), 1 FROM region)
    SELECT batch, sum(files)::INT AS files, sum(n)::BIGINT AS records FROM n WHERE batch NOT IN (0, 2) GROUP BY batch"""
)
def src06_src07_ups01_outstanding(spark, sf):
    """What is left of the landed batches for a ledger that has the first and the third."""
    root = landed(spark, sf)
    ledger = table(spark, sf, "region").select(F.lit(batch_id(0)).alias("batch_id")).union(table(spark, sf, "region").select(F.lit(batch_id(2)))).distinct()
    left = batches.outstanding(batches.manifests(spark, root), ledger)
    return of_batches(batches.manifest_files(left).groupBy("batch_id").agg(F.count("*").cast("int").alias("files"), F.sum("record_count").alias("records")))


@query(
    "WITH " + WEB_SQL + "," + CP_SQL + """, b AS (SELECT *, max(observed_at) OVER (PARTITION BY source_type, source_key ORDER BY batch, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bar FROM cp),
    c AS (SELECT batch, count(*) AS n, count(*) FILTER (WHERE source_type <> 'later' AND (bar IS NULL OR observed_at > bar)) AS applied FROM b GROUP BY batch),
    p AS (SELECT (page_id % 4)::INT AS batch, count(*) AS posts, sum(len(urls))::BIGINT AS urls FROM posts GROUP BY 1), m AS (SELECT (c_custkey % 4)::INT AS batch, count(*) AS people FROM customer GROUP BY 1)
    SELECT batch, posts + 2 * n + 2 * people AS record_count, posts AS posts_inserted, urls AS urls_inserted, applied AS checkpoints_applied, n - applied AS checkpoints_skipped FROM c JOIN p USING (batch) JOIN m USING (batch)"""
)
def str01_str06_ups06_ups10_published_ledger(spark, sf):
    return of_batches(published(spark, sf).read("ledger").drop("published_at"))


@query("WITH " + WEB_SQL + "SELECT unique_id, source_type, description, epoch(posted_at)::BIGINT AS seconds FROM posts")
def str02_snk08_published_posts(spark, sf):
    """The newest version of the posts, once each although one stream ran twice over the folder."""
    return published(spark, sf).read("posts").select("unique_id", "source_type", "description", F.unix_seconds("posted_at").alias("seconds"))


LANDED_OBS = OBS_SQL.replace("obs AS", "obs0 AS") + """, obs AS (SELECT * REPLACE (date_trunc('second', observed_at) AS observed_at, date_trunc('second', latest_entry_at) AS latest_entry_at,
  (event_id % 4) * 1000000000 + event_id AS seq) FROM obs0)"""


@query("WITH " + LANDED_OBS + "," + FOLD_SQL + "SELECT normalized_url, epoch(last_fetched_at)::BIGINT AS fetched, epoch(last_success_at)::BIGINT AS succeeded, last_status, last_error, consecutive_failures::INT AS failures, etag, last_modified, site_link FROM health")
def str04_published_health(spark, sf):
    h = published(spark, sf).read("health")
    return h.select("normalized_url", F.unix_seconds("last_fetched_at").alias("fetched"), F.unix_seconds("last_success_at").alias("succeeded"), "last_status", "last_error", F.col("consecutive_failures").alias("failures"), "etag", "last_modified", "site_link")


@query("WITH " + SNAPSHOTS_SQL + "SELECT scope, member FROM s JOIN (SELECT scope, max(day) AS day FROM s GROUP BY scope) USING (scope, day)")
def ups07_ups09_published_follows(spark, sf):
    store = published(spark, sf)
    return store.read("bluesky_follows").select("scope", F.col("did").alias("member")).union(store.read("mastodon_follows").select("scope", "account_id"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY r_name DESC) AS line FROM region)
    SELECT DISTINCT 4 AS batch, 'version' AS reason FROM region UNION ALL SELECT 5, 'posts.ndjson line ' || min(line) || ': source_type' FROM r WHERE r_regionkey % 2 = 1"""
)
def val4_str07_quarantined_batches(spark, sf):
    return of_batches(published(spark, sf).read("rejected").drop("failed_at"))


@query(
    "WITH " + WEB_SQL + """, p AS (SELECT unique_id, posted_at >= TIMESTAMP '2026-01-05 12:00:00' AS kept FROM posts), u AS (SELECT unique_id, count(*) AS n FROM post_urls GROUP BY 1)
    SELECT unique_id, n AS links_before, CASE WHEN kept THEN n END AS links_after, kept FROM p JOIN u USING (unique_id)"""
)
def ups17_jn12_retained_store(spark, sf):
    """Each post's links in the version before retention and in the one after it."""
    links = lambda store, name: store.read("post_urls").groupBy("unique_id").agg(F.count("*").alias(name))
    after = retained(spark, sf)
    kept = after.read("posts").select("unique_id", F.lit(True).alias("kept")).join(links(after, "links_after"), "unique_id", "left")
    both = published(spark, sf).read("posts").select("unique_id").join(links(published(spark, sf), "links_before"), "unique_id").join(kept, "unique_id", "left")
    return both.select("unique_id", "links_before", "links_after", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("SELECT DISTINCT url AS entry FROM pages WHERE NOT starts_with(url, '#')")
def snk06_written_candidates(spark, sf):
    """Candidates written as one ordered list and read back."""
    path = f"{work_folder(spark)}/accepted.txt"
    sinks.write_lines(table(spark, sf, "pages").select("url").distinct().orderBy("url"), "url", path)
    return lists.read_list(spark, path).select("entry")


@query("SELECT c_custkey, c_nationkey + 1 AS nation FROM customer")
def snk08_table_versions(spark, sf):
    """Two versions of a table; the second is the one that a reader takes."""
    root = f"{work_folder(spark)}/customers"
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    sinks.write_version(c, root, 1)
    return spark.read.parquet(sinks.write_version(c.withColumn("nation", F.col("nation") + 1), root, 2))
