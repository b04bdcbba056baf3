"""Publishing landed batches: a file stream whose micro-batches are merged into versioned tables, exactly once.

The stream is of manifests, which a batch's writer writes last: what has no manifest yet isn't there yet, and waits. A micro-batch
holds some manifests; those the ledger knows are left out, and of the others all files are read and verified: names, digests, counts,
records. A batch that fails is quarantined as a whole and doesn't stop the others. The rest is merged in order of arrival (batch_id,
then line): posts, links, observations, checkpoints and follows. A version adds rows to the insert-only tables and holds the next
state of the keyed ones (as large as the catalog); its ledger, written last, makes it count: a replay after a failure
finds either the old version or the batch in the ledger. Posts are compared by their keys alone, of which the index opens the buckets
that matter, and never rewritten. Follows
are added for the scopes that a newer snapshot replaces, and a scope's claim says which version holds it. Posts and links lie by
month; retention is a version that leaves months out. ``compact`` gathers the small versions. Rows that break a table's rules
make the write fail. A query that fails for a reason that may pass goes on from its checkpoint, a bounded number of times (STR-7).
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from .. import schemas
from ..functions.times import contract_timestamp
from ..operators import merges, sinks, validation, windows
from ..sources import batches

TABLES = {
    "posts": "unique_id string, source string, source_type string, author string, description string, direct_link string, posted_at timestamp, first_seen_at timestamp",
    "post_urls": "unique_id string, position int, url string, url_hash string, unshortened_url string",
    "health": schemas.HEALTH.replace("timestamp_ntz", "timestamp"),
    "checkpoints": "source_type string, source_key string, observed_at timestamp, cursor string, source_url string",
    "bluesky_follows": "scope string, did string, handle string, display_name string, synced_at timestamp",
    "mastodon_follows": "scope string, account_id string, acct string, display_name string, url string, synced_at timestamp",
    "follows_snapshots": "source_type string, scope string, observed_at timestamp, record_count long",
    "ledger": "batch_id string, published_at timestamp, record_count long, posts_inserted long, urls_inserted long, checkpoints_applied long, checkpoints_skipped long",
    "rejected": "batch_id string, reason string, failed_at timestamp",
}
#: Tables whose versions add rows; of the others a version is the whole table.
APPENDED = ("posts", "post_urls", "bluesky_follows", "mastodon_follows", "ledger", "rejected")
#: Columns that are stored beside a table's own: where its rows lie, and what says if they count.
STORED = {"posts": "month string", "post_urls": "posted_at timestamp, month string", "bluesky_follows": "version int", "mastodon_follows": "version int", "follows_snapshots": "version int"}
RETENTION = "posts_from timestamp, ledger_from timestamp"
#: Kind of a snapshot's file -> (source type, table, key of a member).
FOLLOWS = {"bluesky_follows": ("bluesky", "did"), "mastodon_follows": ("mastodon", "account_id")}


def names(ddl: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in ddl.split(",")]


def checked(rows: DataFrame, name: str) -> DataFrame:
    """VAL-6, VAL-7: ``rows`` of a table; one that breaks a rule makes the job that writes them fail."""
    rules = validation.TABLE_RULES.get(name)
    if rules is None:
        return rows
    broken = validation.errors(rules())
    said = F.concat(F.lit(f"a row of {name} breaks: "), F.array_join(broken, ", "))
    return rows.where(F.when(F.size(broken) == 0, True).otherwise(F.raise_error(said).cast("boolean")))


@dataclass
class Store:
    """Versioned tables under a root folder. The newest version that has a ledger is the current one, unless one is ``pinned``."""

    spark: SparkSession
    root: str
    pinned: int | None = None
    bucket_rows: int = 1_000_000  # keys in a bucket of the key index, about

    def _versions(self, name: str, kind: str = "v") -> list[int]:
        return sinks.written_versions(self.spark, f"{self.root}/{name}", kind)

    def version(self) -> int:
        return self.pinned if self.pinned is not None else max(self._versions("ledger"), default=0)

    def _rows(self, name: str, version: int) -> DataFrame:
        """What is stored of a table up to a version: its own columns and those of ``STORED``."""
        root, schema = f"{self.root}/{name}", ", ".join(x for x in (TABLES[name], STORED.get(name)) if x)
        written = [v for v in self._versions(name) if v <= version]
        if name not in APPENDED:
            paths = [sinks.version_path(root, v) for v in written[-1:]]
        else:
            compacted = max((v for v in self._versions(name, "c") if v <= version), default=0)
            paths = [sinks.version_path(root, v) for v in written if v > compacted]
            paths += [sinks.version_path(root, compacted, "c")] if compacted else []
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths).select(*names(schema)) if paths else self.spark.createDataFrame([], schema)

    def _limits(self, version: int):
        """The newest retention's row of RETENTION, if any."""
        retained = [v for v in self._versions("retention") if v <= version]
        return self.spark.read.schema(RETENTION).parquet(sinks.version_path(f"{self.root}/retention", retained[-1])).first() if retained else None

    def _kept(self, name: str, version: int) -> DataFrame:
        """``_rows`` that count: within the retention, and of follows those of the version that their scope's claim names."""
        rows = self._rows(name, version)
        if name in FOLLOWS:
            claims = self._rows("follows_snapshots", version).where(F.col("source_type") == FOLLOWS[name][0])
            return rows.join(F.broadcast(claims.select("scope", "version")), ["scope", "version"], "left_semi")  # a row a scope
        cut = self._limits(version) if name in ("posts", "post_urls", "ledger") else None
        if cut and name == "ledger":
            return rows.where(F.col("published_at") >= F.lit(cut["ledger_from"]))
        return self._retained(rows, cut) if cut else rows

    @staticmethod
    def _retained(rows: DataFrame, cut) -> DataFrame:
        from_ = F.lit(cut["posts_from"])
        return rows.where((F.col("month") >= F.date_format(from_, "yyyy-MM")) & (F.col("posted_at") >= from_))

    def keys(self, version: int, sought: DataFrame) -> DataFrame:
        """UPS-2: the ``unique_id`` of stored posts that may be among ``sought``, by the key index.

        The index is made by ``compact``: keys in buckets by their hash, so of what is gathered only the buckets of sought keys are
        opened. Versions since then are read as they are, as is everything before the first compaction.
        """
        indexed = max((v for v in self._versions("post_keys", "c") if v <= version), default=0)
        if not indexed:
            return self._kept("posts", version).select("unique_id")
        path = sinks.version_path(f"{self.root}/post_keys", indexed, "c")
        index = self.spark.read.schema("unique_id string, posted_at timestamp, month string, buckets int, bucket int").parquet(path)
        buckets = index.select("buckets").first()
        if buckets is None:
            index = index.select("unique_id", "posted_at", "month")
        else:
            bucket = F.pmod(F.xxhash64("unique_id"), F.lit(buckets[0]))
            opened = [r[0] for r in sought.select(bucket.alias("b")).distinct().collect()]  # numbers of buckets
            index = index.where(F.col("bucket").isin(opened)).select("unique_id", "posted_at", "month")
        newer = [sinks.version_path(f"{self.root}/posts", v) for v in self._versions("posts") if indexed < v <= version]
        if newer:
            posts = self.spark.read.schema(f"{TABLES['posts']}, {STORED['posts']}").option("basePath", f"{self.root}/posts").parquet(*newer)
            index = index.unionByName(posts.select("unique_id", "posted_at", "month"))
        cut = self._limits(version)
        return (self._retained(index, cut) if cut else index).select("unique_id")

    def _index_keys(self, version: int) -> None:
        """Writes the key index of all posts that count, ``bucket_rows`` keys a bucket; it may be written again."""
        keys = self._kept("posts", version).select("unique_id", "posted_at", "month")
        buckets = -(-keys.count() // self.bucket_rows) or 1
        keys = keys.withColumns({"buckets": F.lit(buckets), "bucket": F.pmod(F.xxhash64("unique_id"), F.lit(buckets)).cast("int")})
        sinks.write_version(keys.repartition("bucket"), f"{self.root}/post_keys", version, "c", ["buckets", "bucket"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        own = names(TABLES[name])
        return self._kept(name, self.version() if version is None else version).select(*own)

    def write(self, tables: dict[str, DataFrame], version: int) -> None:
        """New rows and next states as a version; the ledger comes last. What a lost attempt left of the version goes."""
        for name in [*(n for n in TABLES if n != "ledger"), "retention", "ledger"]:
            if name not in tables:
                sinks.delete_version(self.spark, f"{self.root}/{name}", version)
                continue
            if name == "retention":
                rows = tables[name]
            else:
                rows = checked(tables[name].select(*names(TABLES[name]), *(names(STORED[name]) if name in STORED else [])), name)
            sinks.write_version(rows, f"{self.root}/{name}", version, partition_by="month" if name in ("posts", "post_urls") else None)

    def retain(self, now, months: int, days: int = 90) -> None:
        """UPS-17, JN-12: a version without posts older than ``months``, their links, and ledger entries older than ``days``.

        Only the limits are written: readers leave out the months before, and read a month in part at most. Older versions stay as they are.
        """
        if months <= 0 or days <= 0:
            raise ValueError("months and days must be positive")
        version = self.version()
        limits = self.spark.range(1).select((now - F.make_ym_interval(F.lit(0), F.lit(months))).cast("timestamp").alias("posts_from"), (now - F.make_dt_interval(F.lit(days))).cast("timestamp").alias("ledger_from"))
        self.write({"retention": limits, "ledger": self.spark.createDataFrame([], TABLES["ledger"])}, version + 1)

    def compact(self) -> None:
        """Gathers the versions so far of the tables that add rows, without what no longer counts; posts and links lie by time.

        Readers then open one folder and what came after it; the keys of posts are indexed (``keys``).
        """
        version = self.version()
        if version > max(self._versions("ledger", "c"), default=0):
            self._index_keys(version)
            for name in sorted(APPENDED, key=lambda n: n == "ledger"):
                rows = self._kept(name, version)
                by_month = name in ("posts", "post_urls")
                if by_month:
                    rows = rows.repartitionByRange("month", "posted_at").sortWithinPartitions("month", "posted_at")
                sinks.write_version(rows, f"{self.root}/{name}", version, "c", "month" if by_month else None)

    def expire(self) -> None:
        """Deletes the versions that are gathered in the newest compaction; versions before it can't be read any more."""
        last = max(self._versions("ledger", "c"), default=0)
        for v in [v for v in self._versions("post_keys", "c") if v < last]:
            sinks.delete_version(self.spark, f"{self.root}/post_keys", v, "c")
        for name in APPENDED:
            for v in [v for v in self._versions(name, "c") if v < last]:
                sinks.delete_version(self.spark, f"{self.root}/{name}", v, "c")
            # the ledger's versions say which ones count
            for v in [v for v in self._versions(name) if v <= last and name != "ledger"]:
                sinks.delete_version(self.spark, f"{self.root}/{name}", v)


def manifests_stream(spark: SparkSession, root: str, most_batches: int = 1000) -> DataFrame:
    """STR-1: ``batch_id, folder, value`` of each landed manifest, oldest first, ``most_batches`` in a micro-batch."""
    files = spark.readStream.schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json")
    path = F.col("_metadata.file_path")
    rows = files.option("maxFilesPerTrigger", most_batches).text(root)
    return rows.select(F.regexp_extract(path, batches.BATCH_OF_PATH, 1).alias("batch_id"), F.regexp_replace(path, "/[^/]*$", "").alias("folder"), "value").where("batch_id <> ''")


def record_lines(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``batch_id, file_name, line, value`` of all record files of some batches; ``line`` orders a file's lines."""
    lines = spark.read.option("pathGlobFilter", "*.ndjson").option("recursiveFileLookup", "true").text(folders)
    return lines.select(
        F.regexp_extract("_metadata.file_path", batches.BATCH_OF_PATH, 1).alias("batch_id"),
        F.col("_metadata.file_name").alias("file_name"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line"),
        "value",
    )


def parsed(rows: DataFrame, kind: str) -> DataFrame:
    """The lines of a kind's files with their ``record``."""
    name, schema = schemas.KINDS[kind]
    return rows.where(F.col("file_name").like(name.replace("*", "%"))).select("*", validation.once(F.from_json("value", schema)).alias("record"))


def ordered(rows: DataFrame, kind: str) -> DataFrame:
    """The records of a kind with ``seq``, their place in the order of arrival."""
    return parsed(rows, kind).select(F.struct("batch_id", "line").alias("seq"), "batch_id", "file_name", "record.*")


def problems(manifests: DataFrame, rows: DataFrame, present: DataFrame) -> DataFrame:
    """VAL-1..4: ``batch_id, problem`` of manifests, files and lines; of a file's lines the first that breaks a rule, with its number."""
    found = [validation.manifest_problems(manifests)]
    files = batches.manifest_files(manifests.withColumn("batch_id", F.col("dir_batch_id")))
    found.append(validation.batch_problems(files, present).select("batch_id", F.concat("name", F.lit(": "), "problem").alias("problem")))
    bad = [validation.checked_records(parsed(rows, kind), kind).select("batch_id", "file_name", "line", F.explode("errors").alias("error")) for kind in schemas.KINDS]
    first = reduce(DataFrame.unionByName, bad).groupBy("batch_id", "file_name", "error").agg(F.min("line").alias("line")).withColumn("block", F.col("line.block"))
    first = first.join(batches.line_numbers(rows), ["batch_id", "file_name", "block"])
    number = (F.col("before") + F.col("line.row") - F.col("first") + 1).cast("string")
    found.append(first.select("batch_id", F.concat("file_name", F.lit(" line "), number, F.lit(": "), "error").alias("problem")))
    return reduce(DataFrame.unionByName, found)


def follows(store: Store, version: int, good: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """UPS-7..9: the members of the scopes that a newer snapshot replaces, and the next claims, which name the version that holds a scope.

    ``files``: entries of the valid batches' manifests, with their time. An empty snapshot clears its scope; other scopes aren't written.
    """
    claims, out, nexts = store._rows("follows_snapshots", version), {}, []
    for kind, (source_type, member) in FOLLOWS.items():
        entries = files.where(F.col("kind") == kind).select(
            F.concat_ws("/", "batch_id", "name").alias("snapshot_id"), F.coalesce("scope", F.lit("")).alias("scope"), contract_timestamp(F.coalesce("observed_at", "created_at")).alias("observed_at"), F.col("record_count").cast("long")
        )
        snapshots = entries.withColumn("seq", F.row_number().over(Window.partitionBy("scope").orderBy("snapshot_id")))
        rows = ordered(good, kind).withColumn("snapshot_id", F.concat_ws("/", "batch_id", "file_name")).join(F.broadcast(entries.select("snapshot_id", "scope")), "snapshot_id")
        rows = rows.select("snapshot_id", "scope", F.col("seq").alias("line"), *(c for c in names(TABLES[kind]) if c not in ("scope", "synced_at")))
        own = claims.where(F.col("source_type") == source_type)
        won = merges.won_snapshots(own, snapshots)
        out[kind] = merges.snapshot_members(rows, F.broadcast(won), member).withColumn("version", F.lit(version + 1))
        nexts.append(own.join(won.select("scope"), "scope", "left_anti").select(*claims.columns))
        nexts.append(won.select(F.lit(source_type).alias("source_type"), "scope", "observed_at", "record_count", F.lit(version + 1).alias("version")).select(*claims.columns))
    return out | {"follows_snapshots": reduce(DataFrame.unionByName, nexts)}


def apply_batches(store: Store, landed: DataFrame, now) -> None:
    """UPS-1..10, STR-2..4: the next version of the tables after the batches ``landed (batch_id, folder, value)``; nothing if all are known."""
    spark, version = store.spark, store.version()
    known = store.read("ledger", version).select("batch_id").union(store.read("rejected", version).select("batch_id"))
    new = merges.outstanding(landed, known)
    columns = new.columns
    new = new.dropDuplicates(["batch_id"]).collect()  # as many as a micro-batch has manifests
    if not new:
        return
    manifests = spark.createDataFrame([tuple(r) for r in new], "batch_id string, folder string, value string").toDF(*columns)
    manifests = manifests.select(F.col("batch_id").alias("dir_batch_id"), F.from_json("value", schemas.MANIFEST).alias("m")).select("dir_batch_id", "m.*")
    folders = [r["folder"] for r in new]
    rows, kept = record_lines(spark, folders).persist(), []
    kept.append(rows)
    try:
        # a row for each bad batch of the micro-batch: fetched, so that what follows doesn't plan the whole validation again
        reasons = validation.quarantine(problems(manifests, rows, batches.file_digests(spark, *folders)), now).select("batch_id", "reason").collect()
        bad = spark.createDataFrame([tuple(r) for r in reasons], "batch_id string, reason string").withColumn("failed_at", now)
        good = validation.reject(rows, bad)
        valid = validation.reject(manifests.drop("batch_id").withColumnRenamed("dir_batch_id", "batch_id"), bad)
        posts = ordered(good, "posts").withColumn("posted_at", contract_timestamp("posted_at"))
        fresh = merges.insert_ignore(store.keys(version, posts.select("unique_id")), posts, "unique_id").withColumns({"first_seen_at": now, "month": F.date_format("posted_at", "yyyy-MM")}).persist()
        kept.append(fresh)
        links = merges.urls_of(fresh).withColumn("unshortened_url", F.lit(None).cast("string")).join(fresh.select("unique_id", "posted_at", "month"), "unique_id")
        o = ordered(good, "rss_observations")
        o = o.withColumns({c: contract_timestamp(c) for c in ("observed_at", "latest_entry_at")})
        c = ordered(good, "checkpoints").withColumn("observed_at", contract_timestamp("observed_at"))
        split = F.struct("seq.batch_id", "seq.line.block")  # what came by one split of a file is a range of arrivals
        cursors = store.read("checkpoints", version)
        counts = merges.ledger_entries(valid, good, fresh, links, now).join(merges.checkpoint_counts(cursors, c, split), "batch_id", "left")
        counts = counts.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("checkpoints_applied", "checkpoints_skipped")})
        files = valid.select("batch_id", "created_at", F.explode("files").alias("f")).select("batch_id", "created_at", "f.*")
        store.write(
            {
                "posts": fresh,
                "post_urls": links,
                "health": merges.fold_health(store.read("health", version), o, split),
                "checkpoints": merges.strictly_newer(cursors, c.where(F.col("source_type").isin(*merges.CHECKPOINT_SOURCES)), ["source_type", "source_key"], ["cursor", "source_url"]),
                **follows(store, version, good, files),
                "rejected": bad,
                "ledger": counts,
            },
            version + 1,
        )
    finally:
        for table in kept:
            table.unpersist()


#: Errors that may pass by themselves: of file systems, networks and time limits.
TRANSIENT = ("IOException", "EOFException", "SocketException", "ConnectException", "SocketTimeoutException", "UnknownHostException", "TimeoutException", "OSError", "ConnectionError", "TimeoutError")


def is_transient(error: Exception) -> bool:
    """STR-7: whether a failed query may go on from its checkpoint. A broken rule or a bad program stays broken."""
    said = set(re.findall(r"\b(?:[a-z]+\.)*([A-Z]\w*(?:Exception|Error))\b(?=:)", str(error)))
    return any(name in TRANSIENT for name in said)


class Progress(StreamingQueryListener):
    """STR-7: what the queries of a session did: rows of each micro-batch, and the error that ended a query, if any."""

    def __init__(self):
        self.batches, self.ended = [], []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.batches.append((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.append(event.exception)


def publish(spark: SparkSession, landing: str, store: Store, checkpoint: str, now: Callable | None = None, most_batches: int = 1000, retries: int = 3, wait_s: float = 1.0):
    """STR-1..3, STR-6, STR-7: publishes what has landed and ends; the checkpoint remembers the manifests that are done.

    After an error that may pass the query starts again from its checkpoint, ``retries`` times at most and after twice the wait each time;
    a batch that was committed before is found in the ledger. Any other error is raised at once.
    """
    moment = now or F.current_timestamp
    for attempt in range(retries + 1):
        stream = manifests_stream(spark, landing, most_batches)
        query = stream.writeStream.foreachBatch(lambda rows, _: apply_batches(store, rows, moment())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException as error:
            if attempt == retries or not is_transient(error):
                raise
            time.sleep(wait_s * 2**attempt)


def first_posts(posts: DataFrame, retention: str = "30 days") -> DataFrame:
    """STR-5: a stream's posts without repeats within the retention; the merge (UPS-2) makes it exact beyond."""
    return posts.withWatermark("posted_at", retention).dropDuplicatesWithinWatermark(["unique_id"])


STATE = "normalized_url string, newest timestamp, failures int"


def late_flags(rows: DataFrame, state: DataFrame, range_: Column | None = None) -> DataFrame:
    """STR-3, STR-4: ``rows (normalized_url, seq, observed_at, success)`` with ``late`` and ``failures`` since the last success.

    ``state`` (STATE): what came before. Late rows change nothing. Both run along (key, range of arrivals), with what a key's
    earlier ranges carry on (see ``windows.earlier_max``), so a feed with very many rows is spread over tasks.
    """
    key, own = "normalized_url", Window.partitionBy("normalized_url", "_range")
    marked = windows.earlier_max(rows, [key], "seq", "observed_at", "_bar", state.select(key, F.col("newest").alias("_known")), range_)
    marked = marked.withColumn("late", F.coalesce(F.col("observed_at") < F.col("_bar"), F.lit(False)))
    counts = ~F.col("late") & ~F.col("success")
    successes = F.sum((~F.col("late") & F.col("success")).cast("int"))
    marked = marked.withColumn("_done", successes.over(own.orderBy("seq")))
    marked = marked.withColumn("_since", F.sum(counts.cast("int")).over(Window.partitionBy(key, "_range", "_done").orderBy("seq")))
    ranges = marked.groupBy(key, "_range").agg(F.max("_done").alias("_done"), F.max_by("_since", "seq").alias("_left"))
    # what is carried out of a range: its own failures, and, without a success in it, what came in
    runs = ranges.join(state.select(key, "failures"), key, "left").withColumn("_run", F.sum((F.col("_done") > 0).cast("int")).over(Window.partitionBy(key).orderBy("_range")))
    out = F.sum("_left").over(Window.partitionBy(key, "_run").orderBy("_range")) + F.when(F.col("_run") == 0, F.coalesce("failures", F.lit(0))).otherwise(0)
    before = F.lag("_out").over(Window.partitionBy(key).orderBy("_range"))
    runs = runs.withColumn("_out", out).withColumn("_in", F.coalesce(before, "failures", F.lit(0))).select(key, "_range", "_in")
    joined = marked.join(runs, [key, "_range"])
    return joined.select(key, "seq", "observed_at", "success", "late", (F.col("_since") + F.when(F.col("_done") == 0, F.col("_in")).otherwise(0)).cast("int").alias("failures"))


def next_state(flagged: DataFrame, state: DataFrame) -> DataFrame:
    """STR-4: STATE after the flagged rows: one row a key."""
    last = flagged.where("not late").groupBy("normalized_url").agg(F.max("observed_at").alias("n"), F.max_by("failures", "seq").alias("f"))
    return last.join(state, "normalized_url", "full").select("normalized_url", F.coalesce("n", "newest").alias("newest"), F.coalesce("f", "failures").alias("failures"))


def flag_late_rows(observations: DataFrame, folder: str) -> DataFrame:
    """STR-3, STR-4, STR-6: a stream's rows with their flags, run to the end of what there is and read back from ``folder``.

    A micro-batch writes its rows and the next state under its number, so a replay writes the same again.
    """
    spark, schema = observations.sparkSession, "normalized_url string, seq long, observed_at timestamp, success boolean, late boolean, failures int"

    def step(rows: DataFrame, number: int) -> None:
        state = spark.read.schema(STATE).parquet(sinks.version_path(f"{folder}/state", number)) if number else spark.createDataFrame([], STATE)
        sinks.write_version(late_flags(rows, state), f"{folder}/out", number)
        written = spark.read.schema(schema).parquet(sinks.version_path(f"{folder}/out", number))
        sinks.write_version(next_state(written, state), f"{folder}/state", number + 1)

    rows = observations.select("normalized_url", "seq", "observed_at", "success")
    rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
