import hashlib
import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from linkweave import schemas
from linkweave.operators import aggregates, sinks
from linkweave.sources import lists, state
from linkweave.streaming import publish as pub


def line(**fields):
    return json.dumps(dict(sorted(fields.items())))


def post(uid, source="s", **more):
    return line(**{"unique_id": uid, "source": source, "source_type": "rss", "author": "", "description": "d", "direct_link": "", "posted_at": "2026-01-01T00:00:00Z", "urls": [f"https://x.example/{uid}", "https://y.example/"]} | more)


def observation(at, ok, **more):
    return line(**{"normalized_url": "https://f/", "feed_url": "https://f/", "observed_at": at, "success": ok, "status": 200 if ok else 500, "error": None if ok else "bad", "etag": None, "last_modified": None, "latest_entry_at": None, "site_link": None} | more)


def checkpoint(cursor, at):
    return line(source_type="reddit", source_key="k", cursor=cursor, observed_at=at, source_url=None)


def manifest(folder, observed="2026-01-01T00:00:00Z", **changed):
    files = []
    for path in sorted(folder.glob("*.ndjson")):
        kind = "mastodon_follows" if path.name.startswith("mastodon") else path.stem.replace("-", "_")
        scope = path.stem.removeprefix("mastodon-follows-") if kind == "mastodon_follows" else None
        content = path.read_bytes()
        files.append({"name": path.name, "kind": kind, "record_count": content.count(b"\n"), "sha256": hashlib.sha256(content).hexdigest(), "scope": scope, "observed_at": observed if "follows" in kind else None})
    document = {"contract_version": 1, "batch_id": folder.name, "created_at": observed, "collector_version": "1", "collector_commit": None, "catalog_revision": None, "files": files} | changed
    (folder / "manifest.json").write_text(json.dumps(document))


def put(root, batch, **files):
    folder = root / batch
    folder.mkdir(parents=True, exist_ok=True)
    for name, lines in files.items():
        (folder / (name.replace("_", "-") + ".ndjson")).write_text("".join(x + "\n" for x in lines))
    return folder


def land(root, batch, observed="2026-01-01T00:00:00Z", **files):
    manifest(put(root, batch, **files), observed)


IDS = [f"20260101T00000000000{i}Z-0123abcd" for i in range(9)]


@pytest.fixture
def place(spark, tmp_path):
    """(landing folder, store, publish)."""
    landing, store = tmp_path / "landing", pub.Store(spark, str(tmp_path / "store"))
    landing.mkdir()
    return landing, store, lambda: pub.publish(spark, str(landing), store, str(tmp_path / "cp"), lambda: F.lit("2026-02-01").cast("timestamp"))


def test_publish_once_in_order_with_bad_batches(spark, place):
    landing, store, run = place
    land(landing, IDS[0], posts=[post("a", "first"), post("a", "again")], rss_observations=[observation(f"2026-01-0{i}T00:00:00Z", False) for i in (1, 2, 3)], checkpoints=[checkpoint("c1", "2026-01-02T00:00:00Z")])
    land(landing, IDS[1], posts=[post("b"), post("a", "later")], checkpoints=[checkpoint("old", "2026-01-01T00:00:00Z"), checkpoint("same", "2026-01-02T00:00:00Z")])
    land(landing, IDS[2], posts=[post("c"), "not json"])
    (landing / "foreign").mkdir()
    (landing / "foreign" / "posts.ndjson").write_text(post("z") + "\n")
    (landing / "foreign" / "manifest.json").write_text("{}")
    run()
    posts = {r.unique_id: r.source for r in store.read("posts").collect()}
    assert posts == {"a": "first", "b": "s"}
    assert store.read("post_urls").count() == 4
    health = store.read("health").first()
    assert (health.consecutive_failures, health.last_error, health.last_success_at) == (3, "bad", None)
    assert store.read("checkpoints").first().cursor == "c1"
    assert [r.batch_id for r in store.read("rejected").collect()] == [IDS[2]]
    ledger = {r.batch_id: tuple(r)[2:] for r in store.read("ledger").collect()}
    assert ledger == {IDS[0]: (6, 1, 2, 1, 0), IDS[1]: (4, 1, 2, 0, 2)}

    land(landing, IDS[3], rss_observations=[observation("2026-01-04T00:00:00Z", True, etag="e"), observation("2026-01-03T12:00:00Z", False)], checkpoints=[checkpoint("c2", "2026-01-05T00:00:00Z")])
    run()
    health = store.read("health").first()
    assert (health.consecutive_failures, health.last_error, health.etag) == (0, None, "e")
    assert store.read("checkpoints").first().cursor == "c2" and store.read("posts").count() == 2
    version = store.version()
    rows = spark.createDataFrame([(i, str(landing / i), (landing / i / "manifest.json").read_text()) for i in IDS[:4]], "batch_id string, folder string, value string")
    pub.apply_batches(store, rows, F.current_timestamp())  # a replay changes nothing
    assert store.version() == version
    before = sorted(map(str, store.read("posts").collect())), sorted(map(str, store.read("ledger").collect()))
    store.compact()
    store.compact()
    assert before == (sorted(map(str, store.read("posts").collect())), sorted(map(str, store.read("ledger").collect())))
    land(landing, IDS[4], posts=[post("a"), post("d")])
    run()
    assert {r.unique_id for r in store.read("posts").collect()} == {"a", "b", "d"} and store.read("ledger").count() == 4


def test_a_batch_waits_for_its_manifest(place):
    landing, store, run = place
    folder = put(landing, IDS[0], checkpoints=[checkpoint("c1", "2026-01-02T00:00:00Z")])
    run()
    assert store.version() == 0
    put(landing, IDS[0], posts=[post("a")])
    manifest(folder)
    run()
    assert store.read("posts").count() == 1 and store.read("checkpoints").count() == 1 and [r.record_count for r in store.read("ledger").collect()] == [2]


def test_unverified_batches_are_quarantined(place):
    landing, store, run = place
    land(landing, IDS[0], posts=[post("a")])
    (landing / IDS[0] / "posts.ndjson").write_text(post("b") + "\n")
    land(landing, IDS[1], posts=[post("a")])
    put(landing, IDS[1], checkpoints=[checkpoint("c", "2026-01-02T00:00:00Z")])
    folder = put(landing, IDS[2], posts=[post("a"), post("b")])
    manifest(folder)
    (folder / "manifest.json").write_text((folder / "manifest.json").read_text().replace('"record_count": 2', '"record_count": 3'))
    land(landing, IDS[3], posts=[post("a")], checkpoints=[checkpoint("c", "2026-01-02T00:00:00Z")])
    (landing / IDS[3] / "posts.ndjson").unlink()
    put(landing, IDS[4], posts=[post("a")])
    (landing / IDS[4] / "manifest.json").write_text("not json")
    manifest(put(landing, IDS[5], posts=[post("a")]), batch_id=IDS[6])
    land(landing, IDS[7], posts=[post("kept")])
    land(landing, IDS[8], posts=[line(unique_id="x")])
    run()
    reasons = {r.batch_id: r.reason for r in store.read("rejected").collect()}
    assert reasons.pop(IDS[4]).startswith("batch_id; ") and "posts.ndjson line 1: missing_keys" in reasons.pop(IDS[8])
    assert reasons == {IDS[0]: "posts.ndjson: checksum", IDS[1]: "checkpoints.ndjson: undeclared", IDS[2]: "posts.ndjson: record_count", IDS[3]: "posts.ndjson: missing", IDS[5]: "batch_id"}
    assert [r.unique_id for r in store.read("posts").collect()] == ["kept"]


def member(i, **more):
    return line(account_id=f"m{i}", acct=f"a{i}", display_name=None, url=None, **more)


def test_follows_are_replaced_by_newer_snapshots_alone(place):
    landing, store, run = place
    follow = lambda i: line(did=f"d{i}", handle=f"h{i}", display_name=None)
    land(landing, IDS[0], "2026-01-02T00:00:00Z", bluesky_follows=[follow(1), follow(2)], **{"mastodon_follows_x.example": [member(1), member(2)], "mastodon_follows_y.example": [member(3)]})
    land(landing, IDS[1], "2026-01-01T00:00:00Z", bluesky_follows=[follow(9)])
    run()
    shown = lambda name, key: sorted((r.scope, r[key]) for r in store.read(name).collect())
    assert shown("bluesky_follows", "did") == [("", "d1"), ("", "d2")]
    land(landing, IDS[2], "2026-01-03T00:00:00Z", bluesky_follows=[], **{"mastodon_follows_x.example": [member(2), member(4)]})
    run()
    assert shown("bluesky_follows", "did") == []
    assert shown("mastodon_follows", "account_id") == [("x.example", "m2"), ("x.example", "m4"), ("y.example", "m3")]
    claims = {(r.source_type, r.scope): (r.observed_at.day, r.record_count) for r in store.read("follows_snapshots").collect()}
    assert claims == {("bluesky", ""): (3, 0), ("mastodon", "x.example"): (3, 2), ("mastodon", "y.example"): (2, 1)}


def test_checkpoints_of_unknown_sources_are_skipped_and_counted(place):
    landing, store, run = place
    land(landing, IDS[0], checkpoints=[checkpoint("c", "2026-01-02T00:00:00Z"), checkpoint("c", "2026-01-02T00:00:00Z").replace("reddit", "later_source")], posts=[post("a")])
    run()
    assert [(r.checkpoints_applied, r.checkpoints_skipped, r.posts_inserted) for r in store.read("ledger").collect()] == [(1, 1, 1)]
    assert [r.source_type for r in store.read("checkpoints").collect()] == ["reddit"]


def test_written_batches_are_read_back(spark, place):
    landing, store, run = place
    rows = lambda *lines: spark.createDataFrame([json.loads(x) for x in lines], schemas.POST)
    assert sinks.write_batch(spark, str(landing), IDS[0], {"posts": rows(post("a")).limit(0)}, [], "2026-01-01T00:00:00Z") is None
    assert not list(landing.iterdir())
    empty = spark.createDataFrame([], schemas.BLUESKY_FOLLOW)
    sinks.write_batch(spark, str(landing), IDS[0], {"posts": rows(post("é"), post("b"))}, [("bluesky_follows", None, "2026-01-02T00:00:00Z", empty)], "2026-01-01T00:00:00Z")
    assert {p.name for p in (landing / IDS[0]).iterdir() if p.suffix != ".crc"} == {"posts.ndjson", "bluesky-follows.ndjson", "manifest.json"}
    run()
    assert {r.unique_id for r in store.read("posts").collect()} == {"é", "b"} and store.read("rejected").count() == 0
    assert [r.record_count for r in store.read("follows_snapshots").collect()] == [0]


def test_catalogs_and_lists_are_written(spark, tmp_path):
    feeds = spark.createDataFrame([("k", "u", True, None, 0, None)], "normalized_url string, feed_url string, enabled boolean, deleted_at timestamp, consecutive_failures int, last_error string")
    subs = spark.createDataFrame([("s", "S")], "normalized_name string, name string")
    revision = aggregates.catalog_revision(feeds, subs)
    path = str(tmp_path / "catalog.json")
    row = lambda f, s: sinks.catalog_snapshot(f, s, F.lit("2026-01-01"), revision)
    sinks.write_catalog(row(feeds, subs), path)
    sinks.write_catalog(row(feeds, subs.limit(0)), path)
    with pytest.raises(ValueError):
        sinks.write_catalog(row(feeds.limit(0), subs.limit(0)), path)
    catalog = state.read_catalog(spark, path)
    assert [r.normalized_url for r in state.catalog_feeds(catalog).collect()] == ["k"] and state.catalog_subreddits(catalog).count() == 0

    more = feeds.union(spark.createDataFrame([("l", "https://off", False, None, 3, "boom"), ("m", "https://gone", True, datetime(2026, 1, 2), 0, None)], feeds.schema))
    sinks.write_lines(sinks.feed_snapshot(more), "line", str(tmp_path / "feeds.txt"), one_file=True)
    text = (tmp_path / "feeds.txt").read_text().splitlines()
    assert text == ["# active=1  disabled=1  removed=1", "# --- active (1) ---", "u", "# --- disabled (1) ---", "# https://off  (failures=3 last_error=boom)", "# --- removed (1) ---", "# https://gone  (removed 2026-01-02T00:00:00Z)"]
    assert [r.entry for r in lists.read_list(spark, str(tmp_path / "feeds.txt")).collect()] == ["u"]


def test_lines_are_ordered_part_files(spark, tmp_path):
    rows = spark.range(500).select(F.format_string("%04d", "id").alias("line")).repartition(4)
    sinks.write_lines(rows.orderBy("line"), "line", str(tmp_path / "many"))
    parts = sorted(p for p in (tmp_path / "many").iterdir() if p.name.startswith("part"))
    assert "".join(p.read_text() for p in parts).split() == [f"{i:04d}" for i in range(500)]


def test_state_of_late_rows(spark, tmp_path):
    schema = "normalized_url string, seq long, observed_at timestamp, success boolean"
    rows = [("f", i, datetime(2026, 1, d), ok) for i, (d, ok) in enumerate([(2, False), (3, False), (1, True), (3, False), (4, True), (4, False), (3, True), (4, False)])]
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    want = [(False, 1), (False, 2), (True, 2), (False, 3), (False, 0), (False, 1), (True, 1), (False, 2)]
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = pub.flag_late_rows(stream(), str(tmp_path / "work"))
        got = [(r.late, r.failures) for r in out.orderBy("seq").collect()]
        assert got == want[: len(got)]
    assert len(got) == 8


def test_stream_without_repeats(spark, tmp_path):
    rows = [("a", datetime(2026, 1, 1)), ("a", datetime(2026, 1, 2)), ("b", datetime(2026, 1, 2))]
    spark.createDataFrame(rows, "unique_id string, posted_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("unique_id string, posted_at timestamp").parquet(str(tmp_path / "in"))
    query = pub.first_posts(stream).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.unique_id for r in spark.table("firsts").collect()) == ["a", "b"]


def test_version_of_an_empty_store(spark, tmp_path):
    assert pub.Store(spark, str(tmp_path / "none")).version() == 0
    with pytest.raises(KeyError):
        pub.Store(spark, str(tmp_path)).read("unknown")


def test_retention_is_a_version_without_old_months(spark, place):
    landing, store, run = place
    old = "2025-12-31T23:59:59Z"
    land(landing, IDS[0], posts=[post("old", posted_at="2025-11-05T00:00:00Z"), post("edge", posted_at=old), post("new", posted_at="2026-01-01T00:00:00Z")])
    run()
    before = store.version()
    store.retain(F.lit("2026-02-01").cast("timestamp"), 1)
    ids = lambda v=None: sorted(r.unique_id for r in store.read("posts", v).collect())
    linked = lambda v=None: sorted({r.unique_id for r in store.read("post_urls", v).collect()})
    assert ids() == linked() == ["new"] and ids(before) == linked(before) == ["edge", "new", "old"]
    assert store.read("ledger").count() == 1 and store.read("health").count() == 0
    plan = store.read("post_urls")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and ">= 2026-01" in plan
    land(landing, IDS[1], posts=[post("old", posted_at="2026-01-20T00:00:00Z")])  # gone, so it may come again
    run()
    assert ids() == ["new", "old"]
    store.compact()
    store.expire()
    assert ids() == linked() == ["new", "old"] and store.read("ledger").count() == 2
    with pytest.raises(ValueError):
        store.retain(F.current_timestamp(), 0)


def files_under(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("part-*")}


def test_only_replaced_scopes_are_written(spark, place, tmp_path):
    landing, store, run = place
    people = lambda *ids: [line(account_id=i, acct=f"a{i}", display_name=None, url=None) for i in ids]
    land(landing, IDS[0], "2026-01-01T00:00:00Z", **{"mastodon-follows-one": people("1", "2"), "mastodon-follows-two": people("3")})
    run()
    members = lambda: sorted((r.scope, r.account_id) for r in store.read("mastodon_follows").collect())
    assert members() == [("one", "1"), ("one", "2"), ("two", "3")]
    before = files_under(tmp_path / "store" / "mastodon_follows")
    land(landing, IDS[1], "2026-01-02T00:00:00Z", **{"mastodon-follows-one": []})
    land(landing, IDS[2], "2025-12-01T00:00:00Z", **{"mastodon-follows-two": people("4")})
    run()
    after = files_under(tmp_path / "store" / "mastodon_follows")
    assert members() == [("two", "3")] and all(after[f] == t for f, t in before.items())
    new = [f for f in after if f not in before]
    assert sum(spark.read.parquet(str(tmp_path / "store" / "mastodon_follows" / f)).count() for f in new) == 0
    store.compact()
    assert members() == [("two", "3")]


def test_rows_that_break_a_rule_fail_the_write(spark, place):
    _, store, _ = place
    bad = spark.createDataFrame([("", "s", "rss", "", "", "", datetime(2026, 1, 1), datetime(2026, 1, 1), "2026-01")], pub.TABLES["posts"] + ", month string")
    with pytest.raises(Exception, match="a row of posts breaks: unique_id"):
        store.write({"posts": bad, "ledger": spark.createDataFrame([], pub.TABLES["ledger"])}, 1)
    assert store.version() == 0


class Failing(pub.Store):
    errors: list = []

    def write(self, tables, version):
        super().write({n: t for n, t in tables.items() if n != "ledger"} | {"ledger": tables["ledger"]}, version) if not self.errors else None
        if self.errors:
            raise self.errors.pop()


def test_errors_that_pass_are_retried(spark, place, tmp_path):
    landing, store, _ = place
    land(landing, IDS[0], posts=[post("a")])
    failing = Failing(spark, store.root)
    run = lambda **more: pub.publish(spark, str(landing), failing, str(tmp_path / "cp"), wait_s=0.01, **more)
    seen = pub.Progress()
    spark.streams.addListener(seen)
    try:
        Failing.errors = [OSError("the store is away"), OSError("still away")]
        run()
        assert store.version() == 1 and store.read("posts").count() == 1 and store.read("ledger").count() == 1
        land(landing, IDS[1], posts=[post("b")])
        Failing.errors = [ValueError("a bug"), ValueError("not reached")]
        with pytest.raises(Exception, match="not reached"):
            run()
        assert len(Failing.errors) == 1
        Failing.errors = [OSError("away")] * 3
        with pytest.raises(Exception, match="away"):
            run(retries=2)
        Failing.errors = []
        run()
    finally:
        spark.streams.removeListener(seen)
    assert store.read("posts").count() == 2 and len(seen.ended) >= 5 and any(seen.ended) and seen.batches


def test_nothing_stays_cached(spark, place):
    landing, _, run = place
    land(landing, IDS[0], posts=[post("a")])
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    run()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_the_key_index_opens_the_buckets_of_sought_keys(spark, place):
    landing, store, run = place
    store.bucket_rows = 4
    land(landing, IDS[0], posts=[post(f"p{i}") for i in range(60)])
    run()
    store.compact()
    land(landing, IDS[1], posts=[post("p60"), post("p7")])
    run()
    assert store.read("posts").count() == 61 and sorted(r.posts_inserted for r in store.read("ledger").collect()) == [1, 60]
    sought = spark.createDataFrame([("p3",), ("p60",)], "unique_id string")
    keys, files = store.keys(store.version(), sought), F.input_file_name()
    assert {"p3", "p60"} <= {r.unique_id for r in keys.collect()} and keys.count() < 30
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", keys._jdf.queryExecution().executedPlan().toString())
    opened = keys.select(files.alias("f")).distinct().collect()
    index = spark.read.parquet(f"{store.root}/post_keys")
    assert len(opened) <= 3 < 15 == index.select("bucket").distinct().count()
    # what retention leaves out may come again, though the index still holds its key
    store.retain(F.lit("2026-03-01").cast("timestamp"), 1)
    land(landing, IDS[2], posts=[post("p3", posted_at="2026-02-20T00:00:00Z"), post("p3", "again", posted_at="2026-02-21T00:00:00Z")])
    run()
    assert [(r.unique_id, r.source) for r in store.read("posts").collect()] == [("p3", "s")]
    store.compact()
    store.expire()
    land(landing, IDS[3], posts=[post("p3", posted_at="2026-02-25T00:00:00Z"), post("p5", posted_at="2026-02-25T00:00:00Z")])
    run()
    assert sorted(r.unique_id for r in store.read("posts").collect()) == ["p3", "p5"]
    assert len(list((landing.parent / "store" / "post_keys").iterdir())) == 1


def test_the_index_of_an_empty_store(spark, place):
    landing, store, run = place
    land(landing, IDS[0], checkpoints=[checkpoint("c1", "2026-01-02T00:00:00Z")])
    run()
    store.compact()
    land(landing, IDS[1], posts=[post("a")])
    run()
    assert [r.unique_id for r in store.read("posts").collect()] == ["a"]
