import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkweave import schemas
from linkweave.operators import filters, joins, merges, sinks, validation, windows
from linkweave.sources import batches, lists, providers

T0 = datetime(2026, 1, 1)


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_age_limit_boundary(spark):
    posts = spark.createDataFrame([(1, datetime(2026, 1, 26, 12)), (2, datetime(2026, 1, 25)), (3, None)], "i long, posted_at timestamp_ntz")
    assert {r.i for r in filters.age_limit(posts, at("2026-04-26 12:00:00"), 3).collect()} == {1, 3}


def test_drop_hosts(spark):
    posts = spark.createDataFrame([("x", ["https://bad.example/", "https://good.example/"]), ("y", ["https://bad.example/"])], "unique_id string, urls array<string>")
    (row,) = filters.drop_hosts(posts, ["BAD"]).collect()
    assert row.urls == ["https://good.example/"] and row.unique_id not in ("x", "y")
    assert filters.drop_hosts(posts, []).count() == 2


def test_before_cursor(spark):
    rows = spark.createDataFrame([("a", 0, "n0"), ("a", 1, "last"), ("a", 2, "n2"), ("b", 0, "m0"), ("b", 1, "m1")], "k string, p int, name string")
    assert {(r.k, r.p) for r in filters.before_cursor(rows, "k", "p", F.col("name") == "last").collect()} == {("a", 0), ("b", 0), ("b", 1)}


def fold(rows, health):
    out = {k: dict(v) for k, v in health.items()}
    for key, at_, ok, status, error, etag, modified, entry, site in rows:
        h = out.get(key)
        if h and h["at"] is not None and at_ < h["at"]:
            continue
        h = out.setdefault(key, {"at": None, "ok_at": None, "status": None, "error": None, "fails": 0, "etag": None, "mod": None, "entry": None, "site": None})
        h.update(at=at_, status=status, error=None if ok else error)
        if ok:
            h.update(ok_at=at_, fails=0, etag=etag, mod=modified, entry=entry or h["entry"], site=site or h["site"])
        else:
            h["fails"] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_health_fold_matches_a_row_loop(spark, seed):
    rng = random.Random(seed)
    maybe = lambda x: x if rng.random() < 0.6 else None
    rows = []
    for i in range(600):
        ok = rng.random() < 0.5
        moment = T0 + timedelta(minutes=i // 3 + rng.choice([0, 0, 0, -30, 1]))
        rows.append((f"k{rng.randrange(40)}", moment, ok, 200 if ok else 500, None if ok else f"e{i}", maybe(f"t{i}"), maybe(f"m{i}"), maybe(moment) if ok else None, maybe(f"s{i}") if ok else None))
    cut = rng.randrange(600)
    schema = "normalized_url string, observed_at timestamp_ntz, success boolean, status int, error string, etag string, last_modified string, latest_entry_at timestamp_ntz, site_link string, seq long"
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
    table = merges.fold_health(spark.createDataFrame([], schemas.HEALTH), frame.where(f"seq < {cut}"))
    table = merges.fold_health(table, frame.where(f"seq >= {cut}"))
    got = {r.normalized_url: (r.last_fetched_at, r.last_success_at, r.last_status, r.last_error, r.consecutive_failures, r.etag, r.last_modified, r.latest_entry_at, r.site_link) for r in table.collect()}
    want = {k: (h["at"], h["ok_at"], h["status"], h["error"], h["fails"], h["etag"], h["mod"], h["entry"], h["site"]) for k, h in fold(rows, {}).items()}
    assert got == want


def test_checkpoints(spark):
    schema = "source_type string, source_key string, cursor string, observed_at timestamp_ntz, seq long"
    rows = spark.createDataFrame([("r", "k", "a", T0, 0), ("r", "k", "b", T0, 1), ("r", "k", "old", T0 - timedelta(1), 2), ("r", "k2", "c", T0, 3)], schema)
    empty = rows.limit(0).select("source_type", "source_key", "observed_at", "cursor")
    first = merges.strictly_newer(empty, rows, ["source_type", "source_key"], ["cursor"])
    assert {r.source_key: r.cursor for r in first.collect()} == {"k": "a", "k2": "c"}
    newer = rows.limit(0).union(spark.createDataFrame([("r", "k", "z", T0 + timedelta(1), 9), ("r", "k2", "no", T0, 10)], schema))
    assert {r.source_key: r.cursor for r in merges.strictly_newer(first, newer, ["source_type", "source_key"], ["cursor"]).collect()} == {"k": "z", "k2": "c"}


def test_snapshots_replace_clear_and_ignore_stale(spark):
    current = spark.createDataFrame([("a", "1", "x", T0), ("b", "2", "y", T0), ("c", "3", "z", T0)], "scope string, account_id string, acct string, synced_at timestamp_ntz")
    claims = spark.createDataFrame([("a", T0, 1), ("b", T0, 1), ("c", T0, 1)], "scope string, observed_at timestamp_ntz, record_count long")
    snaps = spark.createDataFrame([("a", T0 + timedelta(1), 2, 1, "s1"), ("b", T0 + timedelta(1), 0, 2, "s2"), ("c", T0, 1, 3, "s3")], "scope string, observed_at timestamp_ntz, record_count long, seq long, snapshot_id string")
    rows = spark.createDataFrame([("s1", "a", "7", "first", 0), ("s1", "a", "7", "last", 1), ("s1", "a", "8", "w", 2), ("s3", "c", "9", "stale", 0)], "snapshot_id string, scope string, account_id string, acct string, line long")
    followed, next_claims = merges.replace_snapshots(current, claims, snaps, rows, "account_id")
    assert {(r.scope, r.account_id, r.acct) for r in followed.collect()} == {("a", "7", "last"), ("a", "8", "w"), ("c", "3", "z")}
    assert {(r.scope, r.record_count) for r in next_claims.collect()} == {("a", 2), ("b", 0), ("c", 1)}


def test_retention_needs_months(spark):
    with pytest.raises(ValueError):
        merges.retain_posts(spark.range(1), spark.range(1), at("2026-01-01"), 0)
    with pytest.raises(ValueError):
        windows.limited(spark.range(1), -1)
    with pytest.raises(ValueError):
        windows.page(spark.range(1), 0, 10, "id")
    assert windows.clamped_page(99, 41, 20) == 3 and windows.clamped_page(-1, 0, 20) == 1


def test_candidates_against_the_catalog(spark):
    existing = spark.createDataFrame([("https://example.com/feed.xml",)], "normalized_url string")
    c = spark.createDataFrame([(0, "https://EXAMPLE.com/feed.xml"), (1, "https://new/rss"), (2, "https://new/rss#fragment")], "seq long, url string")
    assert [r.status for r in joins.classify_candidates(c, existing).orderBy("seq").collect()] == ["present", "new", "duplicate_in_input"]


def test_batch_files_round_trip(spark, tmp_path):
    batch = "20260101T000000000000Z-0123abcd"
    posts = [{"unique_id": "a", "source": "s", "source_type": "rss", "author": "", "description": "", "direct_link": "", "posted_at": "2026-01-01T00:00:00Z", "urls": ["https://x.example/"]}, {"unique_id": "b", "source": "", "source_type": "RSS", "author": "", "description": "", "direct_link": "", "posted_at": "never", "urls": []}]
    frame = spark.createDataFrame([json.dumps(p) for p in posts], "string").select(F.from_json("value", schemas.POST).alias("p")).select("p.*")
    folder = tmp_path / batch
    folder.mkdir()
    lines = [r.value for r in sinks.json_lines(frame).collect()]
    assert lines[0].startswith('{"author":"","description":""')
    (folder / "posts.ndjson").write_text("".join(x + "\n" for x in lines))
    digest = batches.file_digests(spark, str(tmp_path))
    row = digest.first()
    assert (row.batch_id, row["name"], row.lines, row.blank_line) == (batch, "posts.ndjson", 2, None)
    manifest = {"contract_version": 1, "batch_id": batch, "created_at": "2026-01-01T00:00:00Z", "collector_version": "1", "files": [{"name": "posts.ndjson", "kind": "posts", "record_count": 2, "sha256": row.sha256}]}
    (folder / "manifest.json").write_text(json.dumps(manifest, indent=1))
    m = batches.manifests(spark, str(tmp_path))
    assert validation.manifest_problems(m).count() == 0
    assert validation.batch_problems(batches.manifest_files(m), digest).count() == 0
    checked = validation.checked_records(batches.records(spark, str(tmp_path), "posts"), "posts").orderBy("line").collect()
    assert [r.errors for r in checked] == [[], ["source", "source_type", "posted_at", "urls"]]
    assert batches.outstanding(m, spark.createDataFrame([(batch,)], "batch_id string")).count() == 0


def test_lists(spark, tmp_path):
    path = tmp_path / "feeds.txt"
    path.write_text("# seeds\n\n https://A.example/x. \nhttps://a.example/x#y\nnot a url\nhttps://b.example\n")
    assert [(r.normalized_url, r.feed_url) for r in lists.feed_pairs(lists.read_list(spark, str(path))).orderBy("seq").collect()] == [("https://a.example/x", "https://A.example/x"), ("https://b.example/", "https://b.example")]
    assert [r["name"] for r in lists.subreddit_seed(spark, None, ["r/Python", "python", "# no", "scala"]).orderBy("seq").collect()] == ["Python", "scala"]


def test_mastodon_without_links_or_date(spark):
    statuses = [
        {"id": "1", "created_at": "2026-01-01T00:00:00Z", "content": "no links", "account": {"acct": "a"}},
        {"id": "2", "created_at": None, "content": "https://x.example/", "account": {"acct": "a"}},
        {"id": "3", "created_at": "2026-01-01T00:00:00Z", "content": '<a href="https://m/tags/x">t</a>', "card": {"url": "https://m/tags/y"}, "account": {"acct": "a"}},
        {"id": "4", "created_at": "2026-01-01T00:00:00Z", "content": '<p>Read <a href="https://x.example/long">x.example/lo…</a></p>', "card": {"url": "https://x.example/card"}, "account": {"acct": "a", "display_name": ""}},
    ]
    (row,) = providers.mastodon_posts(spark.createDataFrame([(json.dumps(statuses),)], "body string")).collect()
    assert row.urls == ["https://x.example/long", "https://x.example/card"] and row.author == "a"


def test_digests_of_files_in_many_splits(spark, tmp_path):
    """Files of several splits, without a last line feed, with blank lines, odd bytes and nothing in them."""
    import hashlib

    batch = "20260101T000000000000Z-0123abcd"
    folder = tmp_path / batch
    folder.mkdir()
    contents = {
        "posts.ndjson": b"".join(b'{"n": %d}\n' % i for i in range(3000)),
        "checkpoints.ndjson": b"\r\n".join(b"line %d" % i for i in range(2000)) + b"\n \t\n\nlast",
        "rss-observations.ndjson": b"\xff\xfe\n\xc3\n",
        "bluesky-follows.ndjson": b"",
        "mastodon-follows-a.ndjson": b"\n",
    }
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "2000b")
        rows = {r["name"]: r for r in batches.file_digests(spark, str(tmp_path)).collect()}
        lines = spark.read.option("lineSep", "\n").text(str(folder / "posts.ndjson"))
        assert lines.rdd.getNumPartitions() > 3
        split = batches.records(spark, str(tmp_path), "posts").select("batch_id", "file_name", "line", "value")
        at = split.withColumn("block", F.col("line.block")).join(batches.line_numbers(split), ["batch_id", "file_name", "block"])
        numbers = at.select("value", (F.col("before") + F.col("line.row") - F.col("first") + 1).alias("number")).collect()
    finally:
        spark.conf.set(name, before)
    assert {n: (r.sha256, r.lines, r.blank_line) for n, r in rows.items()} == {
        n: (hashlib.sha256(c).hexdigest(), {"posts.ndjson": 3000, "checkpoints.ndjson": 2003, "rss-observations.ndjson": 2, "bluesky-follows.ndjson": 0, "mastodon-follows-a.ndjson": 1}[n], {"checkpoints.ndjson": 2001, "mastodon-follows-a.ndjson": 1}.get(n))
        for n, c in contents.items()
    }
    assert sorted((json.loads(r.value)["n"] + 1, r.number) for r in numbers) == [(i, i) for i in range(1, 3001)]


def test_a_file_is_digested_however_it_would_be_split(spark, tmp_path):
    """Splits depend on what else is read: with these settings a file was one split in one scan and two in another, and had no digest."""
    import hashlib

    ids = [f"2026010{i}T000000000000Z-0123abcd" for i in range(1, 4)]
    for i in ids:
        (tmp_path / i).mkdir()
        (tmp_path / i / "manifest.json").write_text("{}")
        (tmp_path / i / "posts.ndjson").write_bytes(b"0123456789\n" * 60)
    (tmp_path / ids[0] / "checkpoints.ndjson").write_bytes(b"0123456789\n" * 200)
    settings = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "2"}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        rows = {(r.batch_id, r["name"]): r for r in batches.file_digests(spark, *(str(tmp_path / i) for i in ids)).collect()}
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert len(rows) == 4 and rows[ids[0], "checkpoints.ndjson"].lines == 200
    assert rows[ids[0], "checkpoints.ndjson"].sha256 == hashlib.sha256(b"0123456789\n" * 200).hexdigest()


def test_a_batch_keeps_every_kind_that_has_records(spark, tmp_path):
    batch = "20260101T000000000000Z-0123abcd"
    posts = spark.range(100).select(F.col("id").cast("string").alias("unique_id"))
    folder = sinks.write_batch(spark, str(tmp_path), batch, {"posts": posts, "checkpoints": posts.limit(0)}, [("bluesky_follows", None, "2026-01-01T00:00:00Z", posts.limit(0))], "2026-01-01T00:00:00Z")
    manifest = json.loads((tmp_path / batch / "manifest.json").read_text())
    assert folder and [(f["name"], f["record_count"]) for f in manifest["files"]] == [("bluesky-follows.ndjson", 0), ("posts.ndjson", 100)]
    assert not (tmp_path / batch / "checkpoints.ndjson").exists()


def test_a_bad_batch_is_left_out_without_a_shuffle_of_the_lines(spark):
    lines = spark.range(100).selectExpr("cast(id % 2 as string) as batch_id", "id")
    left = validation.reject(lines, spark.createDataFrame([("1", "x")], "batch_id string, problem string"))
    assert left.count() == 50
    assert "BroadcastHashJoin" in left._jdf.queryExecution().toString() and "Exchange hashpartitioning(batch_id" not in left._jdf.queryExecution().sparkPlan().toString()


def test_a_line_is_read_once_by_its_rules(spark):
    line = '{"cursor": "c", "observed_at": "2026-01-01T00:00:00Z", "source_key": "k", "source_type": "s", "source_url": null}'
    rows = spark.createDataFrame([(line,), ("{",)], "value string").withColumn("record", F.from_json("value", schemas.KINDS["checkpoints"][1]))
    checked = validation.checked_records(rows, "checkpoints").select(F.explode("errors").alias("error"))
    assert checked.where("error = 'json'").count() == 1
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") + checked._jdf.queryExecution().optimizedPlan().toString().count("parse_json(value") <= 1
