"""Scans by ranges of arrivals: the same as row loops, with a hot key spread over tasks; repeats without all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkweave import schemas
from linkweave.operators import aggregates, joins, merges, windows
from linkweave.sources import providers
from linkweave.streaming import publish


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(windows, "RANGE_BITS", 4)


def observations(spark, n=600):
    """(rows as tuples, frame); two rows of three are of one feed."""
    rng = random.Random(8)
    rows = []
    for seq in range(n):
        key = "hot" if rng.random() < 0.67 else f"k{rng.randrange(9)}"
        ok = rng.random() < 0.15
        rows.append((key, seq, datetime(2026, 1, 1) + timedelta(minutes=seq + rng.randrange(-40, 5)), ok, 200 if ok else 500, None if ok else f"e{seq}", rng.choice([None, f"t{seq}"]), None, rng.choice([None, datetime(2026, 1, 2)]), rng.choice([None, f"s{seq}"])))
    schema = "normalized_url string, seq long, observed_at timestamp_ntz, success boolean, status int, error string, etag string, last_modified string, latest_entry_at timestamp_ntz, site_link string"
    return rows, spark.createDataFrame(rows, schema)


def loop(rows):
    """key -> [newest, failures, last error, etag, link], and for each row (late, failures)."""
    state, flags = {}, {}
    for key, seq, at, ok, _, error, etag, _, _, link in rows:
        s = state.setdefault(key, [None, 0, None, None, None])
        late = s[0] is not None and at < s[0]
        if not late:
            s[0], s[1], s[2] = at, 0 if ok else s[1] + 1, error
            if ok:
                s[3], s[4] = etag, link or s[4]
        flags[seq] = (late, s[1])
    return state, flags


def test_folds_of_many_ranges_equal_row_loops(spark, small_ranges):
    rows, frame = observations(spark)
    state, flags = loop(rows)
    health = spark.createDataFrame([], schemas.HEALTH)
    for part in (frame.where("seq < 250"), frame.where("seq >= 250")):
        health = merges.fold_health(health, part)
    got = {r.normalized_url: [r.last_fetched_at, r.consecutive_failures, r.last_error, r.etag, r.site_link] for r in health.collect()}
    assert got == state
    kept = {r.seq for r in windows.not_late(frame, "normalized_url", "seq", "observed_at").collect()}
    assert kept == {seq for seq, (late, _) in flags.items() if not late}
    plain = spark.createDataFrame([(k, s, a.replace(), ok) for k, s, a, ok, *_ in rows], "normalized_url string, seq long, observed_at timestamp, success boolean")
    before, out = spark.createDataFrame([], publish.STATE), {}
    for part in (plain.where("seq < 250"), plain.where("seq >= 250")):
        marked = publish.late_flags(part, before)
        out |= {r.seq: (r.late, r.failures) for r in marked.collect()}
        before = publish.next_state(marked, before)
    assert out == flags


def test_a_hot_key_is_spread_over_tasks(spark, small_ranges):
    _, frame = observations(spark)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "false")
        scanned = windows.earlier_max(frame, ["normalized_url"], "seq", "observed_at", "bar").where("normalized_url = 'hot'")
        shares = [r["count"] for r in scanned.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(name, before)
    assert len(shares) > 2 and max(shares) < 0.6 * sum(shares)


def test_failures_since_the_last_success(spark, small_ranges):
    rows, frame = observations(spark)
    want = {}
    for key, _, _, ok, *_ in rows:
        n, some = want.get(key, (0, False))
        want[key] = (0, True) if ok else (n + 1, some)
    got = {r.normalized_url: (r.failures, r.any_success) for r in windows.failure_run(frame, "normalized_url", "seq", "success").collect()}
    assert got == want


def test_newest_of_equal_times_is_the_first_arrival(spark):
    rows = [("k", (2, 1), 5, "b"), ("k", (1, 9), 5, "a"), ("k", (0, 0), 4, "old"), ("l", (3, 0), 1, None)]
    frame = spark.createDataFrame(rows, "key string, seq struct<a:int,b:int>, observed_at int, cursor string")
    current = spark.createDataFrame([("k", 5, "same"), ("m", 1, "m")], "key string, observed_at int, cursor string")
    table = lambda now: {r.key: r.cursor for r in merges.strictly_newer(now, frame, ["key"], ["cursor"]).collect()}
    assert table(current.limit(0)) == {"k": "a", "l": None} and table(current) == {"k": "same", "l": None, "m": "m"}


def test_repeats_of_a_site_that_shares_its_navigation(spark):
    rng = random.Random(2)
    nav = [f"nav{i}" for i in range(7)]
    feeds = []
    for i in range(120):
        links = rng.sample(nav, rng.randrange(0, 6)) + [f"own{rng.randrange(60)}" for _ in range(rng.randrange(0, 4))]
        feeds.append((f"f{i}", i, "site" if i % 5 else "other", "active", f"key{rng.randrange(200)}", rng.choice(["", f"l{i % 40}"]), rng.choice(["", "News"]), links[:10], [rng.choice("abcdef") for _ in range(3)]))
    frame = spark.createDataFrame(feeds, "id string, seq int, site string, status string, feed_key string, feed_link string, title string, links array<string>, titles array<string>")
    want = {}
    for c in feeds:
        for e in feeds:
            if c[0] != e[0] and c[2] == e[2]:
                rules = [c[4] == e[4], c[5] != "" and c[5] == e[5], bool(c[7] and e[7]) and c[7][0] == e[7][0], len({*c[7]} & {*e[7]}) >= 3, c[6] != "" and c[6] == e[6] and len({*c[8]} & {*e[8]}) >= 2]
                if any(rules):
                    want[c[0]] = (e[0], joins.REASONS[rules.index(True)])
                    break
    got = {r.id: (r.duplicate_of, r.reason) for r in joins.content_duplicates(frame.drop("seq"), frame).collect()}
    assert got == want


def test_ids_and_embeds(spark):
    ids = [("a", 1, "7"), ("a", 2, " 12 "), ("a", 3, "-90"), ("b", 1, "3"), ("b", 2, "1.5"), ("c", 1, "9" * 40), ("c", 2, "1" + "0" * 40), ("d", 1, "-2"), ("d", 2, "-10"), ("e", 1, "5"), ("e", 2, "1e5"), ("f", 1, None), ("g", 1, "1_0"), ("g", 2, "9")]
    frame = spark.createDataFrame(ids, "k string, n int, id string")
    assert {r.k: r.highest for r in aggregates.highest_id(frame, "k", "id", "n").collect()} == {"a": " 12 ", "b": "3", "c": "1" + "0" * 40, "d": "-2", "e": "5", "g": "1_0"}
    embeds = ['{"a":[{"uri":"http://2","z":{"uri":"http://3"}}],"uri":"http://1\\u0041"}', "[[1,{\"uri\":5}],{\"uri\":\"ftp://x\"}]", "not json uri", None, "[" * 100_000 + '"uri"', '"uri"']
    frame = spark.createDataFrame([(i, e) for i, e in enumerate(embeds)], "i int, e string")
    got = dict(frame.select("i", providers.embed_links(F.col("e"))).collect())
    assert got == {0: ["http://1A", "http://2", "http://3"], 1: [], 2: [], 3: [], 4: [], 5: []}


def test_deep_pages_are_read_from_their_range(spark, tmp_path):
    # a third of all posts have one time
    rows = spark.range(9_000).select(F.format_string("%05d", (F.col("id") * 7919) % 9_000).alias("unique_id"), F.when(F.col("id") % 3 == 0, 500_000).otherwise(F.col("id") * 60).cast("timestamp").alias("posted_at"))
    rows.write.parquet(str(tmp_path / "posts"))
    posts = spark.read.parquet(str(tmp_path / "posts"))
    windows.page_directory(posts, 32).write.parquet(str(tmp_path / "directory"))
    directory = spark.read.parquet(str(tmp_path / "directory"))
    sizes = [r["rows"] for r in directory.collect()]
    assert sum(sizes) == 9_000 and max(sizes) < 1_000
    for number, size in ((1, 50), (61, 50), (90, 50), (180, 50), (181, 50), (3, 2_000), (5, 2_000)):
        want = windows.page(posts, number, size, F.desc("posted_at"), F.desc("unique_id")).collect()
        assert windows.directory_page(posts, directory, number, size).collect() == want
    plan = windows.directory_page(posts, directory, 170, 50)._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert "GreaterThanOrEqual(posted_at" in plan and "LessThanOrEqual(" in plan  # the plan's text is cut
    assert windows.directory_page(posts.limit(0), windows.page_directory(posts.limit(0), 4), 1, 50).count() == 0
    with pytest.raises(ValueError):
        windows.directory_page(posts, directory, 0, 50)
