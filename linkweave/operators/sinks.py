"""Sinks: batches, exports, snapshots and table versions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import labels
from .windows import limited


def json_lines(records: DataFrame) -> DataFrame:
    """SNK-1: ``value``: a JSON line for each record, keys in alphabetical order and nulls written, the same each time."""
    return records.select(F.to_json(F.struct(*(F.col(c) for c in sorted(records.columns))), {"ignoreNullFields": "false"}).alias("value"))


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, so a file gets its name wherever the folder is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text, under its name only when it is whole."""
    fs, where = _files(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{where.getParent()}/_{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, where):
        raise FileExistsError(path)


def at_once(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """The results of jobs that don't wait for each other, in their order: each may be one task's writing. The first error is raised."""
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def write_file(lines: DataFrame, path: str) -> None:
    """One text file of that name, which one task writes: for readers that want one (see ``write_lines``).

    The lines are made by all tasks, and keep their order by a number that they get there.
    """
    spark = lines.sparkSession
    fs, where = _files(spark, path)
    draft = f"{where.getParent()}/_{uuid.uuid4().hex}"
    (line,) = lines.columns
    lines.select(line, F.monotonically_increasing_id().alias("_place")).repartition(1).sortWithinPartitions("_place").select(line).write.text(draft)
    parts = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{draft}/part-*"))
    if len(parts):
        fs.rename(parts[0].getPath(), where)
    else:
        fs.create(where).close()
    fs.delete(_files(spark, draft)[1], True)


def file_name(kind: str, scope: str | None = None) -> str:
    return schemas.KINDS[kind][0].replace("*", scope or "")


def write_batch(spark: SparkSession, root: str, batch_id: str, kinds: dict[str, DataFrame], snapshots: list[tuple], created_at: str, **about: str | None) -> str | None:
    """SNK-1, SNK-2: a batch folder, as of ``batch_files``, with its manifest."""
    return land(spark, batch_files(spark, root, batch_id, kinds, snapshots, created_at, **about))


def land(spark: SparkSession, batch: tuple[str, str] | None) -> str | None:
    """SNK-1: writes the manifest of ``batch_files``. Batches arrive in the order in which they land, so this is done one by one, in order of id."""
    if batch is None:
        return None
    folder, manifest = batch
    _write_text(spark, manifest, f"{folder}/manifest.json")
    return folder


def batch_files(spark: SparkSession, root: str, batch_id: str, kinds: dict[str, DataFrame], snapshots: list[tuple], created_at: str, **about: str | None) -> tuple[str, str] | None:
    """SNK-1, SNK-2: a batch folder: one file for each kind with records and one for each snapshot; gives it and the manifest's text.

    ``kinds``: kind -> records, in order of arrival. ``snapshots``: (kind, scope or None, observed_at, records); an empty one is
    content, an empty kind isn't. A cycle without content writes nothing and gives None. Until the manifest is there, the
    batch doesn't exist for a reader. A file holds the records of one cycle and is written by one task, row by row, so it may be of any size.
    """
    from ..sources.batches import file_digests

    folder = f"{root}/{batch_id}"
    files = [(kind, None, None, rows) for kind, rows in kinds.items()] + snapshots
    at_once(spark, *(lambda rows=rows, name=file_name(kind, scope): write_file(json_lines(rows), f"{folder}/{name}") for kind, scope, _, rows in files))
    there = {r["name"]: r for r in file_digests(spark, folder).collect()} if files else {}
    for kind in [k for k in kinds if there[file_name(k)]["lines"] == 0]:
        fs, where = _files(spark, f"{folder}/{file_name(kind)}")
        fs.delete(where, False)
        files = [f for f in files if f[0] != kind]
    if not files:
        fs, where = _files(spark, folder)
        fs.delete(where, True)
        return None
    entries = []
    for kind, scope, observed_at, _ in sorted(files, key=lambda f: (f[0], f[1] or "")):
        found = there[file_name(kind, scope)]
        entries.append({"name": found["name"], "kind": kind, "record_count": found["lines"], "sha256": found["sha256"], "scope": scope, "observed_at": observed_at})
    manifest = {"contract_version": schemas.CONTRACT_VERSION, "batch_id": batch_id, "created_at": created_at, "collector_version": "1", "collector_commit": None, "catalog_revision": None, **about, "files": entries}
    return folder, json.dumps(manifest, sort_keys=True)


def manifest_entries(present: DataFrame) -> DataFrame:
    """SNK-1: what the manifest says of the files that were written: ``batch_id, files``."""
    entry = F.struct("name", F.col("lines").alias("record_count"), "sha256")
    return present.groupBy("batch_id").agg(F.array_sort(F.collect_list(entry)).alias("files"))


def batch_content(kinds: dict[str, DataFrame], claims: DataFrame) -> DataFrame:
    """SNK-2, AGG-11: ``kind, scope, records``. A snapshot claim is content even without rows; nothing else is."""
    out = claims.select(F.col("kind"), "scope", F.lit(0).cast("long").alias("records"))
    for kind, rows in kinds.items():
        scope = F.col("scope") if "scope" in rows.columns else F.lit(None).cast("string")
        out = out.unionByName(rows.groupBy(scope.alias("scope")).agg(F.count("*").alias("records")).withColumn("kind", F.lit(kind)))
    return out.groupBy("kind", "scope").agg(F.sum("records").alias("records"))


def catalog_snapshot(feeds: DataFrame, subreddits: DataFrame, now: Column, revision: DataFrame) -> DataFrame:
    """SNK-3: the nested row that is written as the catalog."""
    f = feeds.agg(F.array_sort(F.collect_list(F.struct("normalized_url", "feed_url"))).alias("rss_feeds"))
    s = subreddits.agg(F.array_sort(F.collect_list(F.struct("normalized_name", "name"))).alias("subreddits"))
    return f.crossJoin(s).crossJoin(revision).withColumns({"catalog_version": F.lit(1), "generated_at": now})


def may_replace(new_count: int, old_count: int) -> bool:
    """SNK-3: an empty catalog never replaces one with entries."""
    return new_count > 0 or old_count == 0


def write_catalog(snapshot: DataFrame, path: str) -> None:
    """SNK-3: the row of ``catalog_snapshot`` as one JSON file, in place of an older one unless that would empty it."""
    spark = snapshot.sparkSession
    fs, where = _files(spark, path)
    entries = lambda df: sum(df.select(F.size("rss_feeds"), F.size("subreddits")).first())
    if fs.exists(where):
        old = spark.read.schema(schemas.CATALOG).json(path, multiLine=True)
        if not may_replace(entries(snapshot), entries(old)):
            raise ValueError("an empty catalog doesn't replace one with entries")
    text = snapshot.select(F.to_json(F.struct(*sorted(snapshot.columns)), {"ignoreNullFields": "false"})).first()[0]
    draft = f"{path}.{uuid.uuid4().hex}"
    _write_text(spark, text, draft)
    fs.delete(where, False)
    fs.rename(_files(spark, draft)[1], where)


def exported_links(posts: DataFrame, post_urls: DataFrame, limit: int | None = None) -> DataFrame:
    """SNK-4, JN-8: links in byte order of their lower case, the resolved one if there is one."""
    rows = post_urls.join(posts.select("unique_id"), "unique_id").select(labels.exported_link("unshortened_url", "url").alias("link"))
    return limited(rows.orderBy(F.lower("link"), "link"), limit)


def feed_snapshot(feeds: DataFrame) -> DataFrame:
    """SNK-5, RPT-8: ``section, place, normalized_url, line`` of the three sections in order: active, disabled, removed.

    Only active feeds stand without a leading #, so reading the list back (SRC-8) gives them alone. A section that has feeds begins
    with a heading (place 0) that counts them; section 0 counts all three.
    """
    status = labels.status("enabled", "deleted_at")
    section = F.when(status == "active", 1).when(status == "disabled", 2).otherwise(3)
    failed = F.concat(F.lit("  (failures="), F.coalesce("consecutive_failures", F.lit(0)).cast("string"), F.coalesce(F.concat(F.lit(" last_error="), labels.to_null("last_error")), F.lit("")), F.lit(")"))
    removed = F.concat(F.lit("  (removed "), F.coalesce(F.date_format("deleted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("unknown")), F.lit(")"))
    line = F.when(status == "active", F.col("feed_url")).otherwise(F.concat(F.lit("# "), F.col("feed_url"), F.when(status == "disabled", failed).otherwise(removed)))
    rows = feeds.select(section.alias("section"), F.lit(1).alias("place"), "normalized_url", line.alias("line"))
    heads = feeds.groupBy(section.alias("section"), status.alias("name")).agg(F.count("*").alias("n"))
    heads = heads.select("section", F.lit(0).alias("place"), F.lit("").alias("normalized_url"), F.concat(F.lit("# --- "), "name", F.lit(" ("), F.col("n").cast("string"), F.lit(") ---")).alias("line"))
    counts = [F.concat(F.lit(f"{name}="), F.count_if(status == name).cast("string")) for name in ("active", "disabled", "removed")]
    top = feeds.agg(F.concat(F.lit("# "), F.concat_ws("  ", *counts)).alias("line")).select(F.lit(0).alias("section"), F.lit(0).alias("place"), F.lit("").alias("normalized_url"), "line")
    return rows.unionByName(heads).unionByName(top).orderBy("section", "place", "normalized_url")


def write_lines(lines: DataFrame, column: str, path: str, one_file: bool = False) -> None:
    """SNK-4..6: ordered lines as text: a folder whose part files follow the order, or, if asked for, one file that one task writes."""
    rows = lines.select(column)
    if one_file:
        write_file(rows, path)
    else:
        rows.write.mode("errorifexists").text(path)


def version_path(root: str, version: int, kind: str = "v") -> str:
    return f"{root}/at={kind}{version:08d}"


def write_version(table: DataFrame, root: str, version: int, kind: str = "v", partition_by: str | list[str] | None = None) -> str:
    """SNK-8: a version of a table beside the older ones; a replay writes it again. The ledger says which versions count."""
    path = version_path(root, version, kind)
    writer = table.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def written_versions(spark: SparkSession, root: str, kind: str = "v") -> list[int]:
    """The versions of a table that are written to their end, in order."""
    fs, where = _files(spark, root)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{where}/at={kind}*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName().removeprefix(f"at={kind}")) for s in found)


def delete_version(spark: SparkSession, root: str, version: int, kind: str = "v") -> None:
    fs, where = _files(spark, version_path(root, version, kind))
    fs.delete(where, True)
