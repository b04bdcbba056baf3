"""Batches: one directory each with a manifest and a file of JSON lines for each kind of record."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.times import BATCH_ID
from ..operators import merges

BATCH_OF_PATH = r"/(\d{8}T\d{12}Z-[0-9a-f]{8})/[^/]*$"


def records(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """SRC-1..5: ``batch_id, file_name, line, value, record``: every line with its parsed record, null if it isn't JSON.

    ``line`` orders the lines of a file: the byte where its split begins and the row within. Folders that aren't batches
    are ignored (SRC-7).
    """
    name, schema = schemas.KINDS[kind]
    lines = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", "true").text(root)
    rows = lines.select(
        F.regexp_extract("_metadata.file_path", BATCH_OF_PATH, 1).alias("batch_id"),
        F.col("_metadata.file_name").alias("file_name"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line"),
        "value",
    )
    return rows.where("batch_id <> ''").withColumn("record", F.from_json("value", schema, {"mode": "PERMISSIVE"}))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """SRC-6: one row for each manifest, with the directory's ``dir_batch_id``."""
    m = spark.read.schema(schemas.MANIFEST).option("pathGlobFilter", "manifest.json").option("recursiveFileLookup", "true").json(root, multiLine=True)
    return m.withColumn("dir_batch_id", F.regexp_extract("_metadata.file_path", BATCH_OF_PATH, 1)).where("dir_batch_id <> ''")


def manifest_files(manifests_: DataFrame) -> DataFrame:
    """SRC-6: ``batch_id`` and the columns of each declared file."""
    return manifests_.select("batch_id", F.explode("files").alias("f")).select("batch_id", "f.*")


def snapshot_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """SRC-4, SRC-5: lines of a follows snapshot with the ``scope`` and ``observed_at`` of their manifest entry."""
    entry = files.select("batch_id", F.col("name").alias("file_name"), "scope", "observed_at")
    return rows.join(F.broadcast(entry), ["batch_id", "file_name"])  # a row a file


def outstanding(manifests_: DataFrame, ledger: DataFrame) -> DataFrame:
    """SRC-7, UPS-1: batches that aren't in the ledger, by id (which is their order of arrival); other names are ignored."""
    return merges.outstanding(manifests_.where(F.col("batch_id").rlike(BATCH_ID)), ledger).orderBy("batch_id")


NOT_RECORDS = ("manifest.json", "failure.json")


def listed_files(spark: SparkSession, folders: tuple[str, ...]) -> tuple[list[str], int]:
    """Paths of the files without a byte, which a scan leaves out, and the size of the largest file."""
    empty, largest = [], 0
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while found.hasNext():
            status = found.next()
            largest = max(largest, status.getLen())
            if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
                empty.append(status.getPath().toString())
    return empty, largest


def _digests(lines: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, sha256, lines, blank_line`` of files whose lines (``path, size, value, blank``) come in order, file by file.

    A value ends in a line feed; a batch's values lie one after the other and are digested at once.
    """
    path, size, digest, read, count, blank = None, 0, None, 0, 0, None

    def ended() -> Iterator[pa.RecordBatch]:
        if path is not None:
            if read < size:  # the last line has a line feed too
                digest.update(b"\n")
            yield pa.RecordBatch.from_pydict({"path": [path], "sha256": [digest.hexdigest()], "lines": pa.array([count], pa.int64()), "blank_line": pa.array([blank], pa.int64())})

    for batch in lines:
        paths = pc.run_end_encode(batch.column("path"))
        starts = [0, *paths.run_ends.to_pylist()]
        for own, start, end in zip(paths.values.to_pylist(), starts, starts[1:], strict=False):
            if own != path:
                yield from ended()
                path, size, digest, read, count, blank = own, batch.column("size")[start].as_py(), hashlib.sha256(), 0, 0, None
            values = batch.column("value").slice(start, end - start)
            ends = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_binary(values.type) else np.int32)[values.offset : values.offset + len(values) + 1]
            text = memoryview(values.buffers()[2])[ends[0] : ends[-1]]
            if count:
                digest.update(b"\n")
                read += 1
            digest.update(text[:-1])
            read += len(text) - 1
            if blank is None:
                at = pc.index(batch.column("blank").slice(start, end - start), True).as_py()
                blank = count + at + 1 if at >= 0 else None
            count += end - start
    yield from ended()


def file_digests(spark: SparkSession, *folders: str) -> DataFrame:
    """``batch_id, name, sha256, lines, blank_line`` of the record files that are there (VAL-3); ``blank_line``: the first one's number.

    A digest is of a file from its begin to its end, so a file is digested where it is read, by one task, as a stream: files of any size take no
    memory and no shuffle. No file is split for that; this is a setting of a session of its own.
    """
    empty, largest = listed_files(spark, folders)
    whole = spark.newSession()
    for name, set_ in spark.conf.getAll.items():  # access to file systems too
        if whole.conf.isModifiable(name) or not name.startswith("spark."):
            whole.conf.set(name, set_)
    whole.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 60))
    whole.conf.set("spark.sql.files.openCostInBytes", str(max(largest, 4 << 20)))  # a split is as large as that at least
    lines = whole.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(list(folders))
    value = F.concat("value", F.lit("\n")).cast("binary")
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), value.alias("value"), (F.ltrim("value", F.lit(" \t\r\x0b\x0c")) == "").alias("blank"))
    named = lambda df: df.withColumns({"batch_id": F.regexp_extract("path", BATCH_OF_PATH, 1), "name": F.element_at(F.split("path", "/"), -1)}).where(F.col("batch_id") != "").where(~F.col("name").isin(*NOT_RECORDS))
    schema = "path string, sha256 string, lines long, blank_line long"
    digests = rows.mapInArrow(_digests, schema).collect()  # a row a file
    found = spark.createDataFrame([tuple(r) for r in digests], schema)
    none = spark.createDataFrame([(p,) for p in empty], "path string").select("path", F.sha2(F.lit(b""), 256).alias("sha256"), F.lit(0).cast("long").alias("lines"), F.lit(None).cast("long").alias("blank_line"))
    return named(found.unionByName(none)).select("batch_id", "name", "sha256", "lines", "blank_line")


def line_numbers(rows: DataFrame) -> DataFrame:
    """``batch_id, file_name, block, first, before``: of each split of a file its first ``row`` and the lines before it (VAL-3).

    ``rows``: ``batch_id, file_name, line``. A line's number is ``before + row - first + 1``; a row for each split is all that is ordered.
    """
    splits = rows.groupBy("batch_id", "file_name", F.col("line.block").alias("block")).agg(F.min("line.row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("batch_id", "file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("batch_id", "file_name", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
