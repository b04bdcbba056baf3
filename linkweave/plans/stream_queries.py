"""Streams over the given tables, run to their end and read back from their Parquet sink."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import publish
from .registered import query
from .views import OBS_SQL, table


def work_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, a local master gets one of its own and a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/linkweave-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, sf: str) -> DataFrame:
    """STR-1: the events as a file stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")  # a pattern may name a file as well as a folder


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """STR-1, STR-6: all there is, into Parquet files; the sink's log and the checkpoint make it exactly once."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("SELECT DISTINCT user_id || '/' || event_type AS unique_id FROM events")
def str05_first_posts_stream(spark, sf):
    posts = events_stream(spark, sf).select(F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("unique_id"), F.col("ts").cast("timestamp").alias("posted_at"))
    return run_to_end(publish.first_posts(posts, "3650 days"), work_folder(spark)).select("unique_id")


@query(
    "WITH "
    + OBS_SQL
    + """, b AS (SELECT event_id, observed_at, max(observed_at) OVER (PARTITION BY normalized_url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bar FROM obs)
    SELECT event_id, coalesce(observed_at < bar, false) AS late FROM b"""
)
def str03_late_rows_stream(spark, sf):
    e = events_stream(spark, sf)
    seq = F.col("event_id") + F.when(F.col("event_id") % 5 == 0, 400).otherwise(0)
    o = e.select(F.col("user_id").cast("string").alias("normalized_url"), (seq * 1_000_000_000 + F.col("event_id")).alias("seq"), F.col("ts").cast("timestamp").alias("observed_at"), (F.col("event_type") != "error").alias("success"))
    out = publish.flag_late_rows(o, work_folder(spark))
    return out.select((F.col("seq") % 1_000_000_000).alias("event_id"), "late")
