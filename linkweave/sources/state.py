"""Stored state: the catalog snapshot and the collector's maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.aggregates import catalog_revision


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: the nested row of a catalog snapshot."""
    return spark.read.schema(schemas.CATALOG).json(path, multiLine=True)


def catalog_feeds(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("rss_feeds").alias("f")).select("f.*")


def catalog_subreddits(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("subreddits").alias("s")).select("s.*")


def catalog_problems(catalog: DataFrame) -> DataFrame:
    """SRC-11, VAL-5: ``problem``: wrong version, repeated keys, a revision that isn't the content's. None if valid."""
    feeds, subs = catalog_feeds(catalog), catalog_subreddits(catalog)
    repeated = lambda df, key: df.groupBy(key).count().where("count > 1").select(F.concat(F.lit("repeated "), F.col(key)).alias("problem"))
    version = catalog.where(f"catalog_version is null or catalog_version <> {schemas.CONTRACT_VERSION}").select(F.lit("version").alias("problem"))
    revision = catalog.select(F.col("revision").alias("declared")).crossJoin(catalog_revision(feeds, subs)).where("not declared <=> revision").select(F.lit("revision").alias("problem"))
    return version.union(repeated(feeds, "normalized_url")).union(repeated(subs, "normalized_name")).union(revision)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """SRC-21."""
    return spark.read.schema(schemas.STATE).json(path, multiLine=True)


def cached_validators(state: DataFrame) -> DataFrame:
    """SRC-21: ``normalized_url, etag, last_modified``."""
    return state.select(F.explode("rss_cache").alias("normalized_url", "v")).select("normalized_url", "v.*")


def cached_checkpoints(state: DataFrame) -> DataFrame:
    """SRC-21: ``source_type, source_key, cursor, observed_at, source_url``."""
    return state.select(F.explode("checkpoints").alias("source_type", "m")).select("source_type", F.explode("m").alias("source_key", "v")).select("source_type", "source_key", "v.*")
