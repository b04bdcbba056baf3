"""Plain lists: seeds, reviewed feeds, free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.windows import first_wins


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: ``seq, entry``: trimmed lines without blanks and comments."""
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r")).alias("seq"), urls.strip("value").alias("entry"))
    return entries(lines)


def entries(lines: DataFrame) -> DataFrame:
    return lines.where((F.col("entry") != "") & ~F.startswith("entry", F.lit("#")))


def feed_pairs(listed: DataFrame) -> DataFrame:
    """SRC-9, SRC-12: ``seq, normalized_url, feed_url`` of usable entries, the first of each key."""
    cleaned = listed.select("seq", urls.clean_candidate_url("entry").alias("feed_url")).where("feed_url <> ''")
    return first_wins(cleaned.withColumn("normalized_url", urls.normalize_feed_url("feed_url")), "normalized_url", "seq").select("seq", "normalized_url", "feed_url")


def subreddit_pairs(listed: DataFrame) -> DataFrame:
    """SRC-10: ``seq, normalized_name, name``, the first of each key."""
    named = listed.select("seq", urls.clean_subreddit_name("entry").alias("name")).where("name <> ''")
    return first_wins(named.withColumn("normalized_name", F.lower("name")), "normalized_name", "seq").select("seq", "normalized_name", "name")


def subreddit_seed(spark: SparkSession, path: str | None, inline: list[str]) -> DataFrame:
    """SRC-10: the seed file, else the list given."""
    if path:
        return subreddit_pairs(read_list(spark, path))
    return subreddit_pairs(entries(spark.createDataFrame(list(enumerate(inline)), "seq long, entry string")))


def urls_in_text(texts: DataFrame, seq: str, text: Column) -> DataFrame:
    """SRC-13: candidate URLs of free texts, cleaned, the first of each feed key."""
    found = texts.select(F.col(seq).alias("_s"), F.posexplode(urls.extract_urls(text)).alias("_p", "entry"))
    return feed_pairs(found.select(F.struct("_s", "_p").alias("seq"), "entry"))
