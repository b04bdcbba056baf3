"""Documents to training tokens: quality, near-duplicates, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; ``run`` writes every stage as
Parquet in the shared folder and reads it again for the next. All stages but the last return the columns of documents;
further columns, whatever their names, are dropped. An empty table gives an empty table in every stage. Texts are taken
whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import bpe, mixing, near_dedup, quality, substring_dedup
from linkweave.llm.session import discard, materialise, new_path, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, trained on this stage's labelled rows, scores below the threshold.

    Null and empty texts have the score of a text without words. Repeated rows are kept or dropped together; without labels
    nothing is learnt and every row has the same score, above the threshold.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest doc_id, of each group of near copies.

    Null, empty and wordless texts are linked with nothing and stay, as do rows without a doc_id. Repeated rows of a doc_id that is
    kept stay too.
    """
    dropped = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of repeated windows; a document that had words and keeps none goes.

    What loses nothing, null and empty texts too, keeps its text as it is; else the kept words are joined by one space. Rows without
    a doc_id lose nothing, and rows of one doc_id don't repeat each other.
    """
    kept = substring_dedup.remove_repeats(docs).where("n_words > n_removed or n_removed = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix draws it, dealt to shards and shuffled within.

    A null source is a source of its own. Texts without words have size 0 and come as often as their source's documents do. Rows equal
    in doc_id and text are drawn together or not at all.
    """
    return mixing.mix(docs).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each text, and a digest of what they decode to.

    Null and empty texts have no ids and decode to the empty text. Every row gives a row.
    """
    tokens = bpe.encode(docs.select("doc_id", "lang", "source", "text"), decoded="decoded")
    return tokens.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenise),
]
#: Trees, MinHash and BPE are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), False
    for _, stage in STAGES:
        path = new_path(spark)
        with scratch(spark):  # the stage's own tables go when its rows are written
            kept = materialise(stage(spark, docs, sf_dir), path)
        if written:
            discard(docs)
        docs, written = kept, True
    return docs
