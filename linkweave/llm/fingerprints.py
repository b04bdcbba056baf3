"""Document fingerprints by I-Match: terms within a document-frequency band, hashed over randomised lexicon subsets.

Terms are words with A-Z lower-cased and without ASCII punctuation. The lexicon holds those that at least
``LEAST_SHARE`` and at most ``MOST_SHARE`` of the documents contain. A document counts once for each of its terms, so the lexicon can't have more terms than the mean
number of distinct terms divided by ``LEAST_SHARE``, however many documents there are; that bounds what is broadcast.
A term that is frequent in all is frequent in at least one part, so a first pass marks every part's frequent terms in
a bitmap of fixed size, and a second one counts exactly the terms that hit it.

A random subset holds a share of 2 ** -level of the lexicon; ``SUBSETS`` subsets are nested over the levels. A
document uses three levels, chosen by its number of band terms so that subsets hold about one, a half and a quarter of
them. Its fingerprint is the number of its lowest level, the 64-bit hash of all its sorted band terms (which finds equal
sets), and, level after level, eight hex digits for each subset: the hash of its sorted terms, or zeros where it has
none. Likeness is the share of equal hashes among the subsets of common levels that either document has terms in.

Defined cases. Null, empty or without terms: the fingerprint ``-``, like another such text (1.0) and nothing else (0.0). A text
without a term of the band, which I-Match can't tell from others: ``--`` and the hash of all its terms; like one with the same
terms (1.0) and nothing else. Repeated rows have a row and a fingerprint each. Texts of any length are taken whole; a
term counts once a text, so ties within a text don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import map_batches, ship
from .text import NOT_WORD, Words, mix, slices

LEAST_SHARE, MOST_SHARE = 0.001, 0.2
SUBSETS, LEVELS = 24, 3
SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64))
EMPTY, OUTSIDE = "-", "--"
#: Hashes of terms by subsets that are held at once.
HELD_HASHES = 1 << 20
MARKS = 1 << 24


def _terms(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct term hashes of each text."""
    words = Words(column, lower=True, separator=NOT_WORD)
    hashes = words.hashes()
    return [np.unique(hashes[a:b]) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]


def _frequent_in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of the terms that reach LEAST_SHARE of the documents of a stretch of the task's input."""

    def flush(held: list[np.ndarray], n: int) -> pa.RecordBatch:
        term, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((term[count >= LEAST_SHARE * n] % np.uint64(MARKS)).astype(np.int64))], ["cell"])

    held, docs, size = [], 0, 0
    for batch in batches:
        for part in slices(batch):
            held += _terms(part.column("text"))
            docs += part.num_rows
            size += sum(map(len, held[-part.num_rows :]))
            if size >= 1 << 23:
                yield flush(held, docs)
                held, docs, size = [], 0, 0
    if docs:
        yield flush(held, docs)


def _counts(marks):
    """Partial document counts of the marked terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(marks.value, np.uint8)
        held, size = [], 0

        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            term, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(count.astype(np.int64))], ["term", "n"])

        for batch in batches:
            for part in slices(batch):
                terms = _terms(part.column("text"))
                term = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
                cell = term % np.uint64(MARKS)
                marked = (bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1
                held.append(term[marked == 1])
                size += len(held[-1])
                if size >= 1 << 23:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms within the band."""
    ship(docs.sparkSession)
    texts = docs.select("text")
    cells = texts.mapInArrow(_frequent_in_part, "cell long")
    buckets = cells.groupBy((F.col("cell") / 32768).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.col("cell") % 32768).alias("bits"))
    bitmap = np.zeros(MARKS // 8, np.uint8)
    for row in buckets.toLocalIterator():
        bitmap[4096 * row.bucket : 4096 * (row.bucket + 1)] = np.frombuffer(row.bits, np.uint8)
    marks = texts.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    total = docs.count()
    counted = texts.mapInArrow(_counts(marks), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = counted.where((F.col("n") >= LEAST_SHARE * total) & (F.col("n") >= 2) & (F.col("n") <= max(2, MOST_SHARE * total)))
    return np.sort(kept.select("term").toArrow().column("term").to_numpy().view(np.uint64))


def _hash_of_set(terms: np.ndarray) -> str:
    rank = np.arange(len(terms), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return f"{int(mix(mix(terms + rank).sum(dtype=np.uint64)[None])[0]):016x}"


def fingerprint(terms: np.ndarray, known: np.ndarray) -> str:
    """``terms``: sorted distinct term hashes of a text; ``known``: the lexicon, sorted."""
    if not len(terms):
        return EMPTY
    at = np.minimum(np.searchsorted(known, terms), max(0, len(known) - 1))
    inside = terms[known[at] == terms] if len(known) else terms[:0]
    if not len(inside):
        return OUTSIDE + _hash_of_set(terms)
    lowest = len(inside).bit_length() - 1
    found = []
    step = max(1, HELD_HASHES // len(inside))
    for at in range(0, SUBSETS, step):
        drawn = mix(inside[None, :] ^ SEEDS[at : at + step, None])
        subset, term = np.nonzero((drawn & np.uint64((1 << lowest) - 1)) == 0)
        found.append((subset + at, inside[term], drawn[subset, term]))
    subset, term, drawn = (np.concatenate(x) for x in zip(*found, strict=True))
    out = np.zeros((LEVELS, SUBSETS), np.uint64)
    for level in range(LEVELS):
        kept = (drawn & np.uint64((1 << (lowest + level)) - 1)) == 0
        subset, term, drawn = subset[kept], term[kept], drawn[kept]
        first = np.searchsorted(subset, np.arange(SUBSETS + 1))
        rank = np.arange(len(subset)) - first[subset]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(term + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))])
        value = mix(total[first[1:]] - total[first[:-1]]) % np.uint64(0xFFFFFFFF) + np.uint64(1)
        out[level] = np.where(first[1:] > first[:-1], value, 0)
    return f"{lowest:02d}{_hash_of_set(inside)}" + out.astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    if a == b or a.startswith("-") or b.startswith("-"):
        return float(a == b)
    low_a, low_b = int(a[:2]), int(b[:2])
    low, high = max(low_a, low_b), min(low_a, low_b) + LEVELS
    if low >= high:
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(s[18:]), ">u4").reshape(LEVELS, SUBSETS)[low - l : high - l] for s, l in ((a, low_a), (b, low_b)))
    seen = (x > 0) | (y > 0)
    return float(((x == y) & seen).sum() / seen.sum()) if seen.any() else 0.0


def fingerprints(docs: DataFrame, known: np.ndarray | None = None, name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text. Other columns pass through; one of that name is replaced."""
    ship(docs.sparkSession)
    known = lexicon(docs) if known is None else known
    shared = docs.sparkSession.sparkContext.broadcast(known.tobytes())
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            for part in slices(batch):
                prints = [fingerprint(t, local) for t in _terms(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints, pa.string())], [*part.schema.names, name])

    return map_batches(docs, run, f"`{name}` string")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], followers: list[str], known: np.ndarray) -> list[list]:
    """Columns of RESULT for texts and the texts that follow them."""
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, followers, strict=True)]
    distinct = list(dict.fromkeys([*texts, *followers]))
    of = dict(zip(distinct, (fingerprint(t, known) for t in _terms(pa.array(distinct, pa.string()))), strict=True))
    own, after = [of[t] for t in texts], [of[f] for f in followers]
    new = [fingerprint(t, known) for t in _terms(pa.array(edited, pa.string()))]
    shas = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    return [ids, [len(t) for t in texts], shas, own, new, [likeness(a, b) for a, b in zip(own, new, strict=True)], [likeness(a, b) for a, b in zip(own, after, strict=True)]]


#: Ranges of rows with a null doc_id, by a hash of the text.
NULL_RANGES = 16


def in_overlapping_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """``range, copy, doc_id, h, text``: rows by descending doc_id in ranges, each closed by a copy of the next range's first row.

    So a row's follower is in its own range, and texts move once. The cuts between ranges are approximate quantiles of the ids;
    only they and the first key of each range pass through the driver. Rows without an id come last, in the order of ``h``, a
    hash of the text. Each range is a partition, sorted.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or 0.5, max(10_000, 10 * ranges)).alias("c")).first().c or []
    inner = sorted({float(c) for c in (cuts if isinstance(cuts, list) else [cuts])}) or [0.0]
    bucket = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="place", outputCol="bucket")
    docs = bucket.transform(docs.withColumn("place", F.coalesce("doc_id", F.lit(0)).cast("double")))
    of_id, of_null = len(inner) - F.col("bucket"), len(inner) + 1 + F.shiftright("h", 60) + NULL_RANGES // 2
    docs = docs.select(F.when(F.col("doc_id").isNull(), of_null).otherwise(of_id).cast("int").alias("range"), "doc_id", "h", "text")
    firsts = docs.groupBy("range").agg(F.max("doc_id").alias("first_id"), F.min("h").alias("first_h")).orderBy("range").collect()
    if not firsts:
        return docs.withColumn("copy", F.lit(False))
    dense = [(f["range"], at, (at - 1) % len(firsts), f.first_id, f.first_h) for at, f in enumerate(firsts)]
    dense = docs.sparkSession.createDataFrame(dense, "range int, own int, before int, first_id long, first_h long")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    own, copy = F.struct(F.col("own").alias("range"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("range"), F.lit(True).alias("copy"))
    placed = docs.join(F.broadcast(dense), "range").select(F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))).alias("to"), "doc_id", "h", "text")
    placed = placed.select("to.range", "to.copy", "doc_id", "h", "text").repartitionById(len(firsts), F.col("range"))
    return placed.sortWithinPartitions("copy", F.col("doc_id").desc_nulls_last(), "h", "text")


def edited_likeness(docs: DataFrame, known: np.ndarray | None = None, ranges: int | None = None) -> DataFrame:
    """RESULT for each row: its fingerprint against that of its edited text and of the next document.

    The next document has the next smaller doc_id (rows of one doc_id: by text; null doc_ids: last, by a hash of the text), the
    last row's is the first row. The edited text has the last floor(n_chars / 2) code points replaced by as many first ones of
    the next document. Other columns are ignored. ``ranges``: how many partitions the rows are dealt to, by default the
    session's number for shuffles.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((lexicon(docs) if known is None else known).tobytes())
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in RESULT.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = np.frombuffer(shared.value, np.uint64)
        ids, texts, copies = [], [], []
        for batch in batches:
            for piece in slices(batch):
                # the row before this piece waits for its follower
                ids, texts, copies = ([*old[-1:], *piece.column(c).to_pylist()] for old, c in ((ids, "doc_id"), (texts, "text"), (copies, "copy")))
                own = copies[:-1].count(False)
                if own:
                    columns = _compare(ids[:own], texts[:own], texts[1 : own + 1], local)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return in_overlapping_ranges(docs, ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))).select("doc_id", "text", "copy").mapInArrow(compare, RESULT)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
