"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped edges.

A document's set holds its distinct shingles of five words (A-Z lower-cased; fewer words: the whole sequence is one
shingle; no words: empty, linked with nothing). Two sets are linked when 100 * |intersection| >= 75 * |union|.

1. One hash per shingle; its top bits choose one of ``BINS`` bins, each bin keeps its least hash, and an empty bin
   borrows from a bin drawn at random for it (densification). ``ROWS`` bins make a band, a band's value a bucket.
2. Documents of equal sets are one class, held by its smallest doc_id, so copies are never paired.
3. The class that meets most others in its buckets is the centre of each, joined with the others of the bucket: edges
   grow with the members, not with their square. An edge counts only when the full sets confirm it.
4. In buckets whose members are in several components by then, a link may be left between members of two. What two sets
   share lies in the centre of the bucket, or in shingles outside of it that a second class has (a count-min sketch
   overestimates them, never under). Pairs that this bound allows are confirmed like the stars; the rest can't be links.
   A large bucket is dealt in blocks of ``PAIR_BLOCK`` members for this, two blocks a task, so no task has all of it.

So no pair that shares a bucket is lost; a pair at similarity 0.75 shares none with a probability of about 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import materialise, ship
from .sketch import sketch as count_min
from .text import Words, join_hashes, mix, slices

WIDTH = 5
BINS, ROWS = 128, 4
SIMILAR, OUT_OF = 75, 100
PAIR_BLOCK = 512
_DRAWS = np.array([np.random.default_rng(1000 + b).permutation(BINS) for b in range(BINS)])


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    grams = words.grams(hashes, width)
    out = []
    for at, to in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if to - at >= width:
            out.append(np.unique(grams[at : to - width + 1]))
        elif to > at:
            whole = hashes[at : at + 1] + np.uint64(to - at)
            for i in range(at + 1, to):
                whole = join_hashes(whole, hashes[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Densified bins, a row for each set; rows of empty sets mean nothing."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    edges = np.arange(BINS, dtype=np.uint64) << shift
    out = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            value = s[np.minimum(at, len(s) - 1)]
            filled[i] = (at < len(s)) & (value >> shift == np.arange(BINS, dtype=np.uint64))
            out[i] = np.where(filled[i], value, 0)
    row, column = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for attempt in range(BINS):
        if not len(row):
            break
        drawn = _DRAWS[column, attempt]
        found = filled[row, drawn]
        out[row[found], column[found]] = out[row[found], drawn[found]]
        row, column = row[~found], column[~found]
    return out


def band_values(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit value for each band of ``rows`` bins, different between bands."""
    bands = signature.reshape(len(signature), BINS // rows, rows)
    value = np.broadcast_to(mix(np.arange(BINS // rows, dtype=np.uint64) + np.uint64(rows * 1000)), bands.shape[:2])
    for i in range(rows):
        value = join_hashes(value, bands[:, :, i])
    return value


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(part.column("text"))
            signature = signatures(sets)
            values = band_values(signature, ROWS).astype("<u8").view("<i8")
            sizes = [len(s) for s in sets]
            key = [[int(mix(s ^ np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for c in (0x51, 0xA7)]
            bands = [values[i] if n else values[i, :0] for i, n in enumerate(sizes)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("digest"), pa.array(sizes, pa.int64()), pa.array(key[0], pa.int64()), pa.array(key[1], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "digest", "n_shingles", "k1", "k2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common, linked = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
        left, right = batch.column("left_set"), batch.column("right_set")
        for i in range(batch.num_rows):
            a, b = np.frombuffer(left[i].as_buffer(), "<u8"), np.frombuffer(right[i].as_buffer(), "<u8")
            at = np.searchsorted(b, a)
            common[i] = np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)
            linked[i] = OUT_OF * common[i] >= SIMILAR * (len(a) + len(b) - common[i])
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(common), pa.array(linked)], ["u", "v", "common", "linked"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v, common, linked`` of pairs: the size of the intersection of the full sets, and whether it suffices."""
    left = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("right_set"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "left_set", "right_set").mapInArrow(_common, "u long, v long, common long, linked boolean")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text, ...)``.

    Null text: empty. Repeated rows give a row each. Of rows with one doc_id and different texts, the text with the least digest is
    compared with similar ones; the others are linked with equal sets alone. A null doc_id is its own class with a null component
    and is kept. Texts of any length are taken whole. An empty table gives no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    sketch = materialise(docs.mapInArrow(_sketches, "doc_id long, digest long, n_shingles long, k1 long, k2 long, bands array<long>"))
    classes = sketch.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    ends = classes.select(F.col("rep").alias("doc_id"), "k1", "k2", "n_shingles")
    one = sketch.select("doc_id", "digest", "k1", "k2", "n_shingles").join(ends, ["doc_id", "k1", "k2", "n_shingles"], "left_semi").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    held = sketch.join(one, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"])
    members = held.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(members.join(sizes, "bucket"))
    weight = members.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    centres = members.join(weight, "doc_id").groupBy("bucket").agg(F.max(F.struct("weight", -F.col("doc_id"), "n")).alias("c")).select("bucket", (-F.col("c.col2")).alias("centre"), F.col("c.n").alias("m"))
    wanted = one.join(weight.select("doc_id"), "doc_id")
    sets = materialise(docs.join(wanted, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets, "doc_id long, shingles binary"))

    stars = members.join(centres, "bucket").where(f"doc_id <> centre and {OUT_OF} * least(m, n) >= {SIMILAR} * greatest(m, n)")
    stars = stars.select(F.least("doc_id", "centre").alias("u"), F.greatest("doc_id", "centre").alias("v")).distinct()
    stars = materialise(compared(stars, sets))
    found = components(stars.where("linked"))

    named = members.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    left = _several(named.join(centres, "bucket").where("doc_id <> centre").select("bucket", "doc_id", "n", "component", "centre"))
    left = left.withColumns({"u": F.least("doc_id", "centre"), "v": F.greatest("doc_id", "centre")}).join(stars.drop("linked"), ["u", "v"], "left").drop("u", "v")
    links = components(_renamed(compared(_possible_pairs(materialise(left), sets), sets).where("linked"), found))
    found = found.join(links.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left").select("node", F.coalesce("joined", "component").alias("component")).unionByName(
        links.join(found, links.node == found.node, "left_anti").select("node", "component")
    )

    label = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    return sketch.join(label, ["k1", "k2", "n_shingles"], "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _several(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component."""
    apart = members.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("bucket")
    return members.join(apart, "bucket", "left_semi")


def _renamed(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges between the components of their ends."""
    for end in ("u", "v"):
        edges = edges.join(found.select(F.col("node").alias(end), F.col("component").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    return edges


def _possible_pairs(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a bucket and two components whose shared shingles may suffice.

    ``left``: ``bucket, doc_id, n, component, centre, common`` (with the centre, null if not compared).
    """
    wanted = sets.join(left.select("doc_id").union(left.select("centre")).distinct(), "doc_id", "left_semi")
    shingles = wanted.agg(F.sum(F.octet_length("shingles")) / 8).first()[0] or 0
    repeated = sets.sparkSession.sparkContext.broadcast(count_min(wanted.select("shingles"), int(shingles), _shingles))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [int(np.count_nonzero(repeated.value.repeated(np.frombuffer(s.as_buffer(), "<u8").astype(np.uint64)))) for s in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(most, pa.int64())], ["doc_id", "shared"])

    counts = wanted.mapInArrow(count, "doc_id long, shared long")
    able = left.join(counts, "doc_id").where(f"{OUT_OF} * shared >= {SIMILAR} * n")
    # what two sets share lies in the centre, or in what each shares with others outside of it
    able = materialise(_several(able).select("bucket", "doc_id", "n", "component", F.coalesce("common", "shared").alias("inside"), F.when(F.col("common").isNull(), F.col("shared")).otherwise(F.col("shared") - F.col("common")).alias("outside"), "shared"))
    able = able.join(able.groupBy("doc_id").agg(F.collect_set("bucket").alias("buckets")), "doc_id")  # a pair comes once, in the least bucket it shares
    blocks = F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("blocks")
    able = able.join(able.groupBy("bucket").agg(blocks), "bucket").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # each two blocks of a bucket meet once: a member of the lower block with all blocks from its own on
    lower = able.withColumn("low", F.col("block")).withColumn("high", F.explode(F.sequence("block", F.col("blocks") - 1)))
    upper = able.select("bucket", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("low"), F.col("block").alias("high"), *(F.col(c).alias(f"{c}_") for c in ("doc_id", "n", "component", "inside", "outside", "shared", "buckets")))
    most = "least(least(shared, shared_), least(inside, inside_) + least(outside, outside_))"
    fits = f"{OUT_OF} * least(n, n_) >= {SIMILAR} * greatest(n, n_) and {SIMILAR + OUT_OF} * {most} >= {SIMILAR} * (n + n_)"
    pairs = lower.join(upper, ["bucket", "low", "high"]).where(f"(low < high or doc_id < doc_id_) and component <> component_ and {fits} and bucket = array_min(array_intersect(buckets, buckets_))")
    return pairs.select(F.least("doc_id", "doc_id_").alias("u"), F.greatest("doc_id", "doc_id_").alias("v"))


def _shingles(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for s in batch.column("shingles"):
        yield np.frombuffer(s.as_buffer(), "<u8").astype(np.uint64)


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM t),
g AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM w),
s AS (SELECT DISTINCT doc_id, shingle FROM g WHERE i <= greatest(n - 4, 1)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN link ON r = x)
SELECT doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
"""
