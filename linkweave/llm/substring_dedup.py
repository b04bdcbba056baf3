"""Removal of repeated passages: windows of 50 words that also start in a document with a smaller doc_id.

Every window has an anchor: the least hash among its 35 grams of 16 words. Equal windows have equal anchors, and
neighbouring windows mostly share one, so counting runs of anchors instead of windows overestimates a window's count
with about a twentieth of the keys.

1. Each task adds its anchors to count-min sketches, which are merged (sketch.py). They overestimate: no repeated anchor
   is missed, and a fuller sketch lets more windows pass, never fewer. Its size is bounded; from about 10^8 anchors (10 GB of
   text) on it lets more and more windows through, up to all of them, eight bytes each: linear, and still whole.
2. Windows whose anchor is estimated repeated are grouped exactly, by (anchor, window hash), 128 bits together. Each task
   first settles what it can see itself, so a passage arrives once per task and not once per copy. Windows of an anchor
   that is estimated hot (a phrase of 16 words that very many documents have) are dealt by window instead of by anchor; all
   tasks share the sketch, so equal windows meet. The others stream in order of anchor and doc_id, and hold less than
   HOT runs of an anchor; a window that was seen with a smaller doc_id is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import map_batches, materialise, ship, unused
from .sketch import Sketch, sketch
from .text import Words, join_hashes, mix, slices

WINDOW, GRAM = 50, 16
#: Windows that a task holds before it hands them on.
HELD_WINDOWS = 1 << 18
#: Bytes of text for each anchor, about; this only sizes the sketch.
BYTES_PER_ANCHOR = 100


class Windows:
    """Windows of a batch: ``start`` (word within its document), ``doc`` (row), ``anchor`` and ``value`` hashes."""

    def __init__(self, column: pa.Array):
        words = Words(column)
        hashes = words.hashes()
        n = len(hashes) - WINDOW + 1
        if n <= 0:
            self.doc = self.start = np.zeros(0, np.int64)
            self.anchor = self.value = np.zeros(0, np.uint64)
            return
        doc = np.repeat(np.arange(len(words.first) - 1), words.counts())
        valid = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
        least, size = words.grams(hashes, GRAM), 1
        reach = WINDOW - GRAM + 1
        while 2 * size <= reach:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < reach:
            least = np.minimum(least[: len(least) - (reach - size)], least[reach - size :])
        self.doc = doc[valid]
        self.start = valid - words.first[self.doc]
        self.anchor = least[valid]
        self.value = words.grams(hashes, WINDOW)[valid]

    def runs(self) -> np.ndarray:
        """Where a new document or anchor begins, or windows are skipped."""
        return run_starts(self.start, self.doc, self.anchor)


def run_starts(start: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where ``start`` doesn't go on by one, or one of the other arrays changes."""
    new = np.ones(len(start), bool)
    new[1:] = start[1:] != start[:-1] + 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for part in slices(batch):
        windows = Windows(part.column("text"))
        yield windows.anchor[windows.runs()]


#: Runs of windows of a row from ``start`` on, with the hash of each; or, with ``starts``, all places of one window of a row.
#: ``digest`` tells rows of one doc_id and different texts apart.
OPEN = "key long, doc_id long, digest long, start int, windows int, hashes binary, starts binary"


def _rows(key: np.ndarray, doc: np.ndarray, digest: np.ndarray, start: np.ndarray, windows: np.ndarray, hashes: list | None = None, starts: list | None = None) -> pa.RecordBatch:
    columns = [pa.array(key.view(np.int64)), pa.array(doc, pa.int64()), pa.array(digest, pa.int64()), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))]
    columns += [pa.nulls(len(key), pa.binary()) if x is None else pa.array(x, pa.binary()) for x in (hashes, starts)]
    return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "digest", "start", "windows", "hashes", "starts"])


def _cut(values: np.ndarray, at: np.ndarray, kind: str) -> list[bytes]:
    """The bytes of ``values`` from each place of ``at`` to the next."""
    return [values[a:b].astype(kind).tobytes() for a, b in zip(at.tolist(), np.append(at[1:], len(values)).tolist(), strict=True)]


def _spans(doc: np.ndarray, digest: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts within a row: (doc, digest, first start, number of windows)."""
    order = np.lexsort((start, digest, doc))
    doc, digest, start = doc[order], digest[order], start[order]
    if len(doc):  # rows equal in both have the same windows
        one = np.ones(len(doc), bool)
        one[1:] = (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1]) | (start[1:] != start[:-1])
        doc, digest, start = doc[one], digest[one], start[one]
    at = run_starts(start, doc, digest)
    return doc[at], digest[at], start[at], np.diff(np.append(at, len(doc)))


def first_holders(anchor: np.ndarray, value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the smallest doc_id that has it, and a mask of one entry for each distinct window."""
    if not len(doc):
        return doc, np.zeros(0, bool)
    order = np.lexsort((doc, value, anchor))
    a, v = anchor[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (v[1:] != v[:-1])
    group = np.cumsum(new) - 1
    least = np.empty(len(doc), doc.dtype)
    least[order] = doc[order][np.flatnonzero(new)][group]
    one = np.zeros(len(doc), bool)
    one[order[new]] = True
    return least, one


def _candidates(shared):
    """Windows estimated repeated, by runs of one anchor (hot ones: one by one); runs without hashes are repeats already."""

    def flush(held: list[tuple], known: Sketch) -> Iterator[pa.RecordBatch]:
        anchor, value, doc, digest, start = (np.concatenate(x) for x in zip(*held, strict=True))
        least, _ = first_holders(anchor, value, doc)
        settled = doc > least
        if settled.any():
            d, h, s, n = _spans(doc[settled], digest[settled], start[settled])
            yield _rows(mix(d.astype(np.uint64)), d, h, s, n)
        anchor, value, doc, digest, start = (x[~settled] for x in (anchor, value, doc, digest, start))
        at = run_starts(start, doc, digest, anchor)
        hot = np.repeat(known.hot(anchor[at]), np.diff(np.append(at, len(doc))))
        if not hot.all():
            key, v, d, h, s = (x[~hot] for x in (anchor, value, doc, digest, start))
            at = run_starts(s, d, h, key)
            yield _rows(key[at], d[at], h[at], s[at], np.diff(np.append(at, len(d))), _cut(v, at, "<u8"))
        if hot.any():
            key, v, d, h, s = (x[hot] for x in (join_hashes(anchor, value), value, doc, digest, start))
            order = np.lexsort((s, v, key, h, d))
            key, v, d, h, s = (x[order] for x in (key, v, d, h, s))
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (v[1:] != v[:-1])
            at = np.flatnonzero(new)
            yield _rows(key[at], d[at], h[at], s[at], np.diff(np.append(at, len(d))), [x.tobytes() for x in v[at].astype("<u8")], _cut(s, at, "<i4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                windows = Windows(part.column("text"))
                at = windows.runs()
                keep = np.repeat(known.repeated(windows.anchor[at]), np.diff(np.append(at, len(windows.doc))))
                ids, digests = (part.column(c).to_numpy(zero_copy_only=False)[windows.doc[keep]] for c in ("doc_id", "digest"))
                held.append((windows.anchor[keep], windows.value[keep], ids, digests, windows.start[keep]))
                size += len(held[-1][0])
                if size >= HELD_WINDOWS:
                    yield from flush(held, known)
                    held, size = [], 0
        if size:
            yield from flush(held, known)

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs ordered by key and doc_id -> spans of windows that a smaller doc_id has. Carries one key's windows on."""
    carry = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    for batch in batches:
        doc, digest = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "digest"))
        start, count = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "windows"))
        key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
        settled = batch.column("hashes").is_null().to_numpy(zero_copy_only=False)
        out = [(doc[settled], digest[settled], start[settled], count[settled])]
        listed = batch.column("starts").is_valid().to_numpy(zero_copy_only=False)[~settled]
        starts = [x for x in batch.column("starts").to_pylist() if x is not None]
        doc, digest, start, count, key = (x[~settled] for x in (doc, digest, start, count, key))
        if len(doc):
            places, count = count, np.where(listed, 1, count)  # hashes of a row
            value = np.frombuffer(b"".join(x for x in batch.column("hashes").to_pylist() if x is not None), "<u8").astype(np.uint64)
            inner = np.arange(len(value)) - np.repeat(np.cumsum(count) - count, count)
            old = len(carry[2])
            keys = np.concatenate([carry[0], np.repeat(key, count)])
            value = np.concatenate([carry[1], value])
            owner = np.concatenate([carry[2], np.repeat(doc, count)])
            least, one = first_holders(keys, value, owner)
            repeat = owner[old:] > least[old:]
            run = np.flatnonzero(repeat & ~np.repeat(listed, count))
            out.append(_spans(owner[old:][run], np.repeat(digest, count)[run], (np.repeat(start, count) + inner)[run]))
            if listed.any():
                again = repeat[np.cumsum(count)[listed] - 1]
                each = np.repeat(again, places[listed])
                at = np.frombuffer(b"".join(starts), "<i4").astype(np.int64)
                out.append(_spans(*(np.repeat(x[listed], places[listed])[each] for x in (doc, digest)), at[each]))
            last = one & (keys == key[-1])
            carry = [keys[last], value[last], least[last]]
        doc, digest, start, count = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(doc):
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(digest, pa.int64()), pa.array(start.astype(np.int32)), pa.array((start + count + WINDOW - 1).astype(np.int32))], ["doc_id", "digest", "from", "to"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, spans``: word ranges [from, to) that repeat a document with a smaller doc_id, for rows that have any.

    A document's windows never repeat its own, nor those of other rows with the same doc_id, whose texts ``digest`` (xxhash64)
    tells apart. Null texts have no words; rows with a null doc_id take no part.
    """
    ship(docs.sparkSession)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs.select("text"), size // BYTES_PER_ANCHOR, _anchors))
    return (
        docs.withColumn("digest", F.xxhash64("text"))
        .mapInArrow(_candidates(shared), OPEN)
        .repartition("key")
        .sortWithinPartitions("key", "doc_id")
        .mapInArrow(_repeats, "doc_id long, digest long, from int, to int")
        .groupBy("doc_id", "digest")
        .agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    )


def _kept(spans_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column(spans_name).to_pylist(), strict=True):
                words = (text or "").encode().split()  # splits bytes at exactly the six separators
                n_words.append(len(words))
                if spans:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for span in spans:
                        gone[span["from"]] += 1
                        gone[span["to"]] -= 1
                    words = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*part.schema.names, "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, n_removed, kept_text``: the words that no repeated window covers, joined by one space.

    Windows are judged on the input. Null or empty text: no words, kept_text is empty. Rows with a null doc_id keep all words.
    Rows of one doc_id never repeat each other, whether their texts are equal or not (ties). An empty table gives no rows.
    Columns of those three names are replaced, the others pass through, whatever their names.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")))
    name, digest, own = unused(docs, "spans", "digest", "row_id")
    spans = materialise(repeated_spans(docs)).select(F.col("doc_id").alias(own), F.col("digest").alias(digest), F.col("spans").alias(name))
    joined = docs.join(spans, (F.col("doc_id") == F.col(own)) & (F.xxhash64("text") == F.col(digest)), "left").drop(own, digest)
    return map_batches(joined, _kept(name), "n_words long, n_removed long, kept_text string").drop(name)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM t),
v AS (SELECT *, CASE WHEN i <= n - 49 THEN sha256(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS passage FROM w),
f AS (SELECT passage, min(doc_id) AS first FROM v WHERE passage IS NOT NULL GROUP BY passage),
r AS (SELECT v.*, coalesce(first < doc_id, false) AS again FROM v LEFT JOIN f USING (passage)),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""
