"""Quality classifier: histogram gradient-boosted trees over statistics of a document's bytes and words.

The trees are complete and flat: arrays of features and thresholds by level, so a batch walks all trees with a few
numpy operations. Training runs on a bounded sample of labelled rows (``sample_rows``); scoring covers every text.

Defined cases. Null, empty and wordless texts have statistics of zero and the score that the trees give those. Texts of any
length are taken whole. Of equally good splits the first feature's is taken, so fits on equal samples are equal. Repeated
rows have a row each with the same score. An empty table gives no rows; without labels, or with one label, the score is a
constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import map_batches, ship
from .text import Words, join_hashes, slices
from .training import held_out, labelled_sample

THRESHOLD = 0.3
FEATURES = (
    "log_words",
    "word_bytes",
    "distinct_words",
    "commonest_word",
    "repeats_before",
    "distinct_pairs",
    "upper",
    "symbols",
    "exclamations",
    "bars",
    "digits",
    "stops",
    "line_ends",
    "not_ascii",
    "word_ends_in_symbol",
)


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, LETTERS = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
SYMBOLS = _mask("*$%&#@^~+=<>{}[]\\/_`|")
BYTE_SHARES = (SYMBOLS, _mask("!"), _mask("|"), _mask("0123456789"), _mask(".,"), _mask("\n"), np.arange(256) >= 128)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text; all zero for one without words."""
    words = Words(column)
    data, offsets, first = words.data, words.offsets, words.first
    n, size = words.counts(), np.diff(offsets)

    def by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    doc = np.repeat(np.arange(len(n)), n)
    hashes = words.hashes()

    def distinct(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each document, and how often its commonest comes."""
        key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24)))
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        owner = (key[at] >> np.uint64(40)).astype(np.int64)
        most = np.zeros(len(n), np.int64)
        if len(at):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            most[owner[begin]] = np.maximum.reduceat(np.diff(np.append(at, len(key))), begin)
        return np.bincount(owner, minlength=len(n)), most

    kinds, most = distinct(hashes, doc)
    pair = doc[1:] == doc[:-1]
    pair_kinds, _ = distinct(join_hashes(hashes[:-1], hashes[1:])[pair], doc[1:][pair])
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & pair
    last = data[words.start + words.length - 1] if len(words.start) else np.zeros(0, np.uint8)
    some, bytes_ = np.maximum(n, 1), np.maximum(size, 1)
    out = [
        np.log1p(n),
        by_doc(words.length, first) / some,
        kinds / some,
        most / some,
        by_doc(same, first) / some,
        pair_kinds / np.maximum(n - 1, 1),
        by_doc(UPPER[data], offsets) / np.maximum(by_doc(LETTERS[data], offsets), 1),
        *(by_doc(m[data], offsets) / bytes_ for m in BYTE_SHARES),
        by_doc(SYMBOLS[last] | (last == ord("!")), first) / some,
    ]
    return np.where(n[:, None] > 0, np.stack(out, axis=1), 0.0)


@dataclass
class Trees:
    """Flat trees: node i of a level has the children 2i and 2i + 1 of the next; larger values go right."""

    base: float
    feature: np.ndarray  # trees x (2 ** depth - 1), level after level
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2 ** depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        row = np.arange(len(x))[:, None]
        tree = np.arange(len(self.leaf))[None, :]
        at = np.zeros((len(x), len(self.leaf)), np.int64)
        width = 1
        while width < self.leaf.shape[1]:
            node = width - 1 + at
            at = 2 * at + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            width *= 2
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least_rows: int = 5) -> Trees:
    """Gradient boosting of the logistic loss on histograms. One class or no rows: a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    nodes = (1 << depth) - 1
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((1, nodes), np.int64), np.full((1, nodes), np.inf), np.zeros((1, nodes + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    feature, threshold, leaf = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            width = 1 << level
            best = np.full(width, 1e-6)
            split_f, split_b = np.zeros(width, np.int64), np.full(width, bins)
            for f in range(x.shape[1]):
                slot = at * bins + binned[:, f]
                left = [np.cumsum(np.bincount(slot, w, minlength=width * bins).reshape(width, bins), axis=1) for w in (g, h, np.ones(len(y)))]
                (gl, gt), (hl, ht), (nl, nt) = ((s, s[:, -1:]) for s in left)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain = np.where((nl >= least_rows) & (nt - nl >= least_rows), gain, 0)[:, : len(edges[f])]
                if gain.shape[1]:
                    b = gain.argmax(axis=1)
                    value = gain[np.arange(width), b]
                    better = value > best
                    best[better], split_f[better], split_b[better] = value[better], f, b[better]
            for i in range(width):
                if split_b[i] < bins:
                    feature[t, width - 1 + i], threshold[t, width - 1 + i] = split_f[i], edges[split_f[i]][split_b[i]]
            at = 2 * at + (binned[np.arange(len(y)), split_f[at]] > split_b[at])
        leaf[t] = -rate * np.bincount(at, g, minlength=nodes + 1) / (np.bincount(at, h, minlength=nodes + 1) + l2)
        margin += leaf[t, at]
    return Trees(base, feature, threshold, leaf)


def _statistics_of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 20_000) -> Trees:
    """Trees from at most ``sample_rows`` labelled documents that aren't held out."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, sample_rows)
    table = sample.mapInArrow(_statistics_of_sample, "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, table.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1. Null text counts as empty; a column of that name is replaced."""
    ship(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(statistics(part.column("text"))))], [*part.schema.names, name])

    return map_batches(docs, run, f"`{name}` double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
