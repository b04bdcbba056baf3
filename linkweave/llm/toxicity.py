"""Toxicity: cumulative-link ordinal regression from sparse text features to a severity grade.

P(grade <= k) = sigmoid(threshold_k - w . x): all ordered thresholds share the weights. x marks the distinct words of a
text (A-Z lower-cased, ASCII punctuation dropped) and their first four and five bytes, hashed to ``BUCKETS``. A
feature is scaled by its log-odds between toxic and other rows of the sample; those not above ``NEUTRAL``, or in
fewer than ``LEAST_ROWS`` texts, weigh nothing, so a long text doesn't gather noise. The labels only say toxic or not;
training grades the toxic rows of its sample by thirds of the number of their features whose log-odds are above
``EVIDENCE``: 0 not toxic, 1 to 3 mild to severe.

Defined cases. Null, empty and wordless texts have no evidence: the least severity, grade 0. Texts of any length are taken
whole; a feature counts once a text. Of equally likely grades the lower one is given. Repeated rows have a row each with the
same scores. An empty table gives no rows; without labels nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import map_batches, ship
from .text import NOT_WORD, Words, mix, slices
from .training import labelled_sample

BUCKETS = 1 << 20
PREFIXES = (4, 5)
GRADES = 4
EVIDENCE = 2.0
NEUTRAL = 2.0
LEAST_ROWS = 3
DOUBT = 1.5


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of all texts, one text after another, and where each text's begin (n + 1 places)."""
    words = Words(column, lower=True, separator=NOT_WORD)
    n = len(words.first) - 1
    doc = np.repeat(np.arange(n), words.counts()).astype(np.uint64)
    keys = [(doc << np.uint64(32)) | (words.hashes() & np.uint64(BUCKETS - 1))]
    for salt, most in enumerate(PREFIXES, 1):
        long = words.length > most
        prefix = mix(words.hashes(most)[long] + np.uint64(salt)) & np.uint64(BUCKETS - 1)
        keys.append((doc[long] << np.uint64(32)) | prefix)
    key = np.unique(np.concatenate(keys))
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(key >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


@dataclass
class Ordinal:
    weight: np.ndarray
    threshold: np.ndarray

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.threshold[None, :], -60, 60)))

    def margin(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        return sums(self.weight[bucket], first)


def log_odds(bucket: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Of each bucket between toxic and other rows, less DOUBT standard errors; 0 for fewer than LEAST_ROWS rows."""
    row_toxic = np.repeat(toxic, np.diff(first))
    with_, without = (np.bincount(bucket[row_toxic == c], minlength=BUCKETS) for c in (1, 0))
    odds = np.log((with_ + 0.5) / (toxic.sum() + 1)) - np.log((without + 0.5) / ((1 - toxic).sum() + 1))
    odds -= DOUBT * np.sqrt(1 / (with_ + 0.5) + 1 / (without + 0.5))
    return np.where(with_ + without >= LEAST_ROWS, odds, 0)


def grades(bucket: np.ndarray, first: np.ndarray, toxic: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """0 for rows that aren't toxic, else 1 to 3 by thirds of the evidence."""
    amount = sums((odds > EVIDENCE)[bucket], first)
    cuts = np.quantile(amount[toxic == 1], [1 / 3, 2 / 3]) if toxic.any() else np.zeros(2)
    return toxic * (1 + (amount > cuts[0]) + (amount > cuts[1]))


def fit_ordinal(bucket: np.ndarray, first: np.ndarray, grade: np.ndarray, odds: np.ndarray, steps: int = 300, rate: float = 0.03, l2: float = 1e-5) -> Ordinal:
    """Full-batch Adam on the likelihood. Thresholds stay in order: a first one and positive gaps."""
    n, cuts = len(grade), GRADES - 1
    if not n or grade.max() == 0:
        return Ordinal(np.zeros(BUCKETS, np.float32), np.log(n + 1.0) + np.arange(cuts))
    informative = odds > NEUTRAL
    kept = informative[bucket]
    size = sums(kept, first).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    used, place = np.unique(bucket[kept], return_inverse=True)
    value = odds[used][place]
    theta = np.concatenate([np.full(len(used), 0.1), [1.0], np.zeros(cuts - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    row = np.arange(n)
    for step in range(1, steps + 1):
        w, raw = theta[: len(used)], theta[len(used) :]
        cut = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        margin = sums(w[place] * value, first)
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(cut[None, :] - margin[:, None], -60, 60))), np.ones((n, 1))], axis=1)
        up, low = below[row, grade + 1], below[row, grade]
        p = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        d_margin = d_up - d_low
        gradient = np.zeros_like(theta)
        gradient[: len(used)] = np.bincount(place, np.repeat(d_margin, size) * value, minlength=len(used)) / n + l2 * w
        d_cut = np.array([(d_low[grade == k + 1].sum() - d_up[grade == k].sum()) / n for k in range(cuts)])
        gradient[len(used)] = d_cut.sum()
        for k in range(1, cuts):
            gradient[len(used) + k] = d_cut[k:].sum() * np.exp(raw[k])
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[: len(used)] = np.maximum(theta[: len(used)], 0)  # evidence of toxic rows never speaks against it
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = theta[: len(used)] * odds[used]
    raw = theta[len(used) :]
    return Ordinal(weight, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]))


def _buckets_of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            bucket, first = features(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), lists], ["doc_id", "label", "buckets"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 8_000) -> Ordinal:
    """A model from at most ``sample_rows`` labelled documents that aren't held out."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, sample_rows)
    table = sample.mapInArrow(_buckets_of_sample, "doc_id long, label int, buckets array<int>").toArrow().sort_by("doc_id").combine_chunks()
    lists = table.column("buckets").combine_chunks()
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    bucket = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    toxic = (table.column("label").to_numpy() > 0).astype(np.int64)
    odds = log_odds(bucket, first, toxic)
    return fit_ordinal(bucket, first, grades(bucket, first, toxic, odds), odds)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``docs`` with ``severity`` (expected grade, 0 to 3), ``grade`` (the likeliest), ``p_toxic`` and ``toxic``.

    Null text counts as empty, which has the severity of no evidence. Columns of those names are replaced.
    """
    ship(docs.sparkSession)
    new = ("severity", "grade", "p_toxic", "toxic")
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new))
    weights = docs.sparkSession.sparkContext.broadcast(model.weight.tobytes())
    threshold = model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Ordinal(np.frombuffer(weights.value, np.float32), threshold)
        for batch in batches:
            for part in slices(batch):
                above = local.above(local.margin(*features(part.column("text"))))
                each = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
                columns = [pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *new])

    return map_batches(docs, run, "severity double, grade int, p_toxic double, toxic boolean")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", "severity", "grade", "p_toxic", "toxic")
