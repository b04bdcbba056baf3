"""What every order of five filters removes, from wide packed counters.

A document has a mask: a bit for each filter that it fails, and one each for its labels. A mask is mapped to one big integer
of 64-bit fields: five for each of the 600 steps (120 orders of 5 filters), and two for each filter. A document's integer
has a one where the document counts, so the sum of a part's integers holds all of the part's counts side by side. Documents of one
part and mask have the same integer and are counted before anything moves; a part then sums at most 128 integers, each
times its count. The largest field is 120 times a part's documents, so no field runs into the next below 2 ** 57 documents.

Filters (``own_fails`` and E; words are runs of anything but space and 0x09-0x0D, case counts): A under 200 words; B distinct words
under half of the words; C capitals A-Z above 2 % of the code points; D holds one of ``#$%&*|``; E the text of a row with a
smaller doc_id. Copies are found by the SHA-256 of the text. The least doc_id of each is aggregated before it is shuffled;
texts that at least a thousandth of the rows have (a thousand texts at most) are looked up by a broadcast, all others by a join.

Null texts are empty: they have no words, fail A, and are copies of each other. Rows without a doc_id never fail E, make no other
row fail it, and have no labels. Repeated rows of one doc_id don't make each other fail E, and count each. A null source is
the part ``''``. Of several labels of a doc_id the largest counts; null labels count as 0. Very long texts are taken whole. An
empty table has no parts. Extra columns pass through ``masks`` whatever their names; those it adds are replaced.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialise, ship, unused

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
GOOD, TOXIC = 1 << len(LETTERS), 2 << len(LETTERS)
PER_STEP = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
PER_FILTER = ("unique_fails", "shapley")
STEPS = len(ORDERS) * len(LETTERS)
FIELDS = STEPS * len(PER_STEP) + len(LETTERS) * len(PER_FILTER)
HOT_SHARE, HOT_ROWS = 1000, 10_000
COUNTS = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def own_fails(text, words):
    """The bits of the filters that look at one text only; ``words`` is the array of its words."""
    n, chars = F.size(words), F.char_length(text)
    tests = {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * chars,
        "D": text.rlike(r"[#$%&*|]"),
    }
    bits = [F.when(test, 1 << LETTERS.index(letter)).otherwise(0) for letter, test in tests.items()]
    return sum(bits[1:], bits[0])


def masks(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``part`` and ``mask`` (int: bits 0 to 4 are failed filters, 5 quality 1, 6 toxic 1)."""
    text, words, digest, fails, first, hot_first, key, salt, label = unused(docs, "text_", "words", "digest", "fails", "first", "hot_first", "key", "salt", "label")
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ("part", "mask") and (keep is None or c in keep)]
    rows = docs.withColumn(text, F.coalesce("text", F.lit(""))).withColumn(words, F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(0)))
    id_ = [] if "`doc_id`" in kept else ["doc_id"]
    rows = materialise(rows.select(*kept, *id_, F.coalesce("source", F.lit("")).alias("part"), own_fails(F.col(text), F.col(words)).alias(fails), F.unhex(F.sha2(text, 256)).alias(digest)))

    copies = rows.where("doc_id is not null").groupBy(digest).agg(F.min("doc_id").alias(first), F.count("*").alias("n")).where("n > 1")
    copies = materialise(copies)
    common = max(HOT_ROWS, rows.count() // HOT_SHARE)
    hot = F.broadcast(copies.where(F.col("n") >= common).select(F.col(digest).alias(key), F.col(first).alias(hot_first)))
    rows = rows.join(hot, F.col(digest) == F.col(key), "left").drop(key)
    # rows of common texts have their answer: they go anywhere, and meet no row of the join
    anywhere = F.concat(F.lit("hot").cast("binary"), F.coalesce("doc_id", F.lit(0)).cast("string").cast("binary"))
    rows = rows.withColumn(key, F.when(F.col(hot_first).isNull(), F.col(digest)).otherwise(anywhere)).drop(digest)
    rows = rows.join(copies.where(F.col("n") < common).select(F.col(digest).alias(key), first), key, "left").drop(key)

    marked = labels.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("g"),
        F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("t"),
    )
    marked = marked.where("g + t > 0 and doc_id is not null").select("doc_id", F.lit(0).cast("long").alias(salt), (F.col("g") + F.col("t")).alias(label))
    # rows without a doc_id have no label: spread over the join
    rows = rows.withColumn(salt, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(0).cast("long"))
    rows = rows.join(marked, ["doc_id", salt], "left")
    copy = F.when(F.col("doc_id") > F.coalesce(hot_first, first), 1 << LETTERS.index("E")).otherwise(0)
    return rows.select(*kept, "part", (F.col(fails) + copy + F.coalesce(label, F.lit(0))).cast("int").alias("mask"))


@lru_cache(maxsize=1)
def packed() -> list[int]:
    """The big integer of each mask; field 0 is the lowest."""
    out = []
    for mask in range(4 * GOOD):
        fields = np.zeros(FIELDS, "<u8")
        steps = fields[: STEPS * len(PER_STEP)].reshape(len(ORDERS), len(LETTERS), len(PER_STEP))
        filters = fields[STEPS * len(PER_STEP) :].reshape(len(LETTERS), len(PER_FILTER))
        for o, order in enumerate(ORDERS):
            gone = False
            for s, letter in enumerate(order):
                i = LETTERS.index(letter)
                fails = bool(mask >> i & 1)
                removed = fails and not gone
                steps[o, s] = (not gone and not fails, removed, fails and gone, removed and bool(mask & GOOD), removed and bool(mask & TOXIC))
                filters[i, 1] += removed
                gone |= fails
        for i in range(len(LETTERS)):
            filters[i, 0] = mask % GOOD == 1 << i
        out.append(int.from_bytes(fields.tobytes(), "little"))
    return out


def unpacked(total: int) -> dict[str, np.ndarray]:
    """The counts that a sum of integers holds: a value for each step, orders one after the other."""
    fields = np.frombuffer(total.to_bytes(8 * FIELDS, "little"), "<u8").astype(np.int64)
    steps = fields[: STEPS * len(PER_STEP)].reshape(STEPS, len(PER_STEP))
    filters = fields[STEPS * len(PER_STEP) :].reshape(len(LETTERS), len(PER_FILTER))
    letter = np.array([LETTERS.index(x) for order in ORDERS for x in order])
    return {n: steps[:, i] for i, n in enumerate(PER_STEP)} | {n: filters[letter, i] for i, n in enumerate(PER_FILTER)}


def audit(masked: DataFrame) -> DataFrame:
    """Counts of every part, order and step from ``part, mask``."""
    ship(masked.sparkSession)
    names = [c.split()[0] for c in COUNTS.split(", ")[3:]]

    def of_part(group: pa.Table) -> pa.Table:
        integers = packed()
        total = sum(n * integers[mask] for mask, n in zip(group.column("mask").to_pylist(), group.column("n").to_pylist(), strict=True))
        counts = unpacked(total)
        return pa.table(
            {
                "part": pa.array([group.column("part")[0].as_py()] * STEPS, pa.string()),
                "filter_order": pa.array([o for o in ORDERS for _ in LETTERS], pa.string()),
                "step": pa.array(list(range(1, len(LETTERS) + 1)) * len(ORDERS), pa.int32()),
                **{n: pa.array(counts[n], pa.int64()) for n in names},
            }
        )

    return masked.groupBy("part", "mask").agg(F.count("*").alias("n")).groupBy("part").applyInArrow(of_part, COUNTS)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return audit(masks(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=[]))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), f AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM f LEFT JOIN l USING (doc_id)
), g AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v
), p AS (
  SELECT a.v || b.v || c.v || d.v || e.v AS filter_order
  FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier
  FROM p, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS step)
), j AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails,
    contains(fails, letter) AS own, translate(fails, earlier, '') <> fails AS gone
  FROM g, s
), r AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT own), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE NOT gone AND own), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND own), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = letter), 0) AS unique_fails,
    coalesce(sum(n) FILTER (WHERE NOT gone AND own AND good = 1), 0) AS good_lost,
    coalesce(sum(n) FILTER (WHERE NOT gone AND own AND toxic = 1), 0) AS toxic_lost
  FROM j GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
