import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkweave.llm import mixing as mx

SCHEMA = "doc_id long, source string, text string, size string, gap string"


def shares(sizes):
    """Targets by passing the excess on until no source is above its most."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mx.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(stopped.values())
        goal = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > 3 * sizes[s]]
        if not over:
            return {**goal, **stopped}
        stopped.update({s: 3 * sizes[s] for s in over})


def sample(n=600):
    random.seed(4)
    names = ["a", "b", "c", "z", "é", None, "tiny"]
    docs = [(i, random.choices(names, [9, 3, 3, 1, 2, 2, 0.1])[0], "w " * random.choice([0, 1, 5, 30, 200]), "x", "y") for i in range(n)]
    return docs + [(n, "tiny", None, "x", "y"), (None, "a", "one two", "x", "y"), (n, "tiny", "w " * 3, "x", "y"), (n, "tiny", "w " * 3, "x", "y"), (n + 1, "long", "w " * 9000, "x", "y")]


def test_targets_and_draws(spark):
    docs = sample()
    rows = mx.draws(mx.sized(spark.createDataFrame(docs, SCHEMA).drop("size")), 8).collect()
    assert len(rows) == len(docs)
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * len(r.shards)
        most[r.source] = max(most[r.source], r["size"])
        assert len(r.shards) == r.copies <= 3 and all(0 <= s < 8 for s in r.shards)
    want = shares(sizes)
    for r in rows:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1


def words_of_shards(rows):
    words, of_source = Counter(), Counter()
    for r in rows:
        for s in r.shards:
            words[s] += r["size"]
            of_source[s, r.source] += r["size"]
    return words, of_source


def test_reruns_agree_and_shards_have_about_the_same_words(spark):
    names = ["a"] * 6 + ["b"] * 3 + ["c"]
    docs = spark.createDataFrame([(i, names[i % 10], "w " * 10) for i in range(20_000)], "doc_id long, source string, text string")
    rows = mx.draws(mx.sized(docs), 16).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mx.draws(mx.sized(docs.repartition(3)), 16).collect()))
    words, of_source = words_of_shards(rows)
    mean = sum(words.values()) / 16
    assert set(words) == set(range(16))
    # every shard has as many blocks as any other; blocks hold about as many words
    assert max(abs(w - mean) for w in words.values()) <= 3 * mean / mx.BLOCKS_PER_SHARD
    # the largest source's quota of a shard varies as a hypergeometric draw of its blocks does
    blocks = [of_source[s, "a"] / (mean / mx.BLOCKS_PER_SHARD) for s in range(16)]
    share = sum(blocks) / 16 / mx.BLOCKS_PER_SHARD
    assert max(abs(b - sum(blocks) / 16) for b in blocks) < 4 * math.sqrt(mx.BLOCKS_PER_SHARD * share * (1 - share)) + 1


def plain_tree(totals, shards, key):
    """Quotas by plain recursion: a node's tokens in order of ``key(level, source, number)``, the first half to the left."""
    leaves = {}

    def split(node, level, tokens):
        if 1 << level == shards:
            for source, _ in tokens:
                leaves[node, source] = leaves.get((node, source), 0) + 1
            return
        tokens = sorted(tokens, key=lambda t: key[level, t[0], t[1]])
        left = (len(tokens) + level % 2) // 2
        split(2 * node, level + 1, tokens[:left])
        split(2 * node + 1, level + 1, tokens[left:])

    split(0, 0, [(s, k) for s, n in totals for k in range(1, n + 1)])
    return leaves


@pytest.mark.parametrize("node_tokens", [1 << 14, 40])
def test_quotas_equal_a_plain_recursion(spark, monkeypatch, node_tokens):
    monkeypatch.setattr(mx, "NODE_TOKENS", node_tokens)  # with 40 the upper levels are split by ranges
    totals = [("a", 181), ("b", 60), (None, 15), ("none", 0), ("z", 1)]
    frame = spark.createDataFrame(totals, "source string, n long")
    numbers = frame.where("n > 0").select("source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("number"))
    key = {(level, r.source, r.number): r.key for level in range(4) for r in numbers.withColumn("key", mx.token_key(level, F.col("source"), F.col("number"))).collect()}
    got = {(r.shard, r.source): r.quota for r in mx.quotas(frame, 16).collect()}
    assert got == plain_tree(totals, 16, key)
    for source, n in totals:
        assert sum(q for (_, s), q in got.items() if s == source) == n
    per_shard = Counter()
    for (shard, _), q in got.items():
        per_shard[shard] += q
    assert max(per_shard.values()) - min(per_shard.values()) <= 1


def test_quotas_vary_as_hypergeometric_draws(spark):
    totals = [("a", 3000), ("b", 1000), ("c", 96)]
    quotas = [r.quota for r in mx.quotas(spark.createDataFrame(totals, "source string, n long"), 64).where("source = 'a'").collect()]
    size, share = 4096 / 64, 3000 / 4096
    variance = size * share * (1 - share) * (4096 - size) / 4095
    assert len(quotas) == 64 and 0.5 * variance < sum((q - size * share) ** 2 for q in quotas) / 64 < 1.7 * variance


def test_shards_take_their_quotas_of_blocks_once_each(spark):
    docs = spark.createDataFrame(sample(), SCHEMA)
    rows = mx.sized(docs.drop("size")).select("doc_id", "source", "size", "place")
    planned = mx.with_plan(rows, mx.with_blocks(mx.plan(rows), 8))
    blocks = mx.numbered(planned)
    totals = blocks.groupBy("source").agg(F.first(F.col("copies") * F.col("whole") + F.col("extra")).alias("n"))
    leaves = mx.quotas(totals, 8)
    dealt = mx.dealt(blocks, leaves).collect()
    want = {(r.source, r.block, c) for r in planned.collect() for c in range(1, r.copies + 1 + r.more)}
    assert len(dealt) == len(want) and {(r.source, r.block, r.copy) for r in dealt} == want
    assert Counter((r.shard, r.source) for r in dealt) == {(r.shard, r.source): r.quota for r in leaves.collect()}


def test_clashing_names_and_structs(spark):
    docs = spark.createDataFrame(sample(50), SCHEMA).selectExpr("*", "1 AS copy", "2 AS __s", "3 AS shards", "4 AS row", "5 AS block", "named_struct('a-b', 1) AS s", "6 AS `x.y`", "7 AS shard", "8 AS place")
    rows = mx.mix(docs, 4)
    assert rows.columns == [c for c in docs.columns if c != "shard"] + ["shard"]
    assert {(r.copy, r["__s"], r.shards, r.row, r.block, r.s["a-b"], r["x.y"], r.place, r["size"]) for r in rows.collect()} == {(1, 2, 3, 4, 5, 1, 6, 8, "x")}


def test_shards_follow_the_words():
    assert [mx.shard_count(n * mx.WORDS_PER_SHARD) for n in (0, 1, 1.5, 3, 4, 1000)] == [16, 16, 16, 16, 16, 1024] and mx.shard_count(17 * mx.WORDS_PER_SHARD) == 32


def test_mix_repeats_rows_by_shard(spark):
    docs = spark.createDataFrame(sample(), SCHEMA)
    mixed = mx.mix(docs, 4)
    assert mixed.columns == ["doc_id", "source", "text", "size", "gap", "shard"]
    got = Counter((r.doc_id, r.source, r.text) for r in mixed.collect())
    want = Counter()
    for r in mx.draws(mx.sized(docs.drop("size")), 4).collect():
        want[(r.doc_id, r.source, r.text)] += len(r.shards)
    assert got == +want


def test_a_long_document_early_in_the_permutation_costs_nothing(spark):
    """No document that is left out fits what is missing, wherever a document larger than the rest stands."""
    text = "w " * 500
    ids = mx.sized(spark.createDataFrame([(i, text) for i in range(201)], "doc_id long, text string"))
    first = ids.orderBy("place").first().doc_id
    docs = [(i, "b", "w " * 100_000 if i == first else text) for i in range(201)] + [(1000 + i, "a", text) for i in range(120)]
    rows = [r for r in mx.draws(mx.sized(spark.createDataFrame(docs, "doc_id long, source string, text string")), 4).collect() if r.source == "b"]
    gap = rows[0].target - sum(r["size"] * len(r.shards) for r in rows)
    assert rows[0].target == 80_000 and gap == 0


def test_empty_table(spark):
    assert mx.mix(spark.createDataFrame([], SCHEMA), 4).count() == 0
