import random
import re
from collections import Counter

import numpy as np
import pytest

from linkweave.llm import near_dedup as nd
from linkweave.llm.components import components


def brute_force(docs):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in where.get(s, ()))
        for j, k in shared.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def rows_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_matches_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert rows_of(nd.near_duplicates(docs)) == brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_and_copies(spark):
    random.seed(5)
    base = [f"w{random.randrange(900)}" for _ in range(120)]
    docs, words = [], list(base)
    for i in range(30):  # each differs a little from the one before, so the ends are far apart
        docs.append((100 - i, " ".join(words)))
        at = random.randrange(110)
        words[at : at + 1] = [f"x{i}"]
    docs += [(200 + i, " ".join(base)) for i in range(40)]
    docs += [(300 + i, "Common line of six words here " + " ".join(f"y{i}_{j}" for j in range(i % 9))) for i in range(40)]
    for i in range(60):  # many that are near the base, but not all near each other
        words = list(base)
        for _ in range(i % 5):
            words[random.randrange(120)] = f"z{i}_{random.randrange(99)}"
        docs.append((1000 - i, " ".join(words)))
    docs += [(400, None), (401, ""), (402, "one two"), (403, "ONE two"), (404, " \t\n"), (405, "é" * 40_000)]
    got = rows_of(nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute_force(docs)


def test_empty_table_clashing_names_and_null_ids(spark):
    schema = "doc_id long, text string, bands string, rep string, component string"
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "y", "z"), (None, "a b c d e f", None, None, None)], schema)
    got = {(r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(docs).collect()}
    assert (1, 1, True) in got and len(got) == 2
    assert nd.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [4, 7, 14, 40, 95, 200])
def test_bands_find_pairs_at_the_threshold(n):
    random_ = np.random.default_rng(n)
    missed = 0
    for _ in range(100):
        k = n // 7
        a = random_.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate([a[k:], random_.integers(0, 2**63, k, dtype=np.uint64)]) if k else a[: int(np.ceil(0.75 * n))]
        s = nd.signatures([np.unique(a), np.unique(b)])
        bands = nd.band_values(s, nd.ROWS)
        missed += not (bands[0] == bands[1]).any()
    assert missed == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(1, 5), (5, 3), (7, 7), (None, 2)], "u long, v long")
    got = dict(components(edges).collect())
    assert got == {**{i: 10 for i in range(10, 41)}, 1: 1, 3: 1, 5: 1}


def test_rows_of_one_id_with_different_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = [(5, a), (5, b), (5, b), (7, b), (8, a + " more"), (9, b + " more"), (3, None), (3, "x y")]
    for parts in (1, 4):
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nd.near_duplicates(frame).collect())
        assert [g[:2] for g in got] == sorted([(5, 56), (5, 56), (5, 56), (7, 56), (8, 57), (9, 57), (3, 0), (3, 1)])
        of = {i: c for i, _, c in got}
        assert of[7] == 5 and sorted((of[8], of[9])) in ([5, 8], [5, 9]) and of[3] == 3


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch, tmp_path):
    """A chain of texts, each similar to its neighbours alone, that share buckets: every block size finds the same links."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[6 * i : 6 * i + 120])) for i in range(45)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = {i: c for i, (_, c, _) in brute_force(docs).items()}
    for size in (1, 3, 512):
        monkeypatch.setattr(nd, "PAIR_BLOCK", size)
        assert {r.doc_id: r.component_id for r in nd.near_duplicates(frame).collect()} == want
