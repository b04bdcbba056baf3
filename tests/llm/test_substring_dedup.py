import hashlib
import random

import numpy as np
import pyarrow as pa

from linkweave.llm import sketch as sk
from linkweave.llm import substring_dedup as sd


def brute_force(docs):
    docs = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in docs:
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, w in docs:
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def rows_of(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in df.collect()}


def sample():
    random.seed(2)
    word = lambda: f"w{random.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 120)]
    docs = []
    for i in range(60):
        words = [word() for _ in range(random.randrange(0, 80))]
        for p in random.sample(passages, random.randrange(0, 3)):
            words += p + [word() for _ in range(random.randrange(0, 5))]
        docs.append((60 - i, "\t".join(words[:30]) + " \n" + "  ".join(words[30:])))
    docs += [(100, None), (101, ""), (102, " "), (103, "same " * 400), (104, "same " * 70), (105, docs[3][1]), (106, "x" * 50_000), (107, " ".join(passages[0]))]
    return docs


def test_matches_brute_force(spark, monkeypatch):
    docs = sample()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows_of(sd.remove_repeats(frame)) == brute_force(docs)


def test_tables_match_brute_force(spark, small_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    want = {i: (n, r, hashlib.sha256(k.encode()).hexdigest()) for i, (n, r, k) in brute_force(docs).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.op6_substring_dedup(spark, small_dir).collect()}
    assert got == want


def test_empty_tables_repeated_rows_null_ids_and_clashing_names(spark):
    text = " ".join(f"t{i}" for i in range(60))
    schema = "doc_id long, text string, n_words string, spans string, key string"
    docs = spark.createDataFrame([(5, text, "a", "b", "c"), (5, text, "a", "b", "c"), (9, text, "a", "b", "c"), (None, text, "a", "b", "c")], schema)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.spans) for r in sd.remove_repeats(docs).collect())
    assert got == [(0, 60, 0, "b"), (5, 60, 0, "b"), (5, 60, 0, "b"), (9, 60, 60, "b")]
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    long = " ".join(f"t{i}" for i in range(80))
    docs = spark.createDataFrame([(5, long), (5, "hi"), (5, "x " + long), (7, long), (7, "hi"), (3, " ".join(f"t{i}" for i in range(55)))], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in sd.remove_repeats(docs).collect())
    assert got == [(3, 55, 0), (5, 1, 0), (5, 80, 55), (5, 81, 55), (7, 1, 0), (7, 80, 80)]


def test_reserved_names_and_structs(spark):
    text = " ".join(f"t{i}" for i in range(60))
    docs = spark.createDataFrame([(5, text), (9, text)], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS spans", "2 AS digest", "3 AS row_id", "4 AS spans_", "named_struct('a-b', 1) AS s", "5 AS `x.y`")
    got = sorted((r.doc_id, r.n_removed, r.spans, r.digest, r.row_id, r.spans_, r.s["a-b"], r["x.y"]) for r in sd.remove_repeats(docs).collect())
    assert got == [(5, 0, 1, 2, 3, 4, 1, 5), (9, 60, 1, 2, 3, 4, 1, 5)]


def test_a_hot_phrase_is_dealt_by_window(spark, monkeypatch):
    """A phrase of 20 words in every document, and a passage around it that some share: the anchors are hot, nothing is lost."""
    random.seed(8)
    phrase = [f"p{i}" for i in range(20)]
    around = [[f"a{k}_{i}" for i in range(40)] for k in range(3)]
    docs = []
    for i in range(300):
        own = [f"o{i}_{k}" for k in range(40)] if i % 10 else around[i % 3]
        docs.append((i, " ".join(own + phrase + own[::-1])))
    docs += [(300 + i, " ".join(["one", "two"] * (30 + i % 40) + own[:5])) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for hot in (sk.HOT, 20, 1):
        monkeypatch.setattr(sk, "HOT", hot)
        assert rows_of(sd.remove_repeats(frame)) == brute_force(docs)
    monkeypatch.setattr(sk, "HOT", 20)
    shared = spark.sparkContext.broadcast(sd.sketch(frame.select("text"), 1000, sd._anchors))
    runs = frame.withColumn("digest", sd.F.xxhash64("text")).mapInArrow(sd._candidates(shared), sd.OPEN).where("hashes is not null")
    assert runs.groupBy("key").count().agg({"count": "max"}).first()[0] <= 20


def merged(keys, copies):
    width = 1 << 18
    partial = sk.partial_sketches(width, lambda batch: [keys])
    rows = [b for _ in range(copies) for b in partial(iter([pa.record_batch({"text": ["a"]})]))]
    table = pa.Table.from_batches(rows).sort_by("slice").combine_chunks()
    out = sk.Sketch(width, np.zeros(2 * width // 8, np.uint8), np.zeros(2 * width // 64, np.uint8))
    for b in sk.merge_sketches(sk.HOT)(iter(table.to_batches())):
        for at, bits, hot in zip(*(b.column(c).to_pylist() for c in ("slice", "bits", "hot")), strict=True):
            out.bits[at * sk.SLICE // 8 :][: sk.SLICE // 8] = np.frombuffer(bits, np.uint8)
            out.tops[at * sk.SLICE // 64 :][: sk.SLICE // 64] = np.frombuffer(hot, np.uint8)
    return out


def test_sketch_never_underestimates():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    found = merged(keys, 2)
    assert found.repeated(keys).all() and not found.hot(keys).any()
    assert found.repeated(keys ^ np.uint64(0xABCDEF)).mean() < 0.05
    often = np.concatenate([np.repeat(keys[:5], sk.HOT // 2), keys])
    found = merged(often, 2)
    assert found.hot(keys[:5]).all() and found.hot(keys[5:]).mean() < 0.01


def test_large_batches_are_worked_on_in_slices():
    """Whatever an Arrow batch holds, the words and lists of a slice alone are in memory, and what goes back is a slice each."""
    texts = [f"w{i} " * 2000 for i in range(700)]
    spans = [[{"from": 0, "to": 50}] if i % 7 == 0 else None for i in range(700)]
    batch = pa.record_batch({"text": texts, "spans": spans})
    out = list(sd._kept("spans")(iter([batch])))
    assert max(part.column("text").nbytes for part in out) <= 1.1 * (1 << 20)
    table = pa.Table.from_batches(out)
    assert table.column("text").to_pylist() == texts
    assert table.column("n_removed").to_pylist() == [50 if i % 7 == 0 else 0 for i in range(700)]
    assert table.column("kept_text").to_pylist() == [" ".join(t.split()[n:]) for t, n in zip(texts, table.column("n_removed").to_pylist(), strict=True)]
