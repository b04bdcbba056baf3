import numpy as np

from linkweave.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, dims string"


def brute_force(rows, k=10):
    rows = {i: np.array(v, float) for i, v, _ in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    out = {}
    for q in rows:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((rows[i] - rows[q]) ** 2).sum())), i) for i in rows if i != q and len(rows[i]) == len(rows[q]))
            out[q] = near[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def sample():
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], "x") for i in range(450)]
    rows += [(1000 + i, [1.0, 2.0] + [0.0] * 6, "x") for i in range(40)] + [(100_000, [1.0, 2.0] + [0.0] * 6, "x")]
    rows += [(2000, None, "x"), (2100, [0.0] * 8, "x"), (2200, [float("nan")] * 8, "x"), (2300, [None] + [1.0] * 7, "x"), (2400, [float("inf")] * 8, "x"), (2500, [], "x"), (None, [1.0] * 8, "x")]
    return rows + [(3000, [1.0, 1.0], "x"), (3001, [1.0, 1.5], "x"), (7, rows[7][1], "x")]


def test_blocks_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(nb, "VECTORS_PER_BLOCK", 60)
    monkeypatch.setattr(nb, "QUERIES_PER_BLOCK", 3)
    vectors = nb.usable(spark.createDataFrame(sample(), SCHEMA))
    got, want = found(nb.nearest(vectors, vectors.where("vec_id % 100 = 0"))), brute_force(sample())
    assert got.keys() == want.keys()
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) / max(1, len(want[q])) for q in want if want[q]]
    assert np.mean(hits) > 0.95
    assert [i for _, i in got[100_000]] == list(range(1000, 1010))
    for q in got:
        for score, i in got[q]:
            assert any(np.isclose(score, s) and i == j for s, j in brute_force(sample(), 10_000)[q])


def test_empty_table(spark):
    vectors = nb.usable(spark.createDataFrame([], SCHEMA))
    assert nb.nearest(vectors, vectors).count() == 0


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(nb.op8_neighbours(spark, sf)), brute_force(rows)
    assert got.keys() == want.keys()
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.95


def test_the_least_of_repeated_ids_takes_part(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [5.0, 5.0], "x"), (1, [1.0, 1.0], "x"), (2, [1.0, 3.0], "x")]
    for parts in (1, 3):
        vectors = nb.usable(spark.createDataFrame(rows, SCHEMA).repartition(parts))
        assert [(r.vec_id, r.score) for r in nb.nearest(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1.0), (2, 3.0)]
