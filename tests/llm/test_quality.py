import numpy as np
import pyarrow as pa

from linkweave.llm import quality


def test_statistics_match_plain_python():
    texts = ["a a b. C!\nd|e", None, "", " \t", "ééé 12*", "x" * 5000, "w " * 9000]
    got = quality.statistics(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        data = (text or "").encode()
        words = data.split()
        if not words:
            assert not row.any()
            continue
        pairs = list(zip(words, words[1:], strict=False))
        assert np.isclose(row[0], np.log1p(len(words)))
        assert np.isclose(row[1], np.mean([len(w) for w in words]))
        assert np.isclose(row[2], len(set(words)) / len(words))
        assert np.isclose(row[3], max(words.count(w) for w in set(words)) / len(words))
        assert np.isclose(row[4], sum(a == b for a, b in pairs) / len(words))
        assert np.isclose(row[5], len(set(pairs)) / max(len(words) - 1, 1))
        assert np.isclose(row[13], sum(b >= 128 for b in data) / len(data))


def test_trees_learn_and_flat_traversal_matches_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.5)).astype(float)
    model = quality.fit_trees(x, y)
    p = model.scores(x)
    assert ((p > 0.5) == y).mean() > 0.97
    for i in range(20):
        margin = model.base
        for t in range(len(model.leaf)):
            node, level = 0, 0
            while (1 << level) < model.leaf.shape[1]:
                at = (1 << level) - 1 + node
                node = 2 * node + int(x[i, model.feature[t, at]] > model.threshold[t, at])
                level += 1
            margin += model.leaf[t, node]
        assert np.isclose(p[i], 1 / (1 + np.exp(-margin)))


def test_constant_labels():
    assert np.allclose(quality.fit_trees(np.zeros((3, 2)), np.ones(3)).scores(np.zeros((1, 2))), 3.5 / 4)
    assert np.allclose(quality.fit_trees(np.zeros((0, 2)), np.zeros(0)).scores(np.zeros((1, 2))), 0.5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality.op10_quality(spark, sf)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 40
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (None, "", 5.0), (1, "a b c", 5.0), (1, "a b c", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 4 and all(r.score == 0.5 for r in rows)
    assert quality.score(docs.limit(0), model).count() == 0
