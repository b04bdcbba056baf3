import numpy as np
import pyarrow as pa

from linkweave.llm import toxicity as tox
from linkweave.llm.training import held_out


def test_features_are_distinct_words_and_prefixes():
    bucket, first = tox.features(pa.array(["Bad bad, BAD! worse", None, "", "ok"]))
    assert np.diff(first).tolist() == [1 + 2, 0, 0, 1]  # "worse" adds its first four bytes


def test_thresholds_are_ordered_and_share_weights():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 20)) for _ in range(600)]
    bad = rng.random(600) < 0.3
    rows = [np.union1d(r, 1000 + rng.choice(10, rng.integers(1, 10), replace=False)) if b else r for r, b in zip(rows, bad, strict=True)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    bucket = np.concatenate(rows)
    odds = tox.log_odds(bucket, first, bad.astype(int))
    grade = tox.grades(bucket, first, bad.astype(int), odds)
    model = tox.fit_ordinal(bucket, first, grade, odds)
    assert (np.diff(model.threshold) > 0).all()
    above = model.above(model.margin(bucket, first))
    assert (np.diff(above, axis=1) <= 1e-12).all()
    severity = above.sum(axis=1)
    means = [severity[grade == k].mean() for k in range(4)]
    assert means == sorted(means) and ((above[:, 0] > 0.5) == bad).mean() > 0.99


def test_planted_toxic_documents(spark):
    docs = [(i, " ".join(f"word{(i * 7 + j) % 90}" for j in range(40)) + (" vilify you" if i % 4 == 0 else "")) for i in range(400)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = tox.fit(frame, labels)
    rows = tox.score(frame.unionByName(spark.createDataFrame([(None, None, "x")], frame.schema)), model).where(held_out()).collect()
    for r in rows:
        assert r.toxic == (r.doc_id is not None and r.doc_id % 4 == 0)
        assert 0 <= r.severity <= 3 and r.grade in range(4)
    assert tox.score(frame.limit(0), model).count() == 0


def test_no_labels(spark, small_dir):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    row = tox.score(docs, tox.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).first()
    assert row.severity >= 0
    assert tox.op1_toxicity(spark, small_dir).count() == spark.read.parquet(f"{small_dir}/documents.parquet").count()
