import hashlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from linkweave.llm import bpe
from tests_llm_brute import components_of, kept_words


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_match_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*cp.COLUMNS)
    quality = cp.materialise(cp.quality_filter(spark, docs, sf))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in quality.collect()}
    assert quality.columns == cp.COLUMNS
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.97

    near = cp.materialise(cp.near_duplicates(spark, quality, sf))
    want = components_of([(r.doc_id, r.text) for r in quality.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, c in want.items() if c == i)

    passages = cp.materialise(cp.repeated_passages(spark, near, sf))
    texts = {r.doc_id: r.text for r in near.collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in passages.collect()}
    for i, (words, removed, left) in kept_words(sorted(texts.items())).items():
        if words and not left:
            assert i not in got
        else:
            text = left if removed else texts[i]
            assert got[i] == (text, len(text))

    mixed = cp.materialise(cp.mix_sources(spark, passages, sf))
    assert mixed.columns == cp.COLUMNS
    counts = Counter(rows(mixed))
    assert set(counts) <= set(rows(passages)) and max(counts.values()) <= 3
    words = lambda ts: sum(len(t.encode().split()) for t in ts)
    assert abs(words(r.text for r in mixed.collect()) / words(t for t, _ in got.values()) - 1) < 0.01

    library = Tokenizer.from_file(bpe.vocabulary_path())
    tokens = cp.tokenise(spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in mixed.collect())
    text_of = {r.doc_id: r.text for r in mixed.collect()}
    for r in tokens[:200]:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(text_of[r.doc_id], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(text_of[r.doc_id].encode()).hexdigest() and r.n_tokens * 4 == len(r.ids)


def test_stages_run_on_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y z", "en", None, 5), (3, "x" * 9000, "en", "a", 9000), (4, "a b c d e f", "en", "a", 11), (4, "a b c d e f", "en", "a", 11)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in cp.STAGES:
            docs = cp.materialise(stage(spark, docs, str(tmp_path)))
        assert docs.count() <= 3 * len(data)
