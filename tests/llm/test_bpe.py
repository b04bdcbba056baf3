import hashlib
import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from linkweave.llm import bpe

SCHEMA = "doc_id long, text string, ids string"
TEXTS = [None, "", " ", "  a", "a  ", "\n\n x\t\t", "a" * 3000, " " * 2000 + "x", "I'll <|endoftext|> don't<|endoftext|>", "é" * 50, "同じ", "same", "same"]


def test_encode_and_decode_match_the_library(spark):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    random.seed(3)
    texts = TEXTS + ["".join(chr(random.choice([*range(32, 0x300), 0x2003, 0x1F600])) for _ in range(200)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == want
        assert row.decoded == library.decode(want, skip_special_tokens=False) == (row.text or "")


def test_every_code_point_splits_like_the_library():
    library, own = Tokenizer.from_file(bpe.vocabulary_path()), bpe.codec(bpe.vocabulary_path())
    points = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 3000):
        text = "".join(f"{c}a {c} " for c in points[at : at + 3000])
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_can_decode_too(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in bpe.encode(docs, decoded="back").collect():
        assert row.back == (row.text or "")


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "mine")], SCHEMA)
    row = bpe.encode(docs).collect()[0]
    assert row.text == "a b" and bytes(row.ids) == np.array([64, 275], "<u4").tobytes()
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0


def test_query(spark, small_dir):
    rows = bpe.op4_bpe(spark, small_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    library = Tokenizer.from_file(bpe.vocabulary_path())
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_a_task_lets_its_cache_go(spark, monkeypatch):
    """Python workers outlive a task: the pieces it has seen aren't kept for whatever the worker does next."""
    monkeypatch.setattr(bpe, "map_batches", lambda df, run, ddl: run)
    path = bpe.vocabulary_path()
    pieces = bpe.codec(path, bpe.read(path)).pieces
    batch = pa.record_batch({"text": ["a few words", "and others"]})
    run = bpe.encode(spark.createDataFrame([("a",)], "text string"), decoded="decoded")
    rows = run(iter([batch]))
    assert next(rows).column("decoded").to_pylist() == ["a few words", "and others"] and len(pieces)
    assert list(rows) == [] and not pieces and not pieces.older
