import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkweave.llm import packing as pk
from linkweave.llm.session import materialise


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pk.vocabulary_path())


def naive(lengths, capacity):
    """Best fit decreasing with a scan over all sequences: the room left, in the order in which pieces are put."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return sorted(room)


def test_best_fit_equals_a_scan_over_all_sequences():
    rng = random.Random(3)
    for capacity in (1, 7, 64, 100):
        for _ in range(20):
            lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randrange(0, 120))], np.int64)
            sequence, offset = pk.best_fit_decreasing(lengths, capacity)
            used = [0] * (int(sequence.max()) + 1 if len(lengths) else 0)
            for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True)):
                assert o == used[s]
                used[s] += n
            assert sorted(capacity - u for u in used) == naive(lengths.tolist(), capacity)


def test_ids_equal_the_library(library):
    with open(pk.vocabulary_path(), encoding="utf-8") as f:
        ids = pk.word_ids("test", f.read())
    rng = random.Random(4)
    letters = [" ", "  ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "́", "é", "İ", "Σ", "a", "B", "'s", "'", "9", "१", "!", "é", "\U0001f600", "가", "<|endoftext|>", "<|startoftext|>", "ﬁ", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [chr(c) + "x " + chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + ["", "x" * 5000]
    rng.shuffle(texts)
    for at in range(0, len(texts), 700):
        part = texts[at : at + 700]
        found, begins = ids.encode(pa.array(part))
        for i, text in enumerate(part):
            assert found[begins[i] : begins[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_with_one_hash_are_told_apart(library, monkeypatch):
    with open(pk.vocabulary_path(), encoding="utf-8") as f:
        ids = pk.WordIds(f.read())
    monkeypatch.setattr(pk.Words, "hashes", lambda self, most=None: self.length.astype(np.uint64))
    texts = ["one two", None, "six ten seven", ""]
    found, begins = ids.encode(pa.array(texts))
    assert [found[a:b].tolist() for a, b in zip(begins, begins[1:])] == [library.encode(x or "", add_special_tokens=False).ids for x in texts]


DOCS = [(1, "Hello, World!"), (1, "Hello, World!"), (2, None), (3, ""), (4, " \n "), (None, "no id"), (5, " ".join(f"w{i}" for i in range(3000))), (6, "the " * 2047), (7, "the " * 2048), (8, "é" * 9000)] + [(100 + i, "word " * (i * 37 % 900)) for i in range(60)]


@pytest.mark.parametrize("per_shard", [1 << 16, 20])
def test_pieces_are_whole_and_packed_without_gaps(spark, library, per_shard):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").select("*", *(F.lit(1).alias(n) for n in ("piece", "dealt", "length", "ids", "offset", "x.y"))).repartition(3)
    rows = pk.pack(materialise(pk.pieces(docs)), per_shard=per_shard).collect()
    want = []
    for i, text in DOCS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(i, p, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    if per_shard > len(rows):
        assert len(by_sequence) == len(naive([r.length for r in rows], 2048))


def test_sequences_hold_the_ids_of_their_pieces(spark, library):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    rows = pk.sequences(docs).collect()
    assert all(len(r.ids) <= 4 * 2048 for r in rows) and len({r.sequence_id for r in rows}) == len(rows)
    ids = [i for r in rows for i in np.frombuffer(bytes(r.ids), "<u4").tolist()]
    want = [i for _, text in DOCS for i in [*library.encode(text or "", add_special_tokens=False).ids, 0]]
    assert sorted(ids) == sorted(want)
    assert pk.pack(materialise(pk.pieces(docs.limit(0)))).count() == 0
