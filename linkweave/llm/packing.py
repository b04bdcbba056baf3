"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length.

A document is its ids and one end id. Documents longer than a sequence are cut into pieces of the sequence's length, all others stay
whole. Pieces are dealt to shards of about ``PIECES_PER_SHARD`` without regard to what they hold; a shard is packed by itself,
longest piece first, each into the open sequence that it leaves the least room in. A segment tree over the remaining
capacities finds that sequence: leaf r stands for the sequences with room for r tokens, an inner node says whether any leaf
below it has one, and the first such leaf from the piece's length on is reached in logarithmic time. At most one sequence of a shard
stays half empty for want of the other shards, so sharding costs about one sequence in 40,000.

Only lengths are shuffled, not ids: ``sequences`` brings the ids to their places afterwards. What is dealt depends on the split of
the input and the row's number in it, written with the pieces, so retried tasks and repeated rows give no trouble.

Ids come from words of a text, cut at ASCII white space: no token of this vocabulary reaches over white space, so a
text's ids are its words' ids in a row. Words that a Python worker has met are known to it, a bounded number of them; the library
itself encodes the others.

Null texts are empty: a piece of the end id alone. Texts of any length are taken whole. Ties of length go by place in
the shard. Repeated rows, and rows without a doc_id, are packed once each. An empty table gives no pieces. Extra columns of
``docs`` are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read
from .session import materialise, ship
from .text import Words, join_hashes, slices

LENGTH, END_ID = 2048, 0
PIECES_PER_SHARD = 1 << 16
KNOWN_WORDS, MOST_IDS, LINE = 1 << 20, 1 << 24, 1000
#: Of each byte: 0 for the space between words, letters, digits (each a piece of its own), anything else.
LETTER, DIGIT, OTHER = 1, 2, 3
KIND = np.array([0 if b == 0x20 else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else OTHER for b in range(128)] + [OTHER] * 128, np.int8)
#: Bytes of words that aren't cut by their kinds alone: beyond ASCII, in contractions, in special tokens.
ODD = np.array([b > 127 or chr(b) in "'<" for b in range(256)])
PART_BYTES = 1 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Joined:
    """Words of a buffer with a space after each: ``data``, and the ``start`` and ``stop`` of each word in it."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.stop = np.cumsum(length + 1) - 1
        self.start = self.stop - length
        place = np.repeat(start - self.start, length + 1) + np.arange(self.stop[-1] + 1)
        place[self.stop] = 0
        self.data = data[place]
        self.data[self.stop] = 0x20


class WordIds:
    """Ids of texts, a part of a batch at once; each word that is new to the worker goes to the library once.

    Words are known by a hash, and a second one tells if another word has the same. New words go to the library in lines, as a
    call costs more than a word: ASCII words with a space between them, whose pieces are told apart by the end of word in
    their last token and counted by their letters, digits and other characters; other words with a special token between them.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        self.mark, self.mark_id = self.special[-1], spec["added_tokens"][-1]["id"]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[at for token, at in vocabulary.items() if token.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def library(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")

    def of_plain(self, words: Joined) -> list[np.ndarray]:
        """Ids and counts of ASCII words without an apostrophe or a special token."""
        kind = KIND[words.data]
        begins = (kind == DIGIT) | (kind != np.concatenate([[0], kind[:-1]]))
        pieces = np.add.reduceat(begins & (kind > 0), words.start)
        ids = self.library(words.data.tobytes())
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != pieces.sum():
            raise ValueError("the vocabulary has other pieces than letters, single digits and the rest")
        return [ids, np.diff(stops[np.cumsum(pieces) - 1], prepend=0)]

    def of_other(self, words: Joined) -> list[np.ndarray]:
        """Ids and counts of any other words."""
        texts = [words.data[a:b].tobytes() for a, b in zip(words.start.tolist(), words.stop.tolist(), strict=True)]
        if any(x in w for w in texts for x in self.special):
            found = [self.library(w) for w in texts]
            return [np.concatenate(found), np.array([len(x) for x in found])]
        ids = self.library(self.mark.join(texts))
        marks = ids == self.mark_id
        return [ids[~marks], np.diff(np.flatnonzero(np.append(marks, True)), prepend=-1) - 1]

    def learn(self, words: Words, which: np.ndarray, keys: np.ndarray, second: np.ndarray) -> None:
        """Brings the words at ``which`` to what is known."""
        odd = np.concatenate([[0], np.cumsum(ODD[words.data])])
        is_odd = odd[words.start[which] + words.length[which]] > odd[words.start[which]]
        order, found = np.concatenate([which[~is_odd], which[is_odd]]), []
        for own, ids_of in ((which[~is_odd], self.of_plain), (which[is_odd], self.of_other)):
            for at in range(0, len(own), LINE):
                line = own[at : at + LINE]
                found.append(ids_of(Joined(words.data, words.start[line], words.length[line])))
        count = np.concatenate([c for _, c in found])
        start = len(self.ids) + np.concatenate([[0], np.cumsum(count)[:-1]])
        self.ids = np.concatenate([self.ids, *(i for i, _ in found)])
        merged = np.concatenate([self.keys, keys[order]])
        by_key = np.argsort(merged, kind="stable")
        self.keys = merged[by_key]
        self.second = np.concatenate([self.second, second[order]])[by_key]
        self.start = np.concatenate([self.start, start])[by_key]
        self.count = np.concatenate([self.count, count])[by_key]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin: one more than there are texts)."""
        words = Words(texts)
        if not len(words.start):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        keys = words.hashes()
        second = join_hashes(words.ends(8, last=False), words.ends(8, last=True) + words.length.astype(np.uint64))
        if len(self.keys) > KNOWN_WORDS or len(self.ids) > MOST_IDS:
            self.forget()
        each, first, of_word = np.unique(keys, return_index=True, return_inverse=True)
        new = first[~np.isin(each, self.keys, assume_unique=True)]
        if len(new):
            self.learn(words, new, keys, second)
        at = np.searchsorted(self.keys, each)[of_word]
        if (self.second[at] != second).any():  # two words with one hash
            found = [self.library((x or "").encode()) for x in texts.to_pylist()]
            return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
        count = self.count[at]
        begins = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(self.start[at] - begins[:-1], count) + np.arange(begins[-1])
        return self.ids[place], begins[words.first]


@lru_cache(maxsize=2)
def word_ids(path: str, content: str) -> WordIds:
    return WordIds(content)


PIECES = "piece int, start long, length long, ids_crc32 long, dealt long"


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, dealt`` for every piece; ``with_ids``, also these, little-endian 32-bit.

    ``dealt`` is a number of 62 bits that spreads pieces evenly.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()
    content = docs.sparkSession.sparkContext.broadcast(read(path))  # the driver's file; executors need none
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path, content.value).encode
        seed, count = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for part in slices(batch, most_bytes=PART_BYTES):
                ids, begins = encode(part.column("text"))
                row, place, cut = [], [], []
                for i, (a, b) in enumerate(zip(begins.tolist(), begins[1:].tolist())):
                    whole = ids[a:b].tobytes() + end
                    for at in range(0, len(whole), 4 * length):
                        row.append(i)
                        place.append(at // (4 * length))
                        cut.append(whole[at : at + 4 * length])
                n = len(row)
                columns = {
                    "doc_id": part.column("doc_id").take(pa.array(row, pa.int64())),
                    "piece": pa.array(place, pa.int32()),
                    "start": pa.array([p * length for p in place], pa.int64()),
                    "length": pa.array([len(x) // 4 for x in cut], pa.int64()),
                    "ids_crc32": pa.array(map(zlib.crc32, cut), pa.int64()),
                    "dealt": pa.array(range(seed + count, seed + count + n), pa.int64()),
                }
                count += n
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(cut, pa.binary())} if with_ids else {}))

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECES}" + ", ids binary" * with_ids)
    return out.withColumn("dealt", F.shiftrightunsigned(F.xxhash64("dealt"), 2))


class OpenSequences:
    """Sequences by their remaining capacity; ``put`` finds the one with the least room that is enough."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.width)
        self.with_room = [[] for _ in range(self.width)]
        self.capacity, self.count = capacity, 0

    def _set(self, room: int, has: bool) -> None:
        node = self.width + room
        while node and self.tree[node] != has:
            self.tree[node] = has
            node >>= 1
            has = self.tree[2 * node] or self.tree[2 * node + 1]

    def tightest(self, length: int) -> int:
        """The least remaining capacity of at least ``length``; 0 if there is none."""
        tree, node = self.tree, self.width + length
        while not tree[node]:
            while node & 1:  # a right child: what follows is right of its parent
                node >>= 1
            if node < 2:
                return 0
            node += 1
        while node < self.width:
            node *= 2
            if not tree[node]:
                node += 1
        return node - self.width

    def put(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece; a new sequence is opened if none has the room."""
        room = self.tightest(length)
        if room:
            sequence = self.with_room[room].pop()
            if not self.with_room[room]:
                self._set(room, False)
        else:
            room, sequence = self.capacity, self.count
            self.count += 1
        if room > length:
            if not self.with_room[room - length]:
                self._set(room - length, True)
            self.with_room[room - length].append(sequence)
        return sequence, self.capacity - room


def best_fit_decreasing(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each of ``lengths``, all from 1 to ``capacity``."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_ = OpenSequences(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        sequence[i], offset[i] = open_.put(int(lengths[i]))
    return sequence, offset


def pack(cut: DataFrame, length: int = LENGTH, per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """``cut`` (``length`` up to the parameter, ``dealt``, and more) with ``sequence_id`` and ``offset`` in place of ``dealt``.

    ``cut`` is read twice: give a table. A shard is one group of one task, about ``per_shard`` rows of lengths and keys.
    """
    ship(cut.sparkSession)
    shards = max(1, -(-cut.count() // per_shard))

    def of_shard(group: pa.Table) -> pa.Table:
        group = group.sort_by([("dealt", "ascending")])
        sequence, offset = best_fit_decreasing(group.column("length").to_numpy(), length)
        sequence += group.column("shard")[0].as_py() << 32
        return group.drop_columns(["dealt", "shard"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "dealt")
    return cut.withColumn("shard", F.col("dealt") % shards).groupBy("shard").applyInArrow(of_shard, f"{kept}, sequence_id long, offset long")


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, ids little-endian 32-bit. A sequence is one row of at most ``length`` ids."""
    cut = materialise(pieces(docs, path, length, with_ids=True))
    placed = pack(materialise(cut.drop("ids").withColumn("key", F.col("dealt"))), length).select("key", "sequence_id", "offset")
    parts = cut.join(placed, cut["dealt"] == placed["key"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids"))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    return pack(materialise(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
