"""BPE encoding and decoding with a byte-level vocabulary file in the tokenizers format.

Merging works on a segment tree over the ranks of adjacent pairs: its root holds the lowest rank and, among equals,
the leftmost place; a merge updates three leaves in logarithmic time, until no pair has a rank. A text falls apart
into pieces by the pattern first, and the ids of the pieces seen last are kept in a bounded cache, which a task lets go at its end.

Null and empty texts: no ids, and no ids decode to the empty text. Texts of any length are encoded whole, a piece of a
long one too. Of equal ranks the leftmost pair merges first. Repeated rows have a row each; an empty table gives no rows. Special tokens written in a text get their own id, as the tokenizers library does.
Extra columns pass through ``encode`` and ``decode``; an existing column of the output's name is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import map_batches, ship
from .text import slices

#: Fixed value: the byte-level split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NO_RANK = 1 << 62
CACHED_PIECES = 300_000
LONGEST_CACHED = 64
PART_BYTES = 1 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pieces(dict):
    """Piece of text -> its ids as little-endian 32-bit integers; two generations bound the memory."""

    def __init__(self, codec: Codec):
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(self.codec.merge(piece.encode()), "<u4").tobytes()
            if len(piece) > LONGEST_CACHED:
                return ids
        if len(self) >= CACHED_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def forget(self) -> None:
        """Workers outlive their tasks, and other stages need the memory."""
        self.older = {}
        self.clear()


class Codec:
    def __init__(self, content: str):
        spec = json.loads(content)
        letters = byte_letters()
        model = spec["model"]
        to_bytes = lambda token: bytes(letters[c] for c in token)
        vocabulary = {to_bytes(k): v for k, v in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for content_, at in chain(vocabulary.items(), ((k.encode(), v) for k, v in self.special.items())):
            self.token[at] = content_
        self.byte_id = [vocabulary[bytes([b])] for b in range(256)]
        self.rank: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            left, right = to_bytes(left), to_bytes(right)
            self.rank[vocabulary[left] << 32 | vocabulary[right]] = (rank, vocabulary[left + right])
        self.split = regex.compile(PATTERN).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = Pieces(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. Leaf i of the tree holds rank << 32 | i of the pair that begins at symbol i."""
        byte_id, pair_rank = self.byte_id, self.rank
        symbol = [byte_id[b] for b in piece]
        n = len(symbol)
        if n < 2:
            return symbol
        width = 1 << (n - 2).bit_length()
        tree = [NO_RANK] * (2 * width)
        merged = [0] * n
        for i in range(n - 1):
            found = pair_rank.get(symbol[i] << 32 | symbol[i + 1])
            if found:
                tree[width + i] = found[0] << 32 | i
                merged[i] = found[1]
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while (best := tree[1]) != NO_RANK:
            i = best & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            symbol[i] = new = merged[i]
            symbol[j] = -1
            after[i] = k
            changed = [(j, NO_RANK), (i, NO_RANK)] if j < width else [(i, NO_RANK)]
            if k < n:
                before[k] = i
                found = pair_rank.get(new << 32 | symbol[k])
                if found:
                    changed[-1] = (i, found[0] << 32 | i)
                    merged[i] = found[1]
            if (p := before[i]) >= 0:
                found = pair_rank.get(symbol[p] << 32 | new)
                if found:
                    changed.append((p, found[0] << 32 | p))
                    merged[p] = found[1]
                else:
                    changed.append((p, NO_RANK))
            for leaf, value in changed:
                node = width + leaf
                if tree[node] == value:
                    continue
                tree[node] = value
                while node > 1:
                    node >>= 1
                    a, b = tree[2 * node], tree[2 * node + 1]
                    low = a if a < b else b
                    if tree[node] == low:
                        break
                    tree[node] = low
        return [s for s in symbol if s >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        ids = self.pieces.__getitem__
        if self.special_split is None or not any(s in text for s in self.special):
            return b"".join(map(ids, self.split(text)))
        out = []
        for part in self.special_split.split(text):
            at = self.special.get(part)
            out.append(b"".join(map(ids, self.split(part))) if at is None else np.uint32(at).astype("<u4").tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        content = b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return content.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, content: str | None = None) -> Codec:
    """One codec per Python worker, from the file or from its ``content``."""
    return Codec(content if content is not None else read(path))


def read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(df: DataFrame, source: str, new: list[tuple[str, str]], each) -> DataFrame:
    """``df`` with columns computed from another in batches of bounded size; ``each()`` gives value -> values, and what a task does at its end."""
    names = [n for n, _ in new]
    if source in names:
        raise ValueError("the new columns need names of their own")
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in names))
    kinds = [pa.binary() if k == "binary" else pa.string() for _, k in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply, end = each()
        try:
            for batch in batches:
                for part in slices(batch, source, PART_BYTES):
                    values = [apply(x) for x in part.column(source).to_pylist()]
                    columns = [pa.array([v[i] for v in values], k) for i, k in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *names])
        finally:
            end()

    return map_batches(df, run, ", ".join(f"`{n}` {k}" for n, k in new))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids``: binary, little-endian unsigned 32-bit integers. Null text: no ids.

    With ``decoded``, also a column of that name with what the ids decode to, by the same worker.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()
    content = docs.sparkSession.sparkContext.broadcast(read(path))  # the driver's file; executors need none

    def each():
        c = codec(path, content.value)

        def both(x: str | None) -> tuple:
            out = c.encode(x or "")
            return (out, c.decode(out)) if decoded else (out,)

        return both, c.pieces.forget

    return _mapped(docs, text, [(ids, "binary"), *([(decoded, "string")] if decoded else [])], each)


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``tokens`` with the text that their ids stand for, special tokens included. Null ids: empty text."""
    ship(tokens.sparkSession)
    path = path or vocabulary_path()
    content = tokens.sparkSession.sparkContext.broadcast(read(path))

    def each():
        c = codec(path, content.value)
        return lambda x: (c.decode(x or b""),), c.pieces.forget

    return _mapped(tokens, ids, [(decoded, "string")], each)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, decoded="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
