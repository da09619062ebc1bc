"""Operator 11, byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens
themselves. The others are merged, lowest rank first and leftmost among equals,
with a heap over linked bytes; a table has the token that two tokens make.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import islice, pairwise
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, text_or_empty

#: Encoded pre-tokens that a worker keeps, none longer than KEPT_CHARS.
KEPT, KEPT_CHARS = 400_000, 64
#: Texts of more code points are split into pre-tokens so many at a time.
LONG, AT_ONCE = 1 << 20, 1 << 16
MASK, GOLDEN = (1 << 64) - 1, 0x9E3779B97F4A7C15
PLACE = (1 << 40) - 1


@dataclass
class PerfectHash:
    """Byte strings to their places in a list without holes: hash and displace.

    A bucket of two keys or more has the first displacement that leads all of
    them to free slots; a bucket of one key has its slot, as a negative number.
    """

    keys: list[bytes]
    moves: list[int]

    @classmethod
    def of(cls, keys: list[bytes]) -> PerfectHash:
        n, buckets = len(keys), max(1, len(keys) // 2)
        grouped: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            grouped[h % buckets].append((key, h))
        slots: list[bytes | None] = [None] * n
        moves = [0] * buckets
        for b in sorted(range(buckets), key=lambda b: -len(grouped[b])):
            group, move = grouped[b], 0
            if len(group) < 2:
                break
            while True:
                places = {_slot(h, move, n) for _, h in group}
                if len(places) == len(group) and all(slots[p] is None for p in places):
                    break
                move += 1
            for key, h in group:
                slots[_slot(h, move, n)] = key
            moves[b] = move
        holes = (p for p, key in enumerate(slots) if key is None)
        for b, group in enumerate(grouped):
            if len(group) == 1:
                p = next(holes)
                slots[p], moves[b] = group[0][0], -p - 1
        return cls([key for key in slots if key is not None], moves)

    def find(self, key: bytes) -> int:
        """The place of key in keys, -1 if it is none of them."""
        h = xxhash.xxh3_64_intdigest(key)
        move = self.moves[h % len(self.moves)]
        p = -move - 1 if move < 0 else _slot(h, move, len(self.keys))
        return p if p < len(self.keys) and self.keys[p] == key else -1


def _slot(h: int, move: int, n: int) -> int:
    return (((h ^ (move * GOLDEN & MASK)) * GOLDEN & MASK) >> 20) % n


@dataclass
class Vocabulary:
    """The tokens of a rank file: by bytes in a perfect hash, by id, and by the two tokens they can be made of."""

    table: PerfectHash
    ids: list[int]  # by place in the table
    tokens: dict[int, bytes]
    pairs: dict[int, int]  # two ids to the id of their bytes together
    single: list[int]  # by byte

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Vocabulary:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing or len(set(ranks.values())) < len(ranks) or max(ranks.values()) >> 20:
            raise ValueError(f"a byte-level vocabulary has every byte, and ids below 2**20, each once; missing bytes: {missing}")
        table = PerfectHash.of(list(ranks))
        pairs = {ranks[t[:k]] << 20 | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        return cls(table, [ranks[key] for key in table.keys], {i: key for key, i in ranks.items()}, pairs, [ranks[bytes([b])] for b in range(256)])

    def encoded(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.table.find(piece)
        return [self.ids[whole]] if whole >= 0 else self.merged(piece)

    def merged(self, piece: bytes) -> list[int]:
        n, made = len(piece), self.pairs.get
        token = list(map(self.single.__getitem__, piece))  # by a token's first byte
        before, after = list(range(-1, n)), list(range(1, n + 1))
        gives = [made(a << 20 | b, -1) for a, b in pairwise(token)]  # what a token and the next one make
        heap = [r << 40 | i for i, r in enumerate(gives) if r >= 0]
        gives.append(-1)
        heapify(heap)
        while heap:
            x = heappop(heap)
            r, i = x >> 40, x & PLACE
            if gives[i] != r:  # one of the two is another by now
                continue
            j = after[i]
            k = after[j]
            token[i], after[i], before[k], gives[j], gives[i] = r, k, i, -1, -1
            if k < n and (x := made(r << 20 | token[k], -1)) >= 0:
                gives[i] = x
                heappush(heap, x << 40 | i)
            h = before[i]
            if h >= 0:
                gives[h] = x = made(token[h] << 20 | r, -1)
                if x >= 0:
                    heappush(heap, x << 40 | h)
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out


class Encoded(dict):
    """Pre-tokens to their ids as little-endian bytes, kept for those seen of late."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = self.vocabulary.encoded(piece.encode())
        found = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = found
        return found


def _pieces(rx: regex.Pattern, text: str) -> Iterator[list[str]]:
    if len(text) <= LONG:
        yield rx.findall(text)
        return
    found = (m.group() for m in rx.finditer(text))
    while some := list(islice(found, AT_ONCE)):
        yield some


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file, a token in base 64 and its id a line; a path with a scheme is read by Spark."""
    if "://" in path:
        lines = spark.read.format("binaryFile").load(path).first()["content"].splitlines()
    else:
        with open(path, "rb") as f:
            lines = f.read().splitlines()
    return {base64.b64decode(token): int(i) for token, i in (x.split() for x in lines if x.strip())}


class Bpe:
    """Column functions of one vocabulary; the vocabulary is bounded by its file and goes to the executors once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = public_tokenizers.PATTERN):
        shared = spark.sparkContext.broadcast(Vocabulary.of(read_ranks(spark, path)))

        @F.arrow_udf("binary")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            rx, known = regex.compile(pattern), Encoded(shared.value)
            for batch in batches:
                yield pa.array((b"".join([b"".join(map(known.__getitem__, some)) for some in _pieces(rx, x.as_py())]) for x in batch), pa.binary())

        @F.arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = shared.value.tokens
            for batch in batches:
                yield pa.array((None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in (x.as_py() for x in batch)), pa.binary())

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        """The ids of a text, each as a little-endian unsigned 32-bit integer."""
        return self._encode(text_or_empty(text))

    def decode(self, ids: Column) -> Column:
        """The bytes that ids as encode() gives them stand for."""
        return self._decode(ids)


def encode_texts(docs: DataFrame, bpe: Bpe, *, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with a column `to`: the ids of its whole text, packed as Bpe.encode() says.

    Each match of the pattern is encoded on its own, and text like a special
    token as plain text. Null texts count as empty, and empty ones have no ids.
    Repeated rows stay, each with its ids. A pre-token of any length is merged in
    n log n steps. A column named like `to` in any case is replaced; others stay.
    Empty tables stay empty.
    """
    return docs.select(*[F.col(f"`{c}`") for c in others(docs, to)], bpe.encode(F.col(f"`{text}`")).alias(to))


def decode_texts(df: DataFrame, bpe: Bpe, *, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with a column `to`: the bytes of its ids, null where these are null; an id that the vocabulary lacks fails."""
    return df.select(*[F.col(f"`{c}`") for c in others(df, to)], bpe.decode(F.col(f"`{ids}`")).alias(to))
