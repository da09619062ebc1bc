"""Operator 12, phrase collocation mining over sorted count streams.

Phrases are counted order by order. A phrase is as frequent as its two parts of
one word less at most, so an order counts only where both parts may be frequent,
which a bitmap of bounded size tells. The counts then lie in two streams, in the
order of first parts (prefix order) and of last parts (suffix order); sort-merge
joins read them in lockstep with the stream of all counts for the left and right
counts and for those of extensions, without a hash table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Words of the longest phrase, least count of a candidate, phrases returned a language.
ORDERS, LEAST, TOP = 5, 100, 2000
#: A candidate goes if an extension has so many percent of its count.
COVERED = 100
#: The bitmap has 16 bits for each frequent phrase, and 2**27 (16 MB) at most: then more is counted that turns out rare.
BITS_EACH, MOST_BITS, BLOCK = 16, 1 << 27, 1 << 15
#: Bytes of text that are counted at once.
CHUNK = 1 << 21
WORD_BYTE, BLANK, END = 0, 1, 2
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = BLANK
KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = END
LAST_END = re.compile(rb"[.,;:!?\n-\r][^.,;:!?\n-\r]*\Z")
SEPARATOR = re.compile(rb"[ \t.,;:!?\n-\r]")


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    x = (h ^ (word + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _parts(text: bytes, carry: int) -> Iterator[bytes]:
    """A text in parts of about CHUNK bytes, cut between words; a part begins with the last `carry` words of a piece that goes on."""
    head, begin = b"", 0
    while len(text) - begin > CHUNK:
        at = max(text.rfind(x, begin, begin + CHUNK) for x in (b" ", b"\t", b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r"))
        if at <= begin:
            found = SEPARATOR.search(text, begin + CHUNK)
            if not found:
                break
            at = found.start()
        part, begin = head + text[begin : at + 1], at + 1
        yield part
        last = LAST_END.search(part)
        open_piece = (part[last.start() + 1 :] if last else part).replace(b"\t", b" ").split(b" ")
        words = [w for w in open_piece if w]
        head = b" ".join(words[-carry:]) + b" " if carry and words else b""
    yield head + text[begin:]


def _chunks(batches: Iterator[pa.RecordBatch], carry: int) -> Iterator[tuple[bytes, list[str], list[int]]]:
    """Lower-cased texts joined by line breaks, with each one's language and length, about CHUNK bytes at a time."""
    parts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            for part in _parts(text.as_buffer().to_pybytes().lower(), carry):
                parts.append(part)
                langs.append(lang.as_py())
                size += len(part)
                if size >= CHUNK:
                    yield b"\n".join(parts), langs, [len(x) + 1 for x in parts]
                    parts, langs, size = [], [], 0
    if parts:
        yield b"\n".join(parts), langs, [len(x) + 1 for x in parts]


def _counter(order: int, bits: Broadcast | None):
    """Counts of the phrases of `order` words in each chunk, where both parts of one word less have their bit set."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, langs, sizes in _chunks(batches, order - 1):
            kind = KINDS[np.frombuffer(data, np.uint8)]
            inside = kind == WORD_BYTE
            edge = np.diff(inside.view(np.int8), prepend=0, append=0)
            start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            n = len(start) - order + 1
            if n <= 0:
                continue
            offsets = np.concatenate([[0], np.cumsum(stop - start)])
            raw = np.frombuffer(data, np.uint8)[inside]
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
            ids = words.indices.to_numpy()
            names, name = np.unique(langs, return_inverse=True)
            lang = name[np.searchsorted(np.cumsum(sizes), start, side="right")]
            if order == 1:
                at = np.arange(n)
            else:
                piece = np.cumsum(kind == END, dtype=np.int32)[start]
                own, parts = _hashes(words.dictionary.to_pylist())[ids], len(start) - order + 2
                h = _mixed(_hashes([x.encode() for x in names])[lang[:parts]], own[:parts])
                for k in range(1, order - 1):
                    h = _mixed(h, own[k : k + parts])
                h &= np.uint64(len(bits.value) * 8 - 1)
                alive = (np.frombuffer(bits.value, np.uint8)[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1
                at = np.flatnonzero((piece[:n] == piece[order - 1 :]) & (alive[:-1] & alive[1:]).astype(bool))
            if not len(at):
                continue
            dictionary = words.dictionary
            phrase = pc.binary_join_element_wise(*[dictionary.take(pa.array(ids[at + k])) for k in range(order)], pa.scalar(b" ", pa.large_binary())) if order > 1 else dictionary.take(pa.array(ids))
            found = pa.table({"lang": pa.array(lang[at].astype(np.int32)), "phrase": phrase}).group_by(["lang", "phrase"]).aggregate([([], "count_all")])
            columns = [pa.array(names.tolist(), pa.string()).take(found["lang"].combine_chunks()), found["phrase"].combine_chunks().cast(pa.binary()).cast(pa.string()), found["count_all"].combine_chunks()]
            yield from pa.Table.from_arrays(columns, names=["lang", "phrase", "f"]).to_batches(max_chunksize=100_000)

    return counted


def _bitmap(grams: DataFrame) -> Broadcast:
    """A bit for each phrase, in a broadcast of MOST_BITS bits at most; it is put together block by block on the executors."""
    spark, n = grams.sparkSession, grams.count()
    bits = min(MOST_BITS, max(BLOCK, 1 << (n * BITS_EACH - 1).bit_length() if n else BLOCK))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _hashes([x.encode() for x in batch.column(0).to_pylist()])
            words = [x.encode().split(b" ") for x in batch.column(1).to_pylist()]
            for k in range(len(words[0]) if words else 0):
                h = _mixed(h, _hashes([w[k] for w in words]))
            p = h & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((p // BLOCK).astype(np.int32)), pa.array((p % BLOCK).astype(np.int32))], names=["block", "place"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for places in batch.column(1):
                flags = np.zeros(BLOCK, np.uint8)
                flags[places.values.to_numpy()] = 1
                made.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["block", "bits"])

    found = grams.select("lang", "phrase").mapInArrow(places, "block int, place int").groupBy("block").agg(F.collect_set("place").alias("places"))
    whole = bytearray(bits // 8)
    for r in found.mapInArrow(blocks, "block int, bits binary").toLocalIterator():
        whole[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = r["bits"]
    return spark.sparkContext.broadcast(bytes(whole))


def count_phrases(texts: DataFrame, orders: int = ORDERS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Of a table (lang, text): the phrases with a count of `least` or more as (lang, phrase, size, f), and all words a language as (lang, n)."""
    kind = "lang string, phrase string, f long"
    kept, bits = [], None
    for order in range(1, orders + 1):
        sums = texts.mapInArrow(_counter(order, bits), kind).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        if order == 1:
            words = cut(sums, "words")
            total = cut(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
            kept.append(cut(words.where(F.col("f") >= least).withColumn("size", F.lit(order)), "grams"))
        else:
            kept.append(cut(sums.where(F.col("f") >= least).withColumn("size", F.lit(order)), "grams"))
        if bits:
            bits.unpersist()
        if order < orders:
            bits = _bitmap(kept[-1])
    return reduce(DataFrame.unionByName, kept), total


def _words(first: Column | int, n: Column) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) with exact products; it is 10 n or less, as a is no more than l and r."""
    wide = [c.cast("decimal(19,0)") for c in (a, n, left, right)]
    return F.call_function("div", (wide[0] * 1000 * wide[1]).cast("decimal(38,0)"), (wide[2] * wide[3]).cast("decimal(38,0)"))


def mine_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", orders: int = ORDERS, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """The best phrases a language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; phrases lie inside pieces between `.,;:!?` and line ends.
    A phrase's score is that of its worst cut, the first among equals. A phrase
    goes if a longer candidate that holds its words has `covered` percent of its
    count; it is enough to look at those of one word more, as the ones between
    are at least as frequent as the longer one. Rank goes by score, count and
    bytes of the phrase, so there are no ties. A null language is `und`, as is
    one of that name; null and empty texts have no words; texts of any length
    are counted in parts that share the words of an open piece. Repeated rows
    count as often as they stand there. Empty tables give no rows. Other columns
    don't matter. A language or phrase of most rows is summed before it is
    exchanged.
    """
    named = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    grams, total = count_phrases(named, orders, least)
    counts = grams.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    words = grams.where("size > 1").select("lang", "phrase", "size", "f", F.split("phrase", " ").alias("words"))
    # extensions by one word: the longer phrase under its first and under its last words
    longer = words.where("size > 2").select("lang", "f", F.explode(F.array(_words(1, F.col("size") - 1), _words(2, F.col("size") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    words = words.join(longer.hint("merge"), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("f"), F.lit(True)))
    cuts = words.select("lang", "phrase", F.col("f").alias("a"), "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(1, F.col("k")).alias("head"), _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    prefix = counts.select("lang", F.col("part").alias("head"), F.col("part_f").alias("l"))
    suffix = counts.select("lang", F.col("part").alias("tail"), F.col("part_f").alias("r"))
    both = cuts.join(prefix.hint("merge"), ["lang", "head"]).join(suffix.hint("merge"), ["lang", "tail"]).join(total, "lang")
    scored = both.select("lang", "phrase", "a", "k", "l", "r", "n", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    worst = worst.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    ranked = worst.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
