"""Operator 10, sharding by histogram sort: equal bytes a shard."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, others, text_or_empty

#: Low bits of a key that come from the document; the others come from the text.
OWN_BITS = 24
#: Key bits counted in the first round and in each later one.
FIRST, NEXT = 12, 6


def _key(text: Column, doc_id: Column) -> Column:
    low = (1 << OWN_BITS) - 1
    return F.xxhash64(text).bitwiseAND(F.lit(-1 - low)).bitwiseOR(F.xxhash64(F.lit(1), doc_id.cast("string")).bitwiseAND(F.lit(low)))


def splitters(keys: DataFrame, parts: int, per_shard: int, tolerance: float = 0.01) -> list[int]:
    """parts - 1 key boundaries that share the bytes of keys (key, size) out evenly.

    Each round counts the bytes in the bins next to the open boundaries only; a
    boundary closes when a bin's edge is near enough: `tolerance` of a shard at
    the boundaries of shards, a quarter of a part at those inside a shard. The
    driver sees at most 2 ** FIRST bins, then parts * 2 ** NEXT of them a round.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    found: dict[int, int] = {}
    # open boundary -> (bin it lies in, None at first; bytes below that bin)
    open_: dict[int, tuple[int | None, int]] = {j: (None, 0) for j in range(1, parts)}
    bits = 0
    while open_:
        step = min(FIRST if not bits else NEXT, 64 - bits)
        shift = 64 - bits - step
        rows = keys
        if bits:
            rows = keys.where(F.shiftright("key", 64 - bits).isin(sorted({b for b, _ in open_.values()})))
        counts = rows.groupBy(F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("bytes")).collect()
        bits += step
        bins: dict[int | None, list[tuple[int, int]]] = {}
        for r in sorted((r["bin"], r["bytes"]) for r in counts):
            bins.setdefault(r[0] >> step if bits > FIRST else None, []).append(r)
        still = {}
        for j, (inside, below) in open_.items():
            mine = bins.get(inside, [])
            ends = [below, *(below + x for x in accumulate(b for _, b in mine))]
            goal = total * j / parts
            k = min(max(bisect_right(ends, goal) - 1, 0), max(len(mine) - 1, 0))
            near = tolerance * total * per_shard / parts if j % per_shard == 0 else total / parts / 4
            edges = [(abs(ends[k] - goal), mine[k][0] << shift)] if mine else [(0, 0)]
            if mine:
                edges.append((abs(ends[k + 1] - goal), (mine[k][0] + 1) << shift))
            best = min(edges)
            if best[0] <= near or not shift:
                found[j] = min(best[1], 2**63 - 1)
            else:
                still[j] = (mine[k][0], ends[k])
        open_ = still
    return list(accumulate((found[j] for j in sorted(found)), max))


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most key, by halving steps."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    at = F.lit(bounds)
    return F.aggregate(F.lit(steps), F.lit(0), lambda n, p: F.when((n + p <= len(bounds)) & (at[F.least(n + p, F.lit(len(bounds))) - 1] <= key), n + p).otherwise(n))


def shard(docs: DataFrame, shards: int = 40, *, part_bytes: int = 256 << 20, most_parts: int = 512, text: str = "text", doc_id: str = "doc_id", to: str = "shard") -> DataFrame:
    """docs with one struct column `to`: size, text_crc32, law, shard, slot, grown_shard; sorted by key in each part of a shard.

    The law is `bytes`. The key of a document is a hash of its text, then of its
    id, so equal texts lie together and are only parted where a shard's boundary
    would otherwise miss its bytes by over 1 %. Boundaries come from refined
    histograms of exact bytes; then the rows are exchanged once, into ranges of about
    `part_bytes`, at most `most_parts` a shard, so no task sorts a whole large
    shard. slot counts a shard's rows from 0 in the order of its ranges.

    Null text has size 16 and counts as empty. A null id is an id. Rows alike in
    id and text, null ids included, have one key and stay together, so such a
    group of over a shard's bytes makes its shard as large. Texts of any length
    are whole. With fewer rows than shards some shards are empty; empty tables
    give an empty result. Other columns pass through; `to` replaces one of its name.
    """
    kept = [F.col(f"`{c}`") for c in others(docs, to)]
    d = docs.select(*kept)
    key, size, crc, part = (free_name(d, c) for c in ("_key", "_size", "_crc", "_part"))
    t = text_or_empty(F.col(text))
    d = d.withColumns({key: _key(t, F.col(doc_id)), size: (F.octet_length(t) + 16).cast("long"), crc: F.crc32(t.cast("binary"))})
    keys = cut(d.select(F.col(key).alias("key"), F.col(size).alias("size")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = min(max(-(-total // (shards * part_bytes)), 1), most_parts)
    bounds = splitters(keys, shards * parts, parts)
    counts = {r["part"]: r["count"] for r in keys.groupBy(_place(F.col("key"), bounds).alias("part")).count().collect()}
    starts = []
    for p in range(shards * parts):
        starts.append(starts[-1] + counts.get(p - 1, 0) if p % parts else 0)
    d = d.withColumn(part, _place(F.col(key), bounds))
    slot = F.lit([int(x) for x in starts])[F.col(part)] + F.row_number().over(Window.partitionBy(part).orderBy(key, doc_id, size)) - 1
    return d.select(*kept, F.struct(
        F.col(size).alias("size"), F.col(crc).alias("text_crc32"), F.lit("bytes").alias("law"), F.floor(F.col(part) / parts).cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    ).alias(to))
