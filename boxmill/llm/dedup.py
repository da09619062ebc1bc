"""Operator 2, MinHash near-dedup.

Exact copies share a class. Each class has minima of universal hashes over its
word shingles; bands of minima give candidates, signatures discard the weak
ones, full shingle sets confirm the links, and alternating stars connect them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, broadcast_below, cut, cut_alone, dropped, free_name, text_key, text_or_empty
from .components import components

SHINGLE = 5
BANDS, ROWS = 32, 4
PERCENT = 75
#: Estimated similarity below which a pair isn't confirmed: five standard errors under the threshold.
LEAST_ESTIMATE = 0.55
#: Rounds in which each bucket has one hub; each round draws another.
HUB_ROUNDS = 3
#: Parts in a key, keys a member gives beyond its spare parts, members of a key beyond which they are a group of
#: their own, levels of groups, and rows of one key that stay in one task.
MOST_PARTS, ROOM, MANY, LEVELS, SALTED = 6, 16, 16, 2, 500
#: Marks a shingle of the centre that a member lacks.
LACKS = 0x5DEECE66D1234567

_draw = np.random.default_rng(20240501)
_MUL = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_PLACE = _draw.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OF_SIZE = _draw.integers(0, 2**63, SHINGLE + 1, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(tokens: list[bytes], hashes: WordHash) -> np.ndarray:
    """The sorted distinct shingle hashes; one hash of the whole sequence if it is shorter than a shingle."""
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    size = min(SHINGLE, len(tokens))
    total = np.full(len(w) - size + 1, _OF_SIZE[size], np.uint64)
    for j in range(size):
        total += w[j : len(w) - size + 1 + j] * _PLACE[j]
    return np.unique(_mixed(total))


def _tokens(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only: A-Z, and white space as the contract has it."""
    return (text or "").encode().lower().split()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at = 0
        while at < len(ids):
            sets, digests, held = [], [], 0
            first = at
            while at < len(ids) and held < 150_000:
                tokens = _tokens(texts[at].as_py())
                sets.append(shingle_set(tokens, hashes))
                digests.append(xxhash.xxh3_128_digest(b" ".join(tokens)))
                held += len(sets[-1])
                at += 1
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            bands, marks = [None] * len(sets), [None] * len(sets)
            if len(full):
                x = np.concatenate([sets[i] for i in full])
                starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                least, room = np.empty((BANDS * ROWS, len(full)), np.uint64), np.empty_like(x)
                for k in range(BANDS * ROWS):
                    np.multiply(x, _MUL[k], out=room)
                    np.add(room, _ADD[k], out=room)
                    np.minimum.reduceat(room, starts, out=least[k])
                least >>= np.uint64(32)
                by_band = least.reshape(BANDS, ROWS, -1)
                keys = np.zeros((BANDS, len(full)), np.uint64)
                for r in range(ROWS):
                    keys = _mixed(keys + by_band[:, r] * _PLACE[r] + np.arange(BANDS, dtype=np.uint64)[:, None])
                keys, small = keys.T.astype(np.int64), (least & np.uint64(255)).astype(np.uint8).T.copy()
                for j, i in enumerate(full):
                    bands[i], marks[i] = keys[j], small[j].tobytes()
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, at - first), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["doc_id", "d1", "d2", "n_shingles", "bands", "marks"],
            )


def _similar_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose signatures agree enough."""
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("marks_a", "marks_b"))
            ok = (a == b).mean(axis=1) >= LEAST_ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(ok))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs of texts whose full shingle sets are similar enough."""
    hashes, last, left = WordHash(), None, None
    for batch in batches:
        ok = []
        for a, x, y in zip(*(batch.column(c) for c in ("a", "text_a", "text_b")), strict=True):
            key = (a.as_py(), hash(x.as_py()))
            if key != last:
                last, left = key, shingle_set(_tokens(x.as_py()), hashes)
            right = shingle_set(_tokens(y.as_py()), hashes)
            both = len(np.intersect1d(left, right, assume_unique=True))
            ok.append(both > 0 and 100 * both >= PERCENT * (len(left) + len(right) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            sets = [shingle_set(_tokens(t.as_py()), hashes).view(np.int64) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])


def _band(excess: Column) -> Column:
    """0 up to the distance of a link, then bands whose ends grow by half."""
    return F.when(excess <= 0, 0).otherwise(1 + F.greatest(F.lit(0), F.floor(F.log(1.5, excess / (100 + PERCENT))))).cast("int")


def _band_start(band: int) -> int:
    """At most the least excess of a band."""
    return 0 if band < 2 else int((100 + PERCENT) * 1.5 ** (band - 1)) - 1


def _least_need(excess: Column, least: Column) -> Column:
    """Parts that a link of a member shares at least, over all partners that are not linked for certain."""
    both = F.when(excess + least > 0, excess + least).otherwise(excess - least + 1)
    return F.greatest(F.lit(1), F.ceil(both / (2 * (100 + PERCENT)))).cast("int")


def _depth(spare: int, need: int, room: int) -> int:
    """How many shared parts a key holds: as many as give at most `room` keys."""
    deep = 1
    while deep < min(MOST_PARTS, need) and comb(spare + deep + 1, deep + 1) <= room:
        deep += 1
    return deep


def _part_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, own, rep, root): hashes, the group's too, of all `deep` parts that a link must share among a member's first ones.

    The parts that a link must share follow from both excesses, so a member has
    keys for each band of partners that its group holds. `own` keys have as many
    parts as the member can give; it also gives shallower ones, for members that
    cannot give as many.
    """
    twice = 2 * (100 + PERCENT)
    names = ("grp", "rep", "root", "excess", "band", "least", "bands", "n_parts", "parts")
    for batch in batches:
        rows_of, held = [], 0
        for g, rep, root, excess, band, least, bands, n_parts, parts in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            every = np.array(parts, np.int64).view(np.uint64)
            keys, own = [], []
            for other in bands:
                need = max(1, -(-(excess + (_band_start(other) if other else least)) // twice))
                spare = n_parts - need
                if spare < 0:
                    continue
                deepest = _depth(spare, need, ROOM)
                tag = np.uint64((g * 2**20 + min(band, other) * 2**10 + max(band, other)) & (2**64 - 1))
                for deep in range(1, deepest + 1):
                    first = every[: spare + deep]
                    rows = first[:, None] if deep == 1 else np.array(list(combinations(first, deep)), np.uint64)
                    keys.append(_mixed(_mixed(rows).sum(axis=1, dtype=np.uint64) + np.uint64(deep) + _mixed(tag[None])).view(np.int64))
                    own.append(np.full(len(rows), deep == deepest))
            if keys:
                k = np.concatenate(keys)
                rows_of.append((k, np.concatenate(own), np.full(len(k), rep), np.full(len(k), root)))
                held += len(k)
            if held > 100_000:
                yield _key_batch(rows_of)
                rows_of, held = [], 0
        if rows_of:
            yield _key_batch(rows_of)


def _key_batch(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["key", "own", "rep", "root"])


def _kept_keys(keys: DataFrame) -> DataFrame:
    """keys with m, their number of members: those that several roots hold, and of keys with the same members one.

    Near copies share many parts, each of which would be a key and a smaller group of the same members.
    """
    # sums of 40 bits, as an id of several texts can hold a key twice
    same = [F.sum(F.shiftright(F.xxhash64(F.lit(i), "rep", "own"), 24)).alias(f"of{i}") for i in range(3)]
    held = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("own").alias("any"), *same)
    once = held.where("lo < hi and any").groupBy("m", "of0", "of1", "of2").agg(F.min("key").alias("key"))
    return keys.join(once.select("key", "m"), "key")


def _small_keys(keys: DataFrame) -> DataFrame:
    """(a, b): the members of a key that belong to different roots; the most frequent root never meets itself."""
    roots = keys.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"))
    met = keys.join(roots, "key")
    x, y = met.where("root <> major").alias("x"), met.alias("y")
    once = (F.col("y.root") == F.col("y.major")) | (F.col("x.rep") < F.col("y.rep"))
    fits = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once & (F.col("x.own") | F.col("y.own"))
    return x.join(y, fits).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _exact_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs among which are all links between members (grp, rep, root) of one group and different roots.

    A group has a centre, the shingles of most members. Two sets differ where
    their differences from the centre do, so links share so many parts of these
    that they share `deep` of their first ones, from rare to frequent. What all
    members have in common is no part, so near copies that are no links rarely
    meet. Keys that are still held by many members are the next level's groups.
    """
    out = None
    sets = sets.withColumns({"size": F.size("shingles").cast("long"), "alone": F.lit(0)})
    for level in range(LEVELS):
        held = members.groupBy("grp").agg(F.count("*").alias("n"))
        held = broadcast_below(cut(held.where("n > 1"), "groups"), 1_000_000)
        turns, central = F.floor(F.col("n") / SALTED).cast("int"), 2 * F.col("c") > F.col("n")
        rows = members.join(held, "grp").join(sets, "rep")
        each = rows.select("grp", "n", "sid", F.explode("shingles").alias("s"))
        shared = cut(each.groupBy("grp", "s").agg(F.count("*").alias("c"), F.any_value("n").alias("n")).where("c > 1"), "shared")
        centres = shared.where(central).groupBy("grp").agg(F.collect_list("s").alias("centre"), F.any_value("n").alias("n"))
        centres = centres.select("grp", "centre", F.explode(F.sequence(F.lit(0), turns)).alias("turn"))
        apart = rows.select("grp", "sid", "rep", "root", "n", "size", "alone", "shingles", F.pmod(F.xxhash64("rep"), turns + 1).cast("int").alias("turn"))
        apart = apart.join(centres, ["grp", "turn"], "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<long>")))
        apart = apart.select("grp", "sid", "rep", "root", "n", "size", "alone", F.array_except("shingles", "centre").alias("beside"), F.array_except("centre", "shingles").alias("lacks"))
        apart = cut(apart, "beside")
        # only what is outside the centre is looked up, and only where two of a group can share it and still be no majority
        mine = apart.where("n >= 4").select("grp", "sid", F.explode("beside").alias("s")).join(shared.where(~central).drop("n"), ["grp", "s"])
        mine = mine.groupBy("grp", "sid").agg(F.collect_list(F.struct("c", F.col("s").alias("part"))).alias("own"))
        apart = apart.join(mine, ["grp", "sid"], "left")
        apart_by = F.col("alone") + F.size("beside") + F.size("lacks")
        excess = (100 + PERCENT) * apart_by - (100 - PERCENT) * F.col("size")
        # any order of the parts that all members of a group share is right; rare parts first is fast
        lacks = F.transform("lacks", lambda x: F.struct(F.floor(F.col("n") / 8).alias("c"), x.bitwiseXOR(F.lit(LACKS)).alias("part")))
        parts = F.sort_array(F.concat(F.coalesce("own", F.array().cast("array<struct<c: long, part: long>>")), lacks))
        apart = cut(apart.select("grp", "rep", "sid", "root", "size", (apart_by - F.size(parts)).alias("alone"), excess.alias("excess"), _band(excess).alias("band"), F.transform(parts, lambda x: x["part"]).alias("parts")), "differences")

        nearest = apart.groupBy("grp").agg(F.min(F.struct("excess", "rep", "root")).alias("least"), F.collect_set("band").alias("bands"))
        nearest = broadcast_below(cut(nearest.select("grp", F.col("least.excess").alias("least"), F.col("least.rep").alias("hub"), F.col("least.root").alias("hub_root"), "bands"), "nearest"), 1_000_000)
        sure = apart.join(nearest, "grp").where((F.col("excess") + F.col("least") <= 0) & (F.col("root") != F.col("hub_root")))
        found = sure.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))

        need = _least_need(F.col("excess"), F.col("least"))
        able = apart.join(nearest, "grp").where(F.size("parts") >= need)
        first = F.slice("parts", 1, F.size("parts") - need + MOST_PARTS)
        keys = able.select("grp", "rep", "root", "excess", "band", "least", "bands", F.size("parts").alias("n_parts"), first.alias("parts")).mapInArrow(_part_keys, "key long, own boolean, rep long, root long")
        keys = cut(_kept_keys(keys), "part-keys")
        last = level == LEVELS - 1
        found = found.unionByName(_small_keys(keys if last else keys.where(F.col("m") <= MANY)))
        out = found if out is None else out.unionByName(found)
        if last:
            break
        # a smaller group needs only what told its members from the larger one's centre
        sets = apart.select("rep", "sid", "size", "alone", F.col("parts").alias("shingles"))
        members = keys.where(F.col("m") > MANY).select(F.col("key").alias("grp"), "rep", "root").distinct()
        if members.isEmpty():
            break
    return out.distinct()


def _beside(pairs: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """pairs (a, b), written, with value_a and value_b of the rows whose key is that side; a side of many pairs is dealt out."""
    out = pairs
    for side, other in (("a", "b"), ("b", "a")):
        # counted on the pairs alone, not on what the other side has brought
        n = pairs.groupBy(side).agg(F.floor(F.count("*") / SALTED).cast("int").alias("turns"))
        n = broadcast_below(cut(n, "sides"), 2_000_000)
        dealt = rows.select(F.col(key).alias(side), F.col(value).alias(f"{value}_{side}")).join(n, side).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns")))).drop("turns")
        out = out.join(n, side).withColumn("turn", F.pmod(F.xxhash64(other), F.col("turns") + 1).cast("int")).drop("turns").join(dealt, [side, "turn"]).drop("turn")
    return out


def _links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets confirm them; docs: (doc_id, text)."""
    pairs = cut(pairs, "pairs")
    both = _beside(pairs, docs, "doc_id", "text")
    return both.mapInArrow(_confirmed, "a long, b long").distinct()


def _near(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs of ids whose sizes and signatures allow the similarity."""
    for side in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("rep").alias(side), F.col("marks").alias(f"marks_{side}"), F.col("n_shingles").alias(f"n_{side}")), side)
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return pairs.select("a", "b", "marks_a", "marks_b").mapInArrow(_similar_marks, "a long, b long")


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(bucket, rep, root) of the members of buckets, dealt by bucket once for all that is asked of buckets."""
    if roots is None:
        rooted = members.select("bucket", "rep", F.col("rep").alias("root"))
    else:
        rooted = members.join(roots, members["rep"] == roots["node"], "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    return rooted.repartition("bucket")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after links join components: only the roots' own links go through the rounds of stars."""
    if roots is None:
        return components(links, "a", "b")
    for side in ("a", "b"):
        at = roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        links = links.join(at, side, "left").withColumn(side, F.coalesce(f"r{side}", side)).drop(f"r{side}")
    new = components(links, "a", "b")
    old = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    alone = new.join(roots.select("node"), "node", "left_anti")
    return old.unionByName(alone)


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, k1, k2 (hashes of the text), n_shingles, component_id, kept.

    Documents are linked if 100 * |A and B| >= 75 * |A or B| of their sets of
    5-word shingles (A-Z lowered; the whole sequence if shorter). component_id is
    the smallest id reachable, kept is doc_id = component_id. Exact copies are
    one class and are never paired. In each round the classes of a band's bucket
    are compared with one drawn hub, unless they are in its component already;
    rounds end when none finds a link. The classes of buckets that then still
    hold several components are joined exactly by what tells them from a centre, so
    no link inside a bucket is lost. With 32 bands of 4 a pair at the threshold
    shares no bucket with probability 5e-6.

    Null or wordless text: n_shingles 0, linked with nothing. Null ids: linked
    with nothing, component_id null, kept. Repeated rows share their component;
    rows that share an id share a component if their texts' classes have that id
    as smallest one. Empty tables give an empty result. Other columns don't matter.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(F.col(text)).alias("text"))
    keys = d.select(F.struct("doc_id", *[k.alias(f"k{i}") for i, k in enumerate(text_key(F.col("text")), 1)]).alias("doc_id"), "text")
    signed = keys.mapInArrow(_signed, "doc_id struct<doc_id: long, k1: long, k2: long>, d1 long, d2 long, n_shingles long, bands array<long>, marks binary")
    signed = cut(signed.select("doc_id.*", "d1", "d2", "n_shingles", "bands", "marks"), "signed")

    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = cut(linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("marks").alias("marks"), F.any_value("n_shingles").alias("n_shingles")), "classes")
    at = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = at.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut(at.join(shared, "bucket"), "members")
    # the bands, most of both tables, have done their work
    signed, classes = dropped(signed, "bands", "marks"), dropped(classes, "bands")

    marks = classes.select("rep", "marks", "n_shingles")
    roots = None
    for turn in range(HUB_ROUNDS):
        rooted = _rooted(members, roots)
        hubs = rooted.groupBy("bucket").agg(F.min_by(F.struct("rep", "root"), F.struct(F.xxhash64(F.lit(turn), "rep"), "rep")).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        tried = rooted.join(hubs.where("lo < hi"), "bucket").where("root <> hub.root")
        pairs = tried.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
        found = cut_alone(lambda pairs=pairs: _links(_near(pairs, marks), d), "confirmed")
        if found.isEmpty():
            break
        roots = cut_alone(lambda roots=roots, found=found: _joined(roots, found), "roots")

    # the classes of buckets that still hold several components meet by keys of what tells them from their group's centre
    rooted = _rooted(members, roots)
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("rep").alias("first")).where("lo < hi").select("bucket", "first")
    rest = cut(rooted.join(open_, "bucket").select("rep", "root", "first").distinct(), "open")

    def grouped() -> DataFrame:
        groups = components(rest, "rep", "first").select(F.col("node").alias("rep"), F.col("root").alias("grp"))
        return rest.select("rep", "root").distinct().join(groups, "rep").select("grp", "rep", "root")

    members = cut_alone(grouped, "grouped")
    ids = broadcast_below(members.select(F.col("rep").alias("doc_id")), 2_000_000)
    texts = d.join(ids, "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id", "text"])
    sets = cut(texts.mapInArrow(_shingle_sets, "rep long, shingles array<long>").where("size(shingles) > 0").withColumn("sid", F.xxhash64("rep", "shingles")), "sets")
    maybe = cut_alone(lambda: _exact_pairs(members, sets), "maybe")

    def similar() -> DataFrame:
        named = sets.withColumnRenamed("shingles", "set")
        compared = _beside(maybe, named, "rep", "set")
        both, size = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
        return compared.where((both > 0) & (100 * both >= PERCENT * (size - both))).select("a", "b").distinct()

    more = cut_alone(similar, "more")
    if roots is None or not more.isEmpty():
        roots = cut_alone(lambda: _joined(roots, more), "roots")

    classed = classes.select("d1", "d2", "rep").join(roots, F.col("rep") == roots["node"], "left").select("d1", "d2", F.coalesce("root", "rep").alias("component"))
    out = signed.join(classed, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), "doc_id"))
    return out.select("doc_id", "k1", "k2", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component; columns of docs. Of fully repeated rows (id and text) one stays."""
    k1, k2, copy = (free_name(docs, c) for x, c in enumerate(("_k1", "_k2", "_copy")))
    found = near_duplicates(docs, text=text, doc_id=doc_id).where("kept").select("doc_id", "k1", "k2").groupBy("doc_id", "k1", "k2").count()
    found = broadcast_below(cut(found, "kept"), 2_000_000)
    keyed = docs.withColumns(dict(zip((k1, k2), text_key(text_or_empty(F.col(text))), strict=True)))
    same = keyed[doc_id].cast("long").eqNullSafe(found["doc_id"]) & (keyed[k1] == found["k1"]) & (keyed[k2] == found["k2"])
    joined = keyed.join(found, same).select(*[keyed[c] for c in docs.columns], found["count"].alias(copy), keyed[k1], keyed[k2])
    once = joined.where(F.col(copy) == 1).select(docs.columns)
    more = joined.where(F.col(copy) > 1).dropDuplicates([doc_id, k1, k2]).select(docs.columns)
    return once.unionByName(more)
