"""Operator 6, benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_below, cut, free_name, let, others, text_key, text_or_empty, words

#: The contract's words; the second pattern finds the same ones before A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _pairs(a: Column, b: Column, skip: int) -> Column:
    """Hashes of a[i] with b[i + skip]."""
    n = F.greatest(F.size(b) - skip, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, skip + 1, n), lambda x, y: F.xxhash64(x, y))


def shingles(w: Column, k: int) -> Column:
    """Hashes of all k-word runs of the array w, case folded."""

    def joined(h: Column, n: int) -> Column:
        if n == 1:
            return h
        half = n // 2
        if n % 2:
            return _pairs(joined(h, n - 1), h, n - 1)
        return let(joined(h, half), lambda p: _pairs(p, p, half))

    return let(F.transform(w, lambda x: F.xxhash64(F.lit(k), F.lower(x))), lambda h: joined(h, k))


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(wid, len, k, passage, w) of the distinct windows, and (wid, item_id) of the items that hold them."""
    w = words(ascii_lower(text_or_empty(F.col("text"))), WORD)
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), w.alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("len", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    rows = rows.select("item_id", "len", F.explode(let(F.col("w"), lambda x: F.transform(starts, lambda i: F.slice(x, i, F.col("len"))))).alias("w"))
    rows = rows.withColumn("passage", F.array_join("w", " ")).withColumn("wid", F.xxhash64("passage"))
    rows = cut(rows, "windows")
    held = rows.select("wid", "passage", "item_id").distinct()
    windows = rows.dropDuplicates(["wid", "passage"]).withColumn("k", F.least("len", F.lit(shingle))).drop("item_id")
    return windows, held


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shingle: int = 5, text: str = "text", item_id: str = "item_id", item_text: str = "text", to: str = "leak",
) -> DataFrame:
    """docs with one struct column `to`: n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item, or the whole item if it
    is shorter; document words inside an occurrence of a window are hit. Windows
    are sets of shingles that must be contained whole, so one prefix shingle a
    window is enough: the one rarest in all documents. Its places in documents
    give the window's only possible start there; places that would begin before
    the document or end behind it are dropped, as are windows of which some
    shingle occurs nowhere. The passage at each remaining place is compared word
    by word. Texts are hashed case folded for the search and compared with A-Z
    lowered only.

    Null text or text without words, in documents or items: no words, no hits.
    Null item ids count as an empty id; items that share an id are one item.
    Copies of a text are looked up once each and share their result. Without any
    item nothing is hit. Other columns pass through; `to` replaces one of its name.
    """
    kept = others(docs, to)
    d = docs.select(*[F.col(f"`{c}`") for c in kept])
    k1, k2, n = (free_name(d, c) for c in ("_k1", "_k2", "_n"))
    t = text_or_empty(F.col(text))
    d = d.withColumns(dict(zip((k1, k2), text_key(t), strict=True)))
    windows, held = item_windows(benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), window, shingle)
    windows = cut(windows, "distinct-windows")
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())
    counted = d.withColumn(n, F.regexp_count(t, F.lit(RAW_WORD)))
    if not sizes:
        none = F.struct(F.col(n).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
        return counted.select(*[F.col(f"`{c}`") for c in kept], none.alias(to))

    def placed(rows: DataFrame, w: Column, keep: list[str]) -> DataFrame:
        parts = [rows.select(*keep, F.posexplode(shingles(w, k)).alias("pos", "sh")) for k in sizes]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    inside = placed(windows, F.col("w"), ["wid", "passage", "len", "k"])
    inside = inside.where(F.col("pos") <= F.col("len") - F.col("k"))
    if len(sizes) > 1:  # a window's own shingle size only
        own = None
        for k in sizes:
            part = windows.where(F.col("k") == k).select("wid", "passage", "len", F.posexplode(shingles(F.col("w"), k)).alias("pos", "sh"))
            own = part if own is None else own.unionByName(part)
        inside = own
    inside = cut(inside.select("wid", "passage", "len", "pos", "sh"), "window-shingles")

    known = broadcast_below(inside.select("sh").distinct(), 2_000_000)
    found = placed(d, words(t, RAW_WORD), [k1, k2]).join(known, "sh")
    found = cut(found.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), "pos", "sh"), "found")

    rarity = found.groupBy("sh").agg(F.count("*").alias("n"))
    prefix = inside.join(rarity, "sh", "left").groupBy("wid", "passage", "len").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min(F.struct("n", "sh", "pos")).alias("rarest"))
    prefix = prefix.where("absent = 0").select("wid", "passage", "len", "rarest.sh", F.col("rarest.pos").alias("offset"))
    places = found.join(broadcast_below(cut(prefix, "prefix"), 200_000), "sh").select("k1", "k2", (F.col("pos") - F.col("offset")).alias("start"), "len", "wid", "passage")
    places = places.where("start >= 0").distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "len", "wid", "passage")).alias("places"))
    places = cut(places, "places")

    texts = d.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), t.alias("text"))
    texts = texts.join(broadcast_below(places.select("k1", "k2"), 2_000_000), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.any_value("text").alias("text"))
    fits = let(words(ascii_lower(F.col("text")), WORD), lambda w: F.filter("places", lambda p: (p["start"] + p["len"] <= F.size(w)) & (F.array_join(F.slice(w, p["start"] + 1, p["len"]), " ") == p["passage"])))
    hits = cut(texts.join(places, ["k1", "k2"]).select("k1", "k2", fits.alias("hits")).where(F.size("hits") > 0), "hits")
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda p: F.sequence(p["start"], p["start"] + p["len"] - 1)))))
    items = hits.select("k1", "k2", F.explode(F.array_distinct(F.transform("hits", lambda p: F.struct(p["wid"].alias("wid"), p["passage"].alias("passage"))))).alias("w"))
    items = items.select("k1", "k2", "w.wid", "w.passage").join(held, ["wid", "passage"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    leaks = hits.select("k1", "k2", covered.cast("long").alias("n_hit")).join(items, ["k1", "k2"])
    leaks = leaks.select(F.col("k1").alias("_lk1"), F.col("k2").alias("_lk2"), F.struct("n_hit", "items").alias("_leak"))
    leaks = broadcast_below(cut(leaks, "leaks"), 200_000)

    joined = counted.join(leaks, (counted[k1] == leaks["_lk1"]) & (counted[k2] == leaks["_lk2"]), "left")
    hit = F.coalesce(F.col("_leak.n_hit"), F.lit(0))
    return joined.select(*[counted[f"`{c}`"] for c in kept], F.struct(
        counted[n].cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), F.coalesce(F.size("_leak.items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_leak.items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    ).alias(to))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The documents without any hit; columns of docs."""
    to = free_name(docs, "_leak")
    return decontaminate(docs, benchmark, to=to, **options).where(~F.col(f"{to}.contaminated")).drop(to)
