"""Operator 1, quality rules: cross-document line frequency.

Normalised lines are hashed and the distinct documents that hold each line are
counted per host. Lines above the limit are removed; documents that lose most
of their text with them are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, ascii_lower, broadcast_below, cut, free_name, let, others, text_key, text_or_empty, words

#: Fixed symbols of the result contract.
SYMBOLS = r"[#*$%&|<>]"
#: Word pairs that stand for a document's own lines where documents are compared.
SKETCH = 16


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array w.

    Windows are hashed; each hash carries its position in the low bits, so one
    primitive sort brings equal windows together, and only repeated positions
    are looked at afterwards.
    """
    n = F.size(w)
    m = F.greatest(n - 2, F.lit(0))

    def from_hashes(h: Column) -> Column:
        size = F.greatest(F.size(h) - 2, F.lit(0))
        pairs = F.zip_with(F.slice(h, 1, size), F.slice(h, 2, size), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(pairs, F.slice(h, 3, size), lambda a, b: F.xxhash64(a, b))

    mask = F.pow(F.lit(2.0), F.ceil(F.log2(m + F.lit(2)))).cast("long") - F.lit(1).cast("long")

    def positions(s: Column, low: Column) -> Column:
        k = F.greatest(F.size(s) - 1, F.lit(0))
        near = F.zip_with(
            F.slice(s, 1, k), F.slice(s, 2, k),
            lambda a, b: F.when(a.bitwiseXOR(b).between(F.lit(0).cast("long"), low), F.array(a.bitwiseAND(low), b.bitwiseAND(low))),
        )
        return F.sort_array(F.array_distinct(F.flatten(F.array_compact(near))))

    def covered(p: Column) -> Column:
        k = F.greatest(F.size(p) - 1, F.lit(0))
        steps = F.zip_with(F.slice(p, 1, k), F.slice(p, 2, k), lambda a, b: F.least(F.lit(3).cast("long"), b - a))
        return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(3).cast("long"), lambda acc, x: acc + x))

    def packed(h: Column, low: Column) -> Column:
        keep = F.bitwise_not(low)
        return F.sort_array(F.transform(from_hashes(h), lambda x, i: x.bitwiseAND(keep).bitwiseOR(i.cast("long"))))

    found = let(mask, lambda low: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(packed(h, low), lambda s: let(positions(s, low), covered))))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(found)


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), SPACE + "+", " "))


def with_line_stats(docs: DataFrame, text: str, to: str) -> DataFrame:
    """docs with the struct column `to` of the base statistics of the text."""
    t = text_or_empty(F.col(text))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    stats = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return docs.withColumn(to, F.struct(
        stats.alias("w"),
        (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    ))


def _hit_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: the set of its frequent lines, their characters and those of all its lines."""
    hits = lines.groupBy(*keys).agg(F.collect_set(F.struct("line", "chars")).alias("hits"), F.max("all_chars").alias("all_chars"))
    return cut(hits.withColumn("hit_chars", F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["chars"])), "quality-hits")


def _pairs(line: Column) -> Column:
    """Hashes of the pairs of neighbouring words of a normal line; of the line itself if it has one word."""
    hashed = F.transform(F.split(line, " ", -1), lambda x: F.xxhash64(x))
    return let(hashed, lambda w: F.when(F.size(w) < 2, w).otherwise(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))))


def _own_text(texts: DataFrame, mostly: DataFrame, hosts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, own): of the documents of `mostly`, those that differ outside their frequent lines, and the least pair of words they have there.

    A document's pairs are sampled by their SKETCH least hashes, which near copies share.
    """
    h = keys[0]
    held = texts.join(broadcast_below(mostly, 100_000), keys)
    held = held.select(*keys, "often", F.filter(F.array_distinct(F.transform(F.split("text", "\n", -1), normal_line)), lambda x: x != "").alias("n"))
    rest = F.filter("n", lambda x: ~F.array_contains("often", F.xxhash64(x)))
    sketch = F.slice(F.sort_array(F.array_distinct(F.flatten(F.transform(rest, _pairs)))), 1, SKETCH)
    pairs = cut(held.select(*keys, F.explode(sketch).alias("pair")).distinct(), "quality-pairs")
    menu = held.select(h, F.explode(F.filter("n", lambda x: F.array_contains("often", F.xxhash64(x)))).alias("line")).distinct()
    menu = menu.select(h, F.explode(_pairs(F.col("line"))).alias("pair"))
    shared = pairs.groupBy(h, "pair").agg(F.count("*").alias("docs")).join(hosts, h).where("docs > limit").select(h, "pair")
    known = menu.unionByName(shared).distinct().withColumn("known", F.lit(True))
    out = pairs.join(known, [h, "pair"], "left").groupBy(*keys)
    out = out.agg(F.count("*").alias("all"), F.count("known").alias("known"), F.min(F.when(F.col("known").isNull(), F.col("pair"))).alias("own"))
    return out.where(2 * F.col("known") <= F.col("all")).select(*keys, "own")


def quality_rules(
    docs: DataFrame, *, text: str = "text", host: str = "source", to: str = "quality", max_docs: int = 20, min_share: float = 0.025,
    max_support_share: float = 0.25, max_removed: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50,
    clean: bool = True,
) -> DataFrame:
    """docs with one struct column `to`: base statistics, removed lines, verdict and, if clean, the cleaned text.

    A line is normalised (A-Z lowered, white space to one space, trimmed), and
    counts once a document. A line is frequent in a host if over `max_docs` and
    over `min_share` of its distinct documents hold it, and is removed if as many
    of these differ otherwise. Those do of whose characters at most
    `max_support_share` are in frequent lines; of the others, those whose other
    lines are not mostly word pairs of the host's frequent lines or of over that
    limit of such documents, once for each least pair of their own. So pages that
    are nearly all menu count by what little they have of their own, while copies
    of one text are no evidence that a line is boilerplate and are left to the
    near-duplicate operator. A document is
    rejected if the base rules fail, or if over `max_removed` of the characters
    in its distinct lines are removed.

    Null or empty text: all counts 0, base_failed true. A null host is a host
    of its own. Rows with the same host and text, repeated ids included, are one
    document in the counts and share their verdict. Other columns pass through;
    `to` replaces a column of that name.
    """
    kept = others(docs, to)
    d = docs.select(*[F.col(f"`{c}`") for c in kept])
    h, k1, k2, base = (free_name(d, x) for x in ("_h", "_k1", "_k2", "_base"))
    t = text_or_empty(F.col(text))
    d = d.withColumns(dict(zip((k1, k2), text_key(t), strict=True)) | {h: F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))})
    keys = [h, k1, k2]

    lines = d.select(*keys, F.array_distinct(F.transform(F.split(t, "\n", -1), normal_line)).alias("n"))
    lines = lines.select(*keys, F.transform(F.filter("n", lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("chars"))).alias("n"))
    lines = lines.select(*keys, F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("all_chars"), F.explode("n").alias("x"))
    lines = lines.select(*keys, "all_chars", "x.line", "x.chars")
    # rows are at least as many as documents, so these lines hold all that are over the limit; copies fall out in the second count
    hosts = d.select(*keys).distinct().groupBy(h).agg(F.greatest(F.count("*") * min_share, F.lit(float(max_docs))).alias("limit"))
    hosts = broadcast_below(cut(hosts, "quality-hosts"), 100_000)
    often = lines.groupBy(h, "line").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).join(hosts, h).where("docs > limit").select(h, "line")
    hits = _hit_lines(lines.join(often, [h, "line"]), keys)
    each = hits.select(*keys, "all_chars", F.explode("hits").alias("x")).select(*keys, "all_chars", "x.line", "x.chars")
    copied = cut(each.groupBy(h, "line").agg(F.count("*").alias("docs")).join(hosts, h).where("docs <= limit").select(h, "line"), "quality-copied")
    if not copied.isEmpty():
        hits = _hit_lines(each.join(broadcast_below(copied, 100_000), [h, "line"], "left_anti"), keys)

    few = F.col("hit_chars") <= F.col("all_chars") * max_support_share
    support = hits.where(few).select(h, F.col(k1).alias("own"), F.explode("hits.line").alias("line"))
    mostly = cut(hits.where(~few).select(*keys, F.col("hits.line").alias("often")), "quality-mostly")
    if not mostly.isEmpty():
        own = _own_text(d.select(*keys, t.alias("text")), mostly, hosts, keys)
        support = support.unionByName(mostly.join(own, keys).select(h, "own", F.explode("often").alias("line")))
    gone = support.groupBy(h, "line").agg(F.count_distinct("own").alias("docs")).join(hosts, h).where("docs > limit").select(h, "line")
    lost = hits.select(*keys, "all_chars", F.explode("hits").alias("x")).select(*keys, "all_chars", "x.line", "x.chars").join(gone, [h, "line"])
    lost = lost.groupBy(*keys).agg(F.collect_set("line").alias("_gone"), F.sum("chars").alias("_gone_chars"), F.max("all_chars").alias("_all_chars"))

    n, repeat = F.col(f"{base}.w.n_words"), F.col(f"{base}.w.n_repeat_words")
    failed = (n < min_words) | (100 * repeat > max_repeat_percent * n)
    a, b = with_line_stats(d, text, base).alias("a"), lost.select(*[F.col(c).alias(f"_{c}") for c in keys], F.struct("_gone", "_gone_chars", "_all_chars").alias("_lost"))
    b = broadcast_below(cut(b, "quality-lost"), 100_000).alias("b")  # few documents lose lines, so texts stay where they are
    joined = a.join(b, [F.col(f"a.{c}") == b[f"_{c}"] for c in keys], "left")
    depleted = F.coalesce(F.col("_lost._gone_chars") > F.col("_lost._all_chars") * max_removed, F.lit(False))
    left = F.array_join(F.filter(F.split(t, "\n", -1), lambda x: ~F.array_contains(F.col("_lost._gone"), F.xxhash64(normal_line(x)))), "\n")
    text_of = [F.when(F.col("_lost").isNull(), F.col(f"a.`{text}`")).otherwise(left).alias("clean_text")] if clean else []
    return joined.select(*[F.col(f"a.`{c}`") for c in kept], F.struct(
        n.alias("n_words"), F.col(f"{base}.word_chars"), F.col(f"{base}.n_symbols"), F.col(f"{base}.n_dup_lines"), repeat.alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.coalesce(F.size("_lost._gone"), F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce(F.col("_lost._gone_chars"), F.lit(0)).alias("removed_chars"), *text_of,
    ).alias(to))


def drop_rejected(docs: DataFrame, **options: object) -> DataFrame:
    """The documents that pass, with the removed lines taken out of their text; columns of docs."""
    to = free_name(docs, "_quality")
    out = quality_rules(docs, to=to, **options).where(F.col(f"{to}.kept"))
    new = {"text": F.col(f"{to}.clean_text"), "n_chars": F.length(F.col(f"{to}.clean_text")).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
