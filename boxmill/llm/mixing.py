"""Operator 7, mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_below, cut, free_name, others, text_or_empty

#: Bits of a document's draw, bits refined in a round, and rows of a bin that one task orders.
BITS, STEP, FEW = 52, 8, 1_000


def ranked(keys: DataFrame, key: str, to: str) -> DataFrame:
    """keys (distinct, one column `key`) with the long column `to`: the place in code point order from 0, null last.

    Ranges are sorted apart and only their row counts meet on the driver.
    """
    order = F.col(key).asc_nulls_last()
    ranged = cut(keys.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    before, starts = 0, {}
    for k, n in counts:
        starts[k], before = before, before + n
    first = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]) if starts else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + first[F.col("_range")]
    return ranged.withColumn(to, rank.cast("long")).drop("_range")


def _level(sources: DataFrame, cap: int) -> float:
    """The level L at which the targets least(cap * size, L * weight) sum up to all sizes."""
    row = sources.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total, level = row["t"] or 0, (row["t"] or 0) / (row["w"] or 1)
    while total:
        above = cap * F.col("source_size") <= level * F.col("weight")
        row = sources.agg(F.sum(F.when(above, cap * F.col("source_size"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if not row["w"]:
            break
        higher = (total - (row["held"] or 0)) / row["w"]
        if higher <= level:
            break
        level = higher
    return level


def _draw(seed: int, doc_id: Column, text: Column) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _bin(draw: Column, bits: Column) -> Column:
    """The first bits of a draw."""
    return F.call_function("shiftright", draw, F.lit(BITS) - bits)


def _of(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The rows (source, size, draw) that still fit the need of their source, with its state."""
    state = broadcast_below(state.withColumnRenamed("source", "_source"), 100_000)
    return rows.join(state, rows["source"].eqNullSafe(state["_source"])).where((F.col("size") > 0) & (F.col("size") <= F.col("need"))).drop("_source")


def _boundaries(rows: DataFrame, state: DataFrame) -> DataFrame:
    """state (source, need, after, ...) with upto and words: the draw up to which the fitting rows behind `after` meet the need, and their words.

    Histograms of the draws are refined around each source's boundary until a
    bin has few rows, whose running sums are then taken. Rows with one draw go
    together.
    """
    kept = state.columns
    at = cut(state.withColumns({"bits": F.lit(0), "prefix": F.lit(0).cast("long"), "left": F.col("need"), "rows": F.lit(FEW + 1).cast("long")}), "boundaries")
    inside = (F.col("draw") > F.col("after")) & (_bin(F.col("draw"), F.col("bits")) == F.col("prefix"))
    for bits in range(STEP, BITS + 1, STEP):
        wide = at.where(F.col("rows") > FEW)
        if wide.isEmpty():
            break
        bins = _of(rows, wide).where(inside).groupBy("source", F.shiftright("draw", BITS - bits).alias("b")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in [*kept[1:], "left"]])
        bins = bins.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        # the last bin that begins before the need is met
        last = F.max(F.struct("b", (F.col("left") - F.col("before")).alias("left"), "n", *kept[1:])).alias("m")
        finer = bins.where(F.col("before") <= F.col("left")).groupBy("source").agg(last)
        finer = finer.select("source", *[F.col(f"m.{c}").alias(c) for c in kept[1:]], F.lit(bits).alias("bits"), F.col("m.b").alias("prefix"), "m.left", F.col("m.n").alias("rows"))
        at = cut(at.where(F.col("rows") <= FEW).unionByName(finer), "boundaries")
    each = _of(rows, at).where(inside)
    each = each.withColumn("sum", F.sum("size").over(Window.partitionBy("source").orderBy("draw").rangeBetween(Window.unboundedPreceding, 0)))
    met = each.where(F.col("sum") <= F.col("left")).groupBy(F.col("source").alias("_source")).agg(F.max("draw").alias("last"), F.max("sum").alias("sum"))
    start = F.expr(f"shiftleft(prefix, {BITS} - bits)") - 1
    out = at.join(met, at["source"].eqNullSafe(met["_source"]), "left")
    words = F.col("need") - F.col("left") + F.coalesce("sum", F.lit(0))
    return out.select(*kept, F.coalesce("last", F.greatest(start, F.col("after"))).alias("upto"), words.alias("words"))


def _steps(small: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """(source, steps): the rows each source takes once more, as ranges of draws with a greatest size.

    Together the ranges are a walk through the draws that takes whatever still
    fits: each begins behind the row that did not fit the one before. At the end
    of the draws the walk begins anew, while a row may be taken again. It ends
    when nothing fits.
    """
    end = (1 << BITS) - 1
    state = sources.select("source", "need", F.lit(-1).cast("long").alias("after"), (F.lit(cap) - F.col("whole")).alias("turns"))
    open_ = (F.col("need") >= 1) & (F.col("turns") > 0)
    state = cut(state.where(open_), "needs")
    done = None
    while not state.isEmpty():
        sums = _of(small, state).groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("draw") > F.col("after"), F.col("size"))), F.lit(0)).alias("rest"), *[F.first(c).alias(c) for c in state.columns[1:]])
        sums = cut(sums, "rests")  # sources where nothing fits are gone
        over = sums.where(F.col("rest") > F.col("need"))
        found = _boundaries(small, over.drop("rest")).unionByName(sums.where(F.col("rest") <= F.col("need")).withColumns({"upto": F.lit(end).cast("long"), "words": F.col("rest").cast("double")}).drop("rest"))
        found = cut(found, "steps")
        step = found.select("source", F.struct(F.floor("need").alias("most"), "after", "upto").alias("step"))
        done = step if done is None else done.unionByName(step)
        ended = F.col("upto") == end
        state = found.select("source", (F.col("need") - F.col("words")).alias("need"), F.when(ended, -1).otherwise(F.col("upto")).cast("long").alias("after"), (F.col("turns") - ended.cast("int")).alias("turns"))
        state = cut(state.where(open_), "needs")
    if done is None:
        done = sources.select("source", F.struct(F.lit(0).cast("long").alias("most"), F.lit(0).cast("long").alias("after"), F.lit(0).cast("long").alias("upto")).alias("step")).limit(0)
    return done.groupBy("source").agg(F.collect_list("step").alias("steps"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7, text: str = "text", doc_id: str = "doc_id", source: str = "source", to: str = "mix") -> DataFrame:
    """docs with one struct column `to`: size, source_size, target, copies.

    Sizes are words. Sources in code point order, null last, take the weights in
    turn and share the sum of all sizes; a target is clamped at `cap` times the
    source's size and the excess is shared by weight again until none is above.
    Each document is taken floor(target / source_size) times; the rest of the
    target is filled in the order of a seeded draw: each document is taken once
    more if it still fits, and after the last one again, up to `cap` times in
    all, until nothing fits. The places are found by refining histograms of the draws, alike at every size.

    Null text has size 0. A source of size
    0 has target 0. Rows alike in id and text get the same number of copies.
    Empty tables give an empty result. Other columns pass through; `to` replaces
    a column of that name.
    """
    kept = others(docs, to)
    d = docs.select(*[F.col(f"`{c}`") for c in kept])
    size, draw, of = (free_name(d, c) for c in ("_size", "_draw", "_of"))
    t = text_or_empty(F.col(text))
    d = d.withColumns({size: F.regexp_count(t, F.lit(WORD)).cast("long"), draw: _draw(seed, F.col(doc_id), t), of: F.col(source).cast("string")})
    small = cut(d.select(F.col(of).alias("source"), F.col(size).alias("size"), F.col(draw).alias("draw")), "sizes")

    sources = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(sources, "source", "rank")
    sources = cut(sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))), "sources")
    level = _level(sources, cap)
    sources = sources.withColumn("target", F.least((cap * F.col("source_size")).cast("double"), F.lit(float(level)) * F.col("weight")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("whole", F.least(whole, F.lit(cap)).cast("int"))
    sources = sources.withColumn("need", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))

    steps = _steps(small, sources, cap)
    plan = sources.alias("s").join(steps.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source")), "left").select(F.col("s.source").alias("_source"), F.struct("source_size", "target", "whole", "steps").alias("_plan"))
    plan = broadcast_below(cut(plan, "plan"), 100_000)

    joined = d.join(plan, d[of].eqNullSafe(plan["_source"]), "left")
    fits = F.filter("_plan.steps", lambda x: (d[size] > 0) & (d[size] <= x["most"]) & (d[draw] > x["after"]) & (d[draw] <= x["upto"]))
    copies = F.col("_plan.whole") + F.coalesce(F.size(fits), F.lit(0))
    return joined.select(*[d[f"`{c}`"] for c in kept], F.struct(F.col(size).alias("size"), F.col("_plan.source_size"), F.col("_plan.target"), copies.alias("copies")).alias(to))


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """Each document as often as the mix takes it; columns of docs."""
    to = free_name(docs, "_mix")
    return mix(docs, to=to, **options).withColumn(to, F.explode(F.array_repeat(F.lit(1), F.col(f"{to}.copies")))).drop(to)
