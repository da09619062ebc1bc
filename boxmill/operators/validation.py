"""Detector validation: average precision, per-class and global tables, training curves."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import CORNERS, area, intersection, iou_of
from ..functions.text import harmonic

#: Score bins of the running sums: rows of a class are summed by bin first, then inside a bin.
BINS = 1024
#: Thresholds that are judged in the bits of one integer.
BITS = 60


def _masks(dets: DataFrame, gold: DataFrame, thresholds: list[float]) -> tuple[DataFrame, list[Column]]:
    """Detections with integers _m0, ..., and a boolean Column of these for each threshold: whether the detection is a true positive there.

    All thresholds are judged in one fold, and the IoU of two boxes is made once: a
    threshold is a bit, and so is what a detection takes and what of a gold box is used.
    A detection looks at the gold boxes that reach the lowest threshold, best first;
    an IoU that is no number is the best, as in SQL.
    """
    parts = [thresholds[at : at + BITS] for at in range(0, len(thresholds), BITS)]
    box_ = [*CORNERS, area(F.struct(*CORNERS)).alias("a")]
    d = dets.groupBy("image_id", "class_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "det_id", *box_))).alias("d"))
    g = gold.groupBy("image_id", "class_id").agg(F.collect_list(F.struct("gt_no", *box_)).alias("g"))
    both = d.join(g, ["image_id", "class_id"], "left")
    gt_no, zero = dict(gold.dtypes)["gt_no"], F.lit(0).cast("long")

    def bound(value: Column, to: Callable[[Column], Column]) -> Column:
        """to(value), where value is computed once."""
        return F.transform(F.array(value), to)[0]

    def fold(part: list[float]) -> Column:
        rising = sorted((t, 1 << k) for k, t in enumerate(part))
        upto = [0, *accumulate(bit for _, bit in rising)]

        def reached(o: Column, first: int = 0, last: int = len(part)) -> Column:
            """The bits of the thresholds that o reaches, which are the lowest ones: looked up by halves."""
            if first == last:
                return F.lit(upto[first]).cast("long")
            at = (first + last) // 2
            return F.when(o >= rising[at][0], reached(o, at + 1, last)).otherwise(reached(o, first, at))

        def candidates(det: Column) -> Column:
            shared = lambda b: bound(intersection(det, b), lambda i: iou_of(i, det["a"], b["a"]))
            near = F.filter(F.transform("g", lambda b: F.struct(shared(b).alias("o"), b["gt_no"].alias("gt_no"))), lambda b: b["o"] >= rising[0][0])
            return F.sort_array(F.transform(near, lambda b: F.struct(F.when(F.isnan(b["o"]), float("-inf")).otherwise(-b["o"]).alias("o"), b["gt_no"].alias("gt_no"), reached(b["o"]).alias("m"))))

        def take(acc: Column, b: Column) -> Column:
            used = F.aggregate(F.filter(acc["used"], lambda u: u["gt_no"] == b["gt_no"]), zero, lambda m, u: m.bitwiseOR(u["m"]))
            free = b["m"].bitwiseAND(F.bitwise_not(acc["took"].bitwiseOR(used)))
            return bound(free, lambda m: F.when(m == 0, acc).otherwise(F.struct(acc["took"].bitwiseOR(m).alias("took"), F.array_append(acc["used"], F.struct(b["gt_no"].alias("gt_no"), m.alias("m"))).alias("used"))))

        def step(acc: Column, det: Column) -> Column:
            def add(b: Column) -> Column:
                some = F.aggregate(b, F.struct(zero.alias("took"), acc["used"].alias("used")), take)
                return bound(F.when(F.size(b) > 0, some).otherwise(F.struct(zero.alias("took"), acc["used"].alias("used"))), lambda a: F.struct(a["used"].alias("used"), F.array_append(acc["m"], a["took"]).alias("m")))

            return bound(candidates(det), add)

        start = F.struct(F.array().cast(f"array<struct<gt_no:{gt_no},m:bigint>>").alias("used"), F.array().cast("array<bigint>").alias("m"))
        return F.when(F.col("g").isNull(), F.transform("d", lambda _: zero)).otherwise(F.aggregate("d", start, step)["m"])

    masks = [f"_m{k}" for k in range(len(parts))]
    out = both.withColumns({m: fold(part) for m, part in zip(masks, parts, strict=True)}).select("image_id", "class_id", *masks, F.posexplode("d").alias("_at", "d"))
    out = out.select("image_id", "class_id", F.col("d.det_id").alias("det_id"), (-F.col("d.o")).alias("score"), *[F.get(m, F.col("_at")).alias(m) for m in masks])
    return out, [F.col(f"_m{k // BITS}").bitwiseAND(F.lit(1 << k % BITS).cast("long")) != 0 for k in range(len(thresholds))]


def judged_at(dets: DataFrame, gold: DataFrame, thresholds: list[float]) -> DataFrame:
    """Detections with tp, an array with a boolean for each threshold: by falling score each takes the unused same-class gold box of highest IoU, if it reaches the threshold."""
    out, tp = _masks(dets, gold, thresholds)
    return out.select("image_id", "class_id", "det_id", "score", F.array(*tp).alias("tp"))


def judged(dets: DataFrame, gold: DataFrame, thresholds: list[float]) -> DataFrame:
    """judged_at() as a row for each detection and threshold, with threshold and tp."""
    out = judged_at(dets, gold, thresholds).withColumn("_t", F.explode(F.arrays_zip(F.lit(thresholds).alias("threshold"), "tp")))
    return out.select("image_id", "class_id", F.col("_t.threshold").alias("threshold"), "det_id", "score", F.col("_t.tp").alias("tp"))


def _enveloped(rows: DataFrame, keys: list[str], marks: dict[str, Column]) -> DataFrame:
    """rows with _rank and, for each boolean Column in marks, its _hits_, _precision_ and _envelope_ by falling score in a group of keys.

    Sums and maxima run inside score bins and over the bins' totals, so a group
    is never sorted in one task. Rows of a bin are sorted once, lowest score first: what
    comes later in a bin is then the running maximum, and ranks and hits count down
    from the sums at the bin's end. All reads share one exchange by bin, and rows are
    made once; the bins' totals ask for all columns of an order, as an exchange
    of fewer would be another one.
    """
    bin_, order = [*keys, "_bin"], ["score", "image_id", "det_id"]
    r = rows.withColumn("_bin", F.least(F.lit(BINS - 1), F.floor((1 - F.col("score")) * BINS).cast("int"))).repartition(*bin_)
    ones = {"_rank": F.lit(1), **{f"_hits_{m}": F.when(c, 1).otherwise(0) for m, c in marks.items()}}
    bins = r.groupBy(*bin_).agg(*[F.sum(c).alias(n) for n, c in ones.items()], *[F.max(c).alias(f"_top_{c}") for c in order])
    upto = Window.partitionBy(*keys).orderBy(*[F.desc(f"_top_{c}") for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    ends = bins.select(*bin_, *[F.sum(n).over(upto).alias(f"_end{n}") for n in ones])
    back = Window.partitionBy(*bin_).orderBy(F.asc("score"), F.desc("image_id"), F.desc("det_id")).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumns({n: F.sum(c).over(back) for n, c in ones.items()}).join(F.broadcast(ends), bin_)
    r = r.withColumns({n: F.col(f"_end{n}") - F.col(n) + c for n, c in ones.items()}).drop(*[f"_end{n}" for n in ones])
    r = r.withColumns({f"_precision_{m}": F.col(f"_hits_{m}") / F.col("_rank") for m in marks})
    later = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    best = r.groupBy(*bin_).agg(*[F.max(f"_precision_{m}").alias(m) for m in marks])
    best = best.select(*bin_, *[F.max(m).over(later).alias(f"_later_{m}") for m in marks])
    r = r.withColumns({f"_envelope_{m}": F.max(f"_precision_{m}").over(back) for m in marks}).join(F.broadcast(best), bin_)
    return r.withColumns({f"_envelope_{m}": F.greatest(f"_envelope_{m}", F.coalesce(f"_later_{m}", F.lit(0.0))) for m in marks})


def precision_recall(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """Judged rows with precision, recall and the precision envelope, by falling score a class and threshold."""
    n = gold.groupBy("class_id").agg(F.count("*").alias("n_gold"))
    r = _enveloped(rows, ["class_id", "threshold"], {"tp": F.col("tp")}).join(F.broadcast(n), "class_id", "left").withColumn("recall", F.try_divide(F.col("_hits_tp"), F.col("n_gold")))
    return r.select("image_id", "class_id", "threshold", "det_id", "score", "tp", F.col("_precision_tp").alias("precision"), "recall", F.col("_envelope_tp").alias("envelope"))


def average_precisions(dets: DataFrame, gold: DataFrame, thresholds: list[float]) -> DataFrame:
    """average_precision() of the curves at all thresholds, with a row a detection instead of one a detection and threshold."""
    rows, tp = _masks(dets, gold, thresholds)
    marks = {f"_tp{k}": c for k, c in enumerate(tp)}
    at = [F.struct(F.lit(t).alias("threshold"), F.sum(F.when(c, F.col(f"_envelope_{m}")).otherwise(0.0)).alias("s"), F.count_if(c).alias("t")) for t, (m, c) in zip(thresholds, marks.items(), strict=True)]
    sums = _enveloped(rows, ["class_id"], marks).groupBy("class_id").agg(F.array(*at).alias("a"), F.count("*").alias("n"))
    return _averages(sums.select("class_id", "n", F.inline("a")), gold)


def average_precision(curve: DataFrame, gold: DataFrame) -> DataFrame:
    """(class_id, threshold, ap, precision, recall): the area under the envelope, and the values at the last detection."""
    sums = curve.groupBy("class_id", "threshold").agg(F.sum(F.when(F.col("tp"), F.col("envelope")).otherwise(0.0)).alias("s"), F.count_if("tp").alias("t"), F.count("*").alias("n"))
    return _averages(sums, gold)


def _averages(sums: DataFrame, gold: DataFrame) -> DataFrame:
    n = gold.groupBy("class_id").agg(F.count("*").alias("n_gold"))
    out = n.join(sums, "class_id", "left")
    return out.select("class_id", "threshold", F.try_divide("s", "n_gold").alias("ap"), F.try_divide("t", "n").alias("precision"), F.try_divide("t", "n_gold").alias("recall"))


def per_class(aps: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class: P, R, F1 at IoU 0.5, AP50, AP75, AP50-95 and its share in percent; 0 for classes without gold."""
    at = [("ap", "ap50", 0.5), ("ap", "ap75", 0.75), ("precision", "p", 0.5), ("recall", "r", 0.5)]
    a = aps.groupBy("class_id").agg(*[F.max(F.when(F.col("threshold") == t, F.col(c))).alias(n) for c, n, t in at], F.avg("ap").alias("ap"))
    out = classes.select("class_id", "name").join(a, "class_id", "left").na.fill(0.0, ["ap50", "ap75", "p", "r", "ap"])
    share = F.coalesce(F.try_divide(F.col("ap") * 100, F.sum("ap").over(Window.partitionBy())), F.lit(0.0))
    return out.select("class_id", "name", F.col("p").alias("precision"), F.col("r").alias("recall"), harmonic(F.col("p"), F.col("r")).alias("f1"), "ap50", "ap75", "ap", share.alias("share"))


def overall(classes: DataFrame) -> DataFrame:
    """The means over the rows of per_class, F1 from the mean precision and recall."""
    m = classes.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "ap50", "ap75", "ap")])
    return m.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def best_epoch(epochs: DataFrame, metric: str, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Per run the first epoch with the highest metric; nulls and NaN are left out."""
    ok = epochs.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    return ok.groupBy(run).agg(F.max_by(F.struct(epoch, metric), F.struct(F.col(metric), -F.col(epoch))).alias("b")).select(run, f"b.{epoch}", f"b.{metric}")


def patience(epochs: DataFrame, metric: str, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Epochs with best so far, whether the epoch improved it (from 0), and epochs since; epochs without metric go."""
    ok = epochs.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    w = Window.partitionBy(run).orderBy(epoch)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    r = ok.withColumns({"_i": F.row_number().over(w), "best": F.greatest(F.lit(0.0), F.max(metric).over(upto))})
    before = F.coalesce(F.lag("best").over(w), F.lit(0.0))
    r = r.withColumn("improved", F.col("best") > before)
    last = F.last(F.when(F.col("improved"), F.col("_i")), ignorenulls=True).over(upto)
    return r.select(run, epoch, metric, "best", "improved", (F.col("_i") - F.coalesce(last, F.lit(0))).alias("since"))
