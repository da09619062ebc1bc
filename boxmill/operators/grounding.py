"""Free-text grounding answers: boxes parsed from text, matched with gold boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import CORNERS, iou, normalised
from ..functions.text import BOX, class_words, matched_class


def parse_answers(answers: DataFrame, classes: list[str]) -> DataFrame:
    """(image_id, pos, cls, x1, y1, x2, y2) of the boxes in answers (image_id, response, width, height).

    A box is named by the text before it; one without a name takes the last
    name, and boxes before any name go. Of equal boxes the first stays.
    """
    numbers = [F.regexp_extract_all("response", F.lit(BOX), F.lit(k)) for k in range(1, 5)]
    between = F.split("response", BOX, -1)
    found = answers.select("image_id", "width", "height", F.posexplode(F.arrays_zip(*[n.alias(c) for n, c in zip(numbers, CORNERS, strict=True)], F.slice(between, 1, F.size(numbers[0])).alias("words"))).alias("pos", "m"))
    found = found.select("image_id", "width", "height", "pos", *[F.col(f"m.{c}").cast("double").alias(c) for c in CORNERS], matched_class(class_words(F.col("m.words")), classes).alias("named"))
    w = Window.partitionBy("image_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("cls", F.last("named", ignorenulls=True).over(w)).where("cls is not null").withColumns(normalised(F.col("width"), F.col("height")))
    first = F.row_number().over(Window.partitionBy("image_id", "cls", *CORNERS).orderBy("pos"))
    return found.withColumn("_k", first).where("_k = 1").select("image_id", "pos", "cls", *CORNERS)


def match(gold: DataFrame, preds: DataFrame, threshold: float = 0.3, cls: str = "class_id") -> DataFrame:
    """Gold boxes (image_id, gt_no, cls, corners) with iou and det_id of their match.

    In gt_no order each gold box takes the unused same-class prediction
    (image_id, det_id, cls, corners) of the highest IoU, the least det_id on
    ties, if it reaches the threshold; det_id is null else, and iou the best one
    seen, 0 without predictions. IoU is rounded to 3 places at the end.
    """
    g = gold.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("gt_no", F.col(cls).alias("cls"), *CORNERS))).alias("g"))
    p = preds.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("det_id", F.col(cls).alias("cls"), *CORNERS))).alias("p"))
    both = g.join(p, "image_id", "left")
    both = both.withColumn("p", F.coalesce("p", F.slice(F.array(F.struct(F.lit(0).cast(dict(preds.dtypes)["det_id"]).alias("det_id"), *[F.col("g")[0][c].alias(c) for c in ("cls", *CORNERS)])), 1, 0)))
    kind = dict(preds.dtypes)["det_id"]
    none = F.array().cast(f"array<struct<gt_no: {dict(gold.dtypes)['gt_no']}, det_id: {kind}, iou: double>>")

    def step(acc: Column, gt: Column) -> Column:
        free = F.filter("p", lambda d: (d["cls"] == gt["cls"]) & ~F.exists(acc, lambda m: m["det_id"].eqNullSafe(d["det_id"])))
        ranked = F.array_sort(F.transform(free, lambda d: F.struct((-iou(gt, d, clamp=False)).alias("o"), d["det_id"].alias("det_id"))))

        def add(r: Column) -> Column:
            best = F.try_element_at(r, F.lit(1))
            ok = -best["o"] >= threshold
            return F.array_append(acc, F.struct(gt["gt_no"].alias("gt_no"), F.when(ok, best["det_id"]).alias("det_id"), F.coalesce(-best["o"], F.lit(0.0)).alias("iou")))

        return F.transform(F.array(ranked), add)[0]

    matches = both.select("image_id", F.explode(F.aggregate("g", none, step)).alias("m"))
    return matches.select("image_id", "m.gt_no", "m.det_id", F.round("m.iou", 3).alias("iou"))


def image_rows(gold: DataFrame, preds: DataFrame, matches: DataFrame, cls: str = "class_id") -> DataFrame:
    """Per image: counts, precision (null without predictions), recall (null without gold), mean matched IoU, class lists."""
    g = gold.groupBy("image_id").agg(F.count("*").alias("n_gt"), F.array_join(F.sort_array(F.collect_set(F.col(cls).cast("string"))), ",").alias("gt_classes"))
    p = preds.groupBy("image_id").agg(F.count("*").alias("n_pred"), F.array_join(F.sort_array(F.collect_set(F.col(cls).cast("string"))), ",").alias("pred_classes"))
    m = matches.where("det_id is not null").groupBy("image_id").agg(F.count("*").alias("n_matched"), F.avg("iou").alias("mean_iou"))
    out = g.join(p, "image_id", "full").join(m, "image_id", "left").na.fill(0, ["n_gt", "n_pred", "n_matched"]).na.fill("", ["gt_classes", "pred_classes"])
    return out.withColumns({"precision": F.try_divide("n_matched", "n_pred"), "recall": F.try_divide("n_matched", "n_gt")})


def summary(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Micro precision and recall over all images, and the mean matched IoU; 0 where there is nothing."""
    a = rows.agg(F.sum("n_gt").alias("n_gt"), F.sum("n_pred").alias("n_pred"), F.sum("n_matched").alias("n_matched"))
    m = matches.where("det_id is not null").agg(F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"))
    zero = F.lit(0.0)
    out = a.withColumns({"precision": F.coalesce(F.try_divide("n_matched", "n_pred"), zero), "recall": F.coalesce(F.try_divide("n_matched", "n_gt"), zero)})
    return out.withColumn("_one", F.lit(1)).join(m.withColumn("_one", F.lit(1)), "_one").drop("_one")


def boxes_json(preds: DataFrame) -> DataFrame:
    """(image_id, pred_boxes): the boxes of an image as JSON in their order."""
    one = F.struct("pos", "cls", F.array(*CORNERS).alias("box"))
    return preds.groupBy("image_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(one)), lambda s: F.struct(s["cls"].alias("cls"), s["box"].alias("box")))).alias("pred_boxes"))


def boxes_from_json(rows: DataFrame, column: str = "pred_boxes") -> DataFrame:
    """rows with the column parsed; bad JSON gives no boxes."""
    kind = "array<struct<cls: string, box: array<double>>>"
    return rows.withColumn(column, F.coalesce(F.from_json(column, kind), F.array().cast(kind)))
