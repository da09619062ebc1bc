"""Overlaps, suppression and clusters of images with so many boxes that they are no longer one row.

Pairs meet in the cells of grids that double in size. A box lies in up to four
cells of the grid that fits it and of the next coarser ones; boxes that overlap
by a threshold differ in size by a factor the threshold bounds, so the grid of the
larger box is one of the smaller box's. A pair is reported by the cell that holds
the low corner of its intersection. The boxes of an image that has few of them meet
in one cell, as they would else be exchanged once for each of theirs. Suppression and clusters are rounds of joins
over the pairs.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from .fusion import FIELDS, above, fused
from .lineage import cut

log = logging.getLogger(__name__)

#: Boxes of an image up to which they meet in one cell.
FEW = 64
ONE_CELL = -100_000


def _celled(dets: DataFrame, threshold: float, keys: list[str], crowded: DataFrame) -> DataFrame:
    """A row for each cell of each box that has an area: the keys, level, cx, cy, own level and box; level ONE_CELL for an image that isn't in crowded."""
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold {threshold}: over 0 and up to 1")
    wider = math.ceil(-math.log2(threshold) - 1e-12)
    sized = dets.where("x2 > x1 AND y2 > y1").withColumn("own", F.ceil(F.log2(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).cast("int"))
    sized = sized.join(crowded.withColumn("_many", F.lit(True)), "image_id", "left").withColumn("_many", F.coalesce("_many", F.lit(False)))
    leveled = sized.withColumn("level", F.explode(F.when(F.col("_many"), F.sequence(F.col("own"), F.col("own") + wider)).otherwise(F.array(F.lit(ONE_CELL)))))

    def cells(low: str, high: str) -> Column:
        side = F.pow(F.lit(2.0), F.col("level"))
        some = F.sequence(F.floor(F.col(low) / side).cast("long"), F.floor(F.col(high) / side).cast("long"))
        return F.explode(F.when(F.col("_many"), some).otherwise(F.array(F.lit(0).cast("long"))))

    wide = leveled.withColumn("cx", cells("x1", "x2")).withColumn("cy", cells("y1", "y2"))
    return wide.select(*keys, "level", "cx", "cy", "own", F.struct("det_id", "score", "x1", "y1", "x2", "y2").alias("d"))


def met(a: DataFrame, b: DataFrame, threshold: float, *, same_class: bool = True) -> DataFrame:
    """(image_id, a, b) for the boxes of two tables that meet in a cell and may overlap by the threshold; each pair once."""
    keys = ["image_id", "class_id"] if same_class else ["image_id"]
    at = [*keys, "level", "cx", "cy"]
    boxes = a.select("image_id") if a is b else a.select("image_id").unionByName(b.select("image_id"))
    crowded = boxes.groupBy("image_id").agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select("image_id")
    left, right = (_celled(t, threshold, keys, crowded).withColumnsRenamed({"d": to, "own": f"own_{to}"}) for t, to in ((a, "a"), (b, "b")))
    side = F.pow(F.lit(2.0), F.col("level"))
    low = {c: F.floor(F.greatest(F.col(f"a.{c}1"), F.col(f"b.{c}1")) / side) == F.col(f"c{c}") for c in "xy"}
    reported = (F.col("level") == ONE_CELL) | ((F.col("level") == F.greatest("own_a", "own_b")) & low["x"] & low["y"])
    near = (F.col("a.x1") < F.col("b.x2")) & (F.col("b.x1") < F.col("a.x2")) & (F.col("a.y1") < F.col("b.y2")) & (F.col("b.y1") < F.col("a.y2"))
    return left.join(right, at).where(reported & near).select("image_id", "a", "b")


def iou_pairs(dets: DataFrame, threshold: float, *, same_class: bool = True, strict: bool = False, eps: float | None = None) -> DataFrame:
    """(image_id, a, b, iou) for the pairs that fusion.iou_pairs gives; a and b are structs of det_id, score and corners.

    Boxes without area overlap nothing. Nulls in an image, class or corner leave a
    box without pairs. Images alike in all boxes give all their pairs, as each
    is a result.
    """
    value = iou(F.col("a"), F.col("b"), eps=eps)
    pairs = met(dets, dets, threshold, same_class=same_class).where("a.det_id < b.det_id").withColumn("iou", value)
    return pairs.where(F.col("iou") > threshold if strict else F.col("iou") >= threshold)


def named_pairs(dets: DataFrame, threshold: float, *, same_class: bool = True, strict: bool = False) -> DataFrame:
    """(image_id, a, b, iou) by det_id."""
    return iou_pairs(dets, threshold, same_class=same_class, strict=strict).select("image_id", F.col("a.det_id").alias("a"), F.col("b.det_id").alias("b"), "iou")


def smart_crop_filter(crops: DataFrame, full: DataFrame, high: float = 0.85, low: float = 0.3) -> DataFrame:
    """Crop boxes whose best same-class IoU with a full-image box is >= high or < low; only overlaps from low on are looked for."""
    best = met(crops, full, low).groupBy("image_id", F.col("a.det_id").alias("det_id")).agg(F.max(iou(F.col("a"), F.col("b"))).alias("_best"))
    found = crops.join(best, ["image_id", "det_id"], "left")
    return found.where(F.col("_best").isNull() | (F.col("_best") < low) | (F.col("_best") >= high)).select(*FIELDS)


def strongest(dets: DataFrame, max_det: int) -> DataFrame:
    """The max_det boxes of each image with the highest scores, ties by det_id."""
    ranked = dets.withColumn("_n", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")))
    return ranked.where(F.col("_n") <= max_det).drop("_n")


def nms(dets: DataFrame, threshold: float, *, class_agnostic: bool = False, eps: float | None = None, max_det: int | None = None) -> DataFrame:
    """Greedy suppression as fusion.nms does it, by rounds instead of a fold.

    What the greedy rule keeps is the lexicographically first independent set of
    the overlap graph, by falling score, then det_id. In a round the boxes without
    a stronger undecided neighbour stay, and their neighbours go. The rounds are
    as many as the longest chain of boxes that wait for each other, which the log
    tells. max_det: only that many of an image's strongest boxes take part.
    """
    dets = dets.select(*FIELDS) if max_det is None else strongest(dets, max_det).select(*FIELDS)
    pairs = iou_pairs(dets, threshold, same_class=not class_agnostic, strict=True, eps=eps)
    first = (F.col("a.score") > F.col("b.score")) | ((F.col("a.score") == F.col("b.score")) & (F.col("a.det_id") < F.col("b.det_id")))
    ends = [F.when(first, F.col(f"{x}.det_id")).otherwise(F.col(f"{y}.det_id")).alias(to) for to, x, y in (("strong", "a", "b"), ("weak", "b", "a"))]
    edges = cut(pairs.select("image_id", *ends), "overlaps")
    gone, rounds = None, 0
    while not edges.isEmpty():
        blocked = edges.select("image_id", F.col("weak").alias("strong"))
        free = edges.join(blocked, ["image_id", "strong"], "left_anti")
        lost = cut(free.select("image_id", F.col("weak").alias("det_id")).distinct(), "lost")
        gone = lost if gone is None else gone.unionByName(lost)
        for end in ("weak", "strong"):
            edges = edges.join(lost.withColumnRenamed("det_id", end), ["image_id", end], "left_anti")
        edges, rounds = cut(edges.select("image_id", "strong", "weak"), "overlaps"), rounds + 1
    log.info("suppression took %d rounds", rounds)
    return dets if gone is None else dets.join(gone, ["image_id", "det_id"], "left_anti").select(*FIELDS)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("image_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, ["image_id", "u"]).where("v > u").select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("image_id", "u").agg(F.min("v").alias("m"))
    moved = edges.join(least, ["image_id", "u"]).where("v <> m").select("image_id", F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("image_id", "u", F.col("m").alias("v"))).distinct()


def cluster(dets: DataFrame, threshold: float) -> DataFrame:
    """Detections with `cluster` as fusion.cluster gives it, by alternating large and small stars over the pairs instead of a fold."""
    edges = cut(named_pairs(dets, threshold).select("image_id", F.col("b").alias("u"), F.col("a").alias("v")), "overlaps")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("image_id", "u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before, edges = now, cut(_small_star(cut(_large_star(edges), "large")), "small")
    roots = edges.select("image_id", F.col("u").alias("det_id"), F.col("v").alias("_root"))
    return dets.select(*FIELDS).join(roots, ["image_id", "det_id"], "left").select(*FIELDS, F.coalesce("_root", "det_id").alias("cluster"))


def weighted_box_fusion(dets: DataFrame, threshold: float, skip: float = 0.0) -> DataFrame:
    """fusion.weighted_box_fusion over clusters made by star rounds."""
    return fused(cluster(above(dets, skip), threshold)).withColumnRenamed("cluster", "det_id")
