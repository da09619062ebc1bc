"""Suppression, fusion and priority rules over detections.

Detections are rows: image_id, det_id, class_id, x1, y1, x2, y2, score. The
sequential rules are folds over one image's boxes, sorted in the plan; boxes of
an image are bounded by the detector. Ties are broken by det_id.
"""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, grid_shape, iou, overlaps, shifted
from .lineage import cut

FIELDS = ("image_id", "det_id", "class_id", "x1", "y1", "x2", "y2", "score")


def _row() -> Column:
    """A detection as a struct that sorts by falling score, then det_id."""
    return F.struct((-F.col("score")).alias("o"), "det_id", "class_id", "x1", "y1", "x2", "y2", "score")


def _listed(dets: DataFrame, keys: list[str]) -> DataFrame:
    return dets.groupBy(*keys).agg(F.sort_array(F.collect_list(_row())).alias("b"))


def _rows(kept: DataFrame, keys: list[str]) -> DataFrame:
    """One row a box of the array column b, with the columns of FIELDS first."""
    out = kept.select(*keys, F.explode("b").alias("r"))
    return out.select(*[F.col(k) if k in keys else F.col(f"r.{k}") for k in FIELDS])


def above(dets: DataFrame, conf: float) -> DataFrame:
    """Detections with at least that score."""
    return dets.where(F.col("score") >= conf)


def nms(dets: DataFrame, threshold: float, *, class_agnostic: bool = False, eps: float | None = None) -> DataFrame:
    """Greedy suppression by falling score: a box goes if its IoU with a kept one is over the threshold."""
    keys = ["image_id"] if class_agnostic else ["image_id", "class_id"]
    boxes = _listed(dets, keys)
    none = F.slice("b", 1, 0)
    kept = F.aggregate("b", none, lambda acc, d: F.when(F.exists(acc, lambda k: iou(k, d, eps=eps) > threshold), acc).otherwise(F.array_append(acc, d)))
    return _rows(boxes.select(*keys, kept.alias("b")), keys)


def cluster(dets: DataFrame, threshold: float) -> DataFrame:
    """Detections with a column `cluster`: the least det_id that a chain of same-class boxes with IoU >= threshold reaches.

    Chains never leave an image and class, so each is labelled by a fold: a box
    merges all clusters it touches.
    """
    keys = ["image_id", "class_id"]
    boxes = _listed(dets, keys)
    none = F.transform(F.slice("b", 1, 0), lambda d: F.struct(d.alias("d"), d["det_id"].alias("c")))

    def add(acc: Column, d: Column) -> Column:
        def merged(touched: Column) -> Column:
            to = F.array_min(F.array_append(touched, d["det_id"]))
            moved = F.transform(acc, lambda m: F.struct(m["d"].alias("d"), F.when(F.array_contains(touched, m["c"]), to).otherwise(m["c"]).alias("c")))
            return F.array_append(moved, F.struct(d.alias("d"), to.alias("c")))

        touched = F.transform(F.filter(acc, lambda m: iou(m["d"], d) >= threshold), lambda m: m["c"])
        return F.transform(F.array(touched), merged)[0]

    labelled = boxes.select(*keys, F.aggregate("b", none, add).alias("b")).select(*keys, F.explode("b").alias("r"))
    return labelled.select(*[F.col(k) if k in keys else F.col(f"r.d.{k}") for k in FIELDS], F.col("r.c").alias("cluster"))


def fused(clustered: DataFrame, keys: tuple[str, ...] = ("image_id", "class_id", "cluster")) -> DataFrame:
    """One box a cluster: score-weighted mean corners and the highest score; null corners where all scores are 0."""
    mean = {c: F.try_divide(F.sum(F.col(c) * F.col("score")), F.sum("score")).alias(c) for c in ("x1", "y1", "x2", "y2")}
    return clustered.groupBy(*keys).agg(*mean.values(), F.max("score").alias("score"), F.count("*").alias("n_boxes"))


def weighted_box_fusion(dets: DataFrame, threshold: float, skip: float = 0.0) -> DataFrame:
    """Boxes with score >= skip, clustered by chains of IoU >= threshold a class, each cluster fused; det_id is the cluster's."""
    return fused(cluster(above(dets, skip), threshold)).withColumnRenamed("cluster", "det_id")


def deduplicate(dets: DataFrame, threshold: float, generic: int, *, prioritize: bool = True, keep_all: bool = False) -> DataFrame:
    """Class-agnostic suppression where a generic box gives way to any overlapping specific one.

    Boxes go by falling score. A live specific box drops all later boxes with
    IoU >= threshold. A live generic box looks for the first live overlapping
    specific box behind it: with one, it drops the overlapping boxes before that
    one and then itself; without one, it drops all overlapping ones. keep_all
    returns the input. Without prioritize, classes make no difference.
    """
    if keep_all:
        return dets.select(*FIELDS)
    boxes = _listed(dets, ["image_id"])
    start = F.struct(F.slice("b", 1, 0).alias("kept"), F.col("b").alias("rest"))

    def step(acc: Column, _: Column) -> Column:
        others = F.slice(acc["rest"], 2, F.size(acc["rest"]))

        def with_first(here: Column) -> Column:
            def near(o: Column) -> Column:
                return overlaps(here, o) & (iou(here, o) >= threshold)

            is_generic = (here["class_id"] == generic) if prioritize else F.lit(False)
            better = F.when(is_generic, F.get(F.filter(others, lambda o: (o["class_id"] != generic) & near(o)), F.lit(0)))

            def left(stop: Column) -> Column:
                earlier = lambda o: (o["o"] < stop["o"]) | ((o["o"] == stop["o"]) & (o["det_id"] < stop["det_id"]))
                rest = F.filter(others, lambda o: ~((stop.isNull() | earlier(o)) & near(o)))
                return F.struct(F.when(stop.isNull(), F.array_append(acc["kept"], here)).otherwise(acc["kept"]).alias("kept"), rest.alias("rest"))

            return F.transform(F.array(better), left)[0]

        return F.when(F.size(acc["rest"]) == 0, acc).otherwise(F.transform(F.slice(acc["rest"], 1, 1), with_first)[0])

    kept = F.aggregate(F.sequence(F.lit(1), F.size("b")), start, step)["kept"]
    return _rows(boxes.select("image_id", kept.alias("b")), ["image_id"])


def confidence_filter(dets: DataFrame, conf: float, generic: int, threshold: float = 0.5) -> DataFrame:
    """One box of each group of a seed and the unused boxes that overlap it by IoU > threshold.

    Seeds go by class, then falling score. Of a group with two or more boxes
    over conf the best one stays, or the second if the best is generic; else the
    box with the highest score.
    """
    order = F.struct("class_id", (-F.col("score")).alias("o"), "det_id", "x1", "y1", "x2", "y2", "score")
    boxes = dets.groupBy("image_id").agg(F.sort_array(F.collect_list(order)).alias("b"))
    start = F.struct(F.slice("b", 1, 0).alias("kept"), F.col("b").alias("rest"))

    def step(acc: Column, _: Column) -> Column:
        def with_first(here: Column) -> Column:
            def near(o: Column) -> Column:
                return (o["det_id"] == here["det_id"]) | (overlaps(here, o) & (iou(here, o) > threshold))

            def chosen(group: Column) -> Column:
                # by falling score, then by class: the order of the boxes
                by_score = F.array_sort(F.transform(group, lambda d: F.struct(d["o"].alias("o"), d["class_id"].alias("c"), d.alias("d"))))
                high = F.filter(by_score, lambda g: -g["o"] > conf)
                return F.when((F.size(high) >= 2) & (high[0]["c"] == generic), high[1]["d"]).otherwise(by_score[0]["d"])

            best = F.transform(F.array(F.filter(acc["rest"], near)), chosen)[0]
            return F.struct(F.array_append(acc["kept"], best).alias("kept"), F.filter(acc["rest"], lambda o: ~near(o)).alias("rest"))

        return F.when(F.size(acc["rest"]) == 0, acc).otherwise(F.transform(F.slice(acc["rest"], 1, 1), with_first)[0])

    kept = F.aggregate(F.sequence(F.lit(1), F.size("b")), start, step)["kept"]
    return _rows(boxes.select("image_id", kept.alias("b")), ["image_id"])


def iou_pairs(dets: DataFrame, threshold: float, *, same_class: bool = True, strict: bool = False) -> DataFrame:
    """(image_id, a, b, iou) for the pairs of an image's boxes that overlap by the threshold or more (over it, if strict)."""
    a, b = dets.alias("a"), dets.alias("b")
    near = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.det_id") < F.col("b.det_id")) & overlaps(box(source="a"), box(source="b"))
    if same_class:
        near &= F.col("a.class_id") == F.col("b.class_id")
    value = iou(box(source="a"), box(source="b"))
    pairs = a.join(b, near).select("a.image_id", F.col("a.det_id").alias("a"), F.col("b.det_id").alias("b"), value.alias("iou"))
    return pairs.where(F.col("iou") > threshold if strict else F.col("iou") >= threshold)


def best_overlap(crops: DataFrame, full: DataFrame) -> DataFrame:
    """crops with max_iou: the largest IoU with a same-class full-image box, 0 if none."""
    a, b = crops.alias("a"), full.alias("b")
    near = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.class_id") == F.col("b.class_id")) & overlaps(box(source="a"), box(source="b"))
    value = iou(box(source="a"), box(source="b"))
    return a.join(b, near, "left").groupBy(*[F.col(f"a.{c}") for c in FIELDS]).agg(F.coalesce(F.max(value), F.lit(0.0)).alias("max_iou"))


def smart_crop_filter(crops: DataFrame, full: DataFrame, high: float = 0.85, low: float = 0.3) -> DataFrame:
    """Crop boxes that confirm a full-image box (max IoU >= high) or are new (< low)."""
    found = best_overlap(crops, full)
    return found.where((F.col("max_iou") >= high) | (F.col("max_iou") < low)).select(*FIELDS)


def merged(*sources: DataFrame) -> DataFrame:
    """All detections of the sources with fresh det_ids: source by source, then by the old one."""
    out = None
    for k, s in enumerate(sources):
        part = s.select(*[(F.col("det_id") * len(sources) + k).alias(c) if c == "det_id" else F.col(c) for c in FIELDS])
        out = part if out is None else out.unionByName(part)
    return out


def tile_grid(images: DataFrame, n: int, overlap: float, *, turn_portrait: bool = False) -> DataFrame:
    """(image_id, tile, x1, y1, x2, y2): n overlapping tiles in row-major order; portrait images can swap rows and columns."""
    rows, cols = grid_shape(n)
    turned = (F.col("height") > F.col("width")) if turn_portrait else F.lit(False)
    r, c = F.when(turned, F.lit(cols)).otherwise(F.lit(rows)), F.when(turned, F.lit(rows)).otherwise(F.lit(cols))
    cell_w = F.col("width") / (c - (c - 1) * overlap)
    cell_h = F.col("height") / (r - (r - 1) * overlap)
    t = images.select("image_id", "width", "height", cell_w.alias("cw"), cell_h.alias("ch"), c.alias("cols"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tile"))
    x = F.greatest(F.lit(0.0), F.pmod("tile", "cols") * F.col("cw") * (1 - overlap))
    y = F.greatest(F.lit(0.0), F.floor(F.col("tile") / F.col("cols")) * F.col("ch") * (1 - overlap))
    return t.select("image_id", "tile", x.alias("x1"), y.alias("y1"), F.least(F.col("width").cast("double"), x + F.col("cw")).alias("x2"), F.least(F.col("height").cast("double"), y + F.col("ch")).alias("y2"))


def to_image(dets: DataFrame, tiles: DataFrame) -> DataFrame:
    """Detections of tiles, with a column tile, in image coordinates."""
    origin = tiles.select("image_id", "tile", F.col("x1").alias("ox"), F.col("y1").alias("oy"))
    return dets.join(origin, ["image_id", "tile"]).withColumns(shifted(F.col("ox"), F.col("oy"))).select(*FIELDS)


def tiled(dets: DataFrame, *, iou_threshold: float = 0.5, conf: float = 0.0, fuse: bool = True, generic: int = 5) -> DataFrame:
    """Tile detections in image coordinates, fused or suppressed a class, then deduplicated."""
    d = above(dets, conf)
    d = weighted_box_fusion(d, iou_threshold).select(*FIELDS) if fuse else nms(d, iou_threshold)
    return deduplicate(d, iou_threshold, generic)


def multi_scale(dets: DataFrame, *, iou_threshold: float = 0.5, conf: float = 0.0, class_agnostic: bool = True, generic: int = 5) -> DataFrame:
    """The union of several scales, suppressed across classes, or within them and then deduplicated."""
    d = above(dets, conf)
    if class_agnostic:
        return nms(d, iou_threshold, class_agnostic=True, eps=1e-6)
    return deduplicate(nms(d, iou_threshold), iou_threshold, generic)


def augmented(dets: DataFrame, *, iou_threshold: float = 0.5, conf: float = 0.0, class_agnostic: bool = True, generic: int = 5) -> DataFrame:
    """Detections of augmented images, mapped back beforehand: suppressed, then deduplicated."""
    return deduplicate(nms(above(dets, conf), iou_threshold, class_agnostic=class_agnostic, eps=1e-6 if class_agnostic else None), iou_threshold, generic)


def hybrid(full: DataFrame, crops: DataFrame, *, iou_threshold: float = 0.5, conf: float = 0.25, tie: float = 0.5, generic: int = 5) -> dict[str, DataFrame]:
    """Full-image and crop detections in five stages; all stage outputs by name."""
    crops_raw = cut(weighted_box_fusion(crops, iou_threshold, conf).select(*FIELDS), "crops")
    full = above(full, conf)
    filtered = smart_crop_filter(crops_raw, full)
    filtered = cut(filtered, "filtered")
    union = merged(full.select(*FIELDS), filtered)
    fused_all = cut(weighted_box_fusion(union, iou_threshold).select(*FIELDS), "fused")
    return {"full": full, "crops_raw": crops_raw, "crops_filtered": filtered, "merged": fused_all, "final": confidence_filter(fused_all, tie, generic)}


def hybrid_simple(full: DataFrame, crops: DataFrame, *, iou_threshold: float = 0.5, conf: float = 0.25, generic: int = 5) -> DataFrame:
    """The shorter variant: union, fusion, deduplication."""
    return deduplicate(weighted_box_fusion(merged(full.select(*FIELDS), crops.select(*FIELDS)), iou_threshold, conf).select(*FIELDS), iou_threshold, generic)


#: Fusion methods by name, each DataFrame -> DataFrame with default parameters.
METHODS = {"tiled": tiled, "multi_scale": multi_scale, "augmented": augmented, "nms": lambda d, **p: nms(d, p.get("iou_threshold", 0.5))}


def method(name: str):
    """The registered fusion method; an unknown name is an error that lists the known ones."""
    if name not in METHODS:
        raise KeyError(f"{name}: not one of {', '.join(sorted(METHODS))}")
    return METHODS[name]


def compare_methods(dets: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(method, n, mean_score, elapsed_s) for each method: its detections and the seconds they took.

    The detections are made once and kept on the executors' disks, dealt by image as every method needs them;
    the first method's seconds include that.
    """
    rows = []
    dets = dets.select(*FIELDS).repartition("image_id").persist(StorageLevel.DISK_ONLY)
    try:
        for name in names or sorted(METHODS):
            began = time.monotonic()
            r = method(name)(dets).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")).first()
            rows.append((name, r["n"], r["mean_score"], time.monotonic() - began))
    finally:
        dets.unpersist()
    return dets.sparkSession.createDataFrame(rows, "method string, n long, mean_score double, elapsed_s double")


def ordered(dets: DataFrame) -> DataFrame:
    """Detections by falling score, then image and id; a distributed sort by ranges."""
    return dets.orderBy(F.desc("score"), "image_id", "det_id")
