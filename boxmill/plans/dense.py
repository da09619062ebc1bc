"""Queries whose rows are those of the folds, made by grids and rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense as N
from .base import Views, twin_of

SHORT = ("image_id", "det_id", "class_id")


@twin_of("iou_pairs")
def dense_iou_pairs(v: Views) -> DataFrame:
    return N.named_pairs(v.fx_det, 0.3).select("image_id", "a", "b", F.floor(F.col("iou") * 1_000_000).alias("iou_ppm"))


@twin_of("smart_crop_filter")
def dense_crop_filter(v: Views) -> DataFrame:
    d = v.fx_det
    return N.smart_crop_filter(d.where("source = 1"), d.where("source = 0")).select(*SHORT, F.round("score", 6).alias("score"))


@twin_of("nms_classwise")
def dense_nms(v: Views) -> DataFrame:
    return N.nms(v.fx_det, 0.5).select(*SHORT, F.round("score", 6).alias("score"))


@twin_of("overlap_clusters")
def dense_clusters(v: Views) -> DataFrame:
    return N.cluster(v.fx_det, 0.5).select("image_id", "det_id", "cluster")
