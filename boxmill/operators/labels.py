"""Label sets: validation, gold boxes and classes, states, collapse, COCO form.

Label lines are rows: image_id, line_no, line. Images are rows: image_id,
file_name, split, width, height. Classes are a small table: class_id, name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import centre_to_corners, coco_box
from ..functions.text import hash_order, trimmed
from . import admission
from .lineage import cut
from .ordering import bucket_rank, hash_rank, hash_running, range_rank

SPLITS = ("train", "val", "test")
#: Images whose annotations are numbered together.
OF_A_BUCKET = 4096


def parse_lines(lines: DataFrame, *, min_tokens: int = 5, mode: str = "skip") -> DataFrame:
    """Lines with n_tokens, class_id, cx, cy, w, h and ok; blank lines go.

    ok: at least min_tokens tokens, and a whole number first. mode `skip` drops
    the others, `count` keeps them, `raise` fails on the first one.
    """
    def fields(t: Column) -> Column:
        numbers = [F.get(t, F.lit(k)).try_cast("double").alias(name) for k, name in enumerate(("cx", "cy", "w", "h"), 1)]
        return F.struct(F.size(t).alias("n_tokens"), t[0].try_cast("int").alias("class_id"), *numbers)

    # a generator's rows are made once: as columns, each filter and join behind would split the line again
    full = F.filter(F.array(trimmed(F.col("line"))), lambda text: text != "")
    rows = F.transform(F.transform(full, lambda text: F.split(text, r"\s+")), fields)
    rows = F.transform(rows, lambda x: x.withField("ok", (x["n_tokens"] >= min_tokens) & x["class_id"].isNotNull()))
    made = ("n_tokens", "class_id", "cx", "cy", "w", "h", "ok")
    out = lines.select(*[c for c in lines.columns if c not in made], F.inline(F.filter(rows, lambda x: x["ok"]) if mode == "skip" else rows))
    if mode == "raise":
        return out.withColumn("ok", F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad label line: "), F.col("line"))).cast("boolean")))
    return out


def known(parsed: DataFrame, classes: DataFrame) -> DataFrame:
    """Lines of known classes, with their names."""
    return parsed.join(classes, "class_id")


def of_classes(parsed: DataFrame, ids: list[int]) -> DataFrame:
    """Lines of the classes with those ids."""
    return parsed.where(F.col("class_id").isin(list(ids)))


def gold_boxes(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """Corner boxes of the well-formed lines of known classes."""
    boxes = known(parse_lines(lines), classes)
    return boxes.select("image_id", "line_no", "class_id", "name", *[c.alias(k) for k, c in centre_to_corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")).items()])


def gold_classes(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """(image_id, gt): the sorted distinct class names of each image; only a line's first token must be good."""
    return known(parse_lines(lines, min_tokens=1), classes).groupBy("image_id").agg(F.sort_array(F.collect_set("name")).alias("gt"))


def label_states(images: DataFrame, label_files: DataFrame, lines: DataFrame) -> DataFrame:
    """Images with label_exists, n_boxes and state: missing, empty (a hard negative) or annotated."""
    boxes = parse_lines(lines, min_tokens=1).groupBy("image_id").agg(F.count("*").alias("n_boxes"))
    out = images.join(label_files.select("image_id").distinct().withColumn("label_exists", F.lit(True)), "image_id", "left").join(boxes, "image_id", "left")
    out = out.withColumns({"label_exists": F.coalesce("label_exists", F.lit(False)), "n_boxes": F.coalesce("n_boxes", F.lit(0))})
    return out.withColumn("state", F.when(~F.col("label_exists"), "missing").when(F.col("n_boxes") == 0, "empty").otherwise("annotated"))


def without_labels(images: DataFrame, label_files: DataFrame) -> DataFrame:
    return images.join(label_files.select("image_id"), "image_id", "left_anti")


def as_empty(missing: DataFrame) -> DataFrame:
    """Images without label file as hard negatives: the rows that creating empty files would add."""
    return missing.withColumns({"label_exists": F.lit(True), "n_boxes": F.lit(0).cast("long")})


def structure(states: DataFrame) -> DataFrame:
    """Per split: images, labels, empty, non-empty and missing label files."""
    return states.groupBy("split").agg(
        F.count("*").alias("images"), F.count_if("label_exists").alias("labels"), F.count_if(F.col("state") == "empty").alias("empty"),
        F.count_if(F.col("state") == "annotated").alias("non_empty"), F.count_if(F.col("state") == "missing").alias("missing"),
    )


def split_rank(c: Column) -> Column:
    return F.array_position(F.lit(list(SPLITS)), c)


def first_of_name(images: DataFrame, name: str) -> DataFrame:
    """One image a name: train before val before test."""
    w = Window.partitionBy(name).orderBy(split_rank(F.col("split")), "image_id")
    return images.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def instances(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("image_id", "class_id").agg(F.count("*").alias("n"))


def class_totals(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("class_id").agg(F.count("*").alias("n"))


def class_frequency(parsed: DataFrame) -> DataFrame:
    """Images a class occurs in."""
    return instances(parsed).groupBy("class_id").agg(F.count("*").alias("n_images"))


def cooccurrence(parsed: DataFrame) -> DataFrame:
    """(class_a, class_b, n): images that hold both, counted in both directions."""
    have = parsed.where("image_id is not null").groupBy("image_id").agg(F.collect_set("class_id").alias("have"))
    pairs = have.select("have", F.explode("have").alias("class_a")).select("class_a", F.explode("have").alias("class_b"))
    return pairs.where("class_a <> class_b").groupBy("class_a", "class_b").agg(F.count("*").alias("n"))


def absent_classes(images: DataFrame, parsed: DataFrame, class_ids: list[int]) -> DataFrame:
    """(image_id, class_id) for the classes that an image lacks."""
    here = parsed.groupBy("image_id").agg(F.collect_set("class_id").alias("have"))
    every = F.array(*[F.lit(c).cast("int") for c in class_ids])
    none = F.array().cast("array<int>")
    out = images.select("image_id").join(here, "image_id", "left")
    return out.select("image_id", F.explode(F.array_except(every, F.coalesce("have", none))).alias("class_id"))


def collapse_lines(lines: DataFrame, target: int) -> DataFrame:
    """Well-formed lines with their class replaced by target, the rest verbatim."""
    return parse_lines(lines).withColumn("line", F.regexp_replace(trimmed(F.col("line")), r"^\S+", str(target))).select("image_id", "line_no", "line")


def collapse_report(images: DataFrame, label_files: DataFrame, lines: DataFrame) -> DataFrame:
    """Per split: images, converted, empty and missing label files, kept and skipped lines."""
    parsed = parse_lines(lines, mode="count").groupBy("image_id").agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("skipped"))
    out = images.join(label_files.select("image_id").distinct().withColumn("has", F.lit(True)), "image_id", "left").join(parsed, "image_id", "left")
    return out.groupBy("split").agg(
        F.count("*").alias("images"), F.count_if(F.col("kept") > 0).alias("converted"), F.count_if(F.col("has") & (F.coalesce("kept", F.lit(0)) == 0)).alias("empty"),
        F.count_if(F.col("has").isNull()).alias("missing"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"),
    )


def coco_images(images: DataFrame) -> DataFrame:
    """Images with coco_id: 1 up in file-name order within a split."""
    return range_rank(images, ["file_name"], "coco_id", ["split"])


def coco_annotations(images: DataFrame, lines: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Annotations with ids from 1 within a split by image, then line; category is the class + 1. ids: coco_images(), if it is known."""
    i = coco_images(images) if ids is None else ids
    a = parse_lines(lines).join(i, "image_id").select("split", "coco_id", "line_no", "class_id", "cx", "cy", "w", "h", "width", "height")
    a = bucket_rank(a.withColumn("_at", F.floor(F.col("coco_id") / OF_A_BUCKET)), ["coco_id", "line_no"], "_at", "id", ["split"])
    boxes = coco_box(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    return a.select("split", "id", F.col("coco_id").alias("image"), (F.col("class_id") + 1).alias("category_id"), *[v.alias(f"bbox_{k}" if k != "area" else k) for k, v in boxes.items()])


def quota_split(images: DataFrame, parsed: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.2, 0.1), seed: int = 42, counts: DataFrame | None = None) -> DataFrame:
    """(image_id, stratum, split) of the annotated images. counts: instances(parsed), if they are known.

    An image belongs to its rarest class; in the order of a seeded hash the
    images of a class fill train up to its share of boxes, then val, then test.
    """
    counts = cut(instances(parsed), "instances") if counts is None else counts
    totals = counts.groupBy("class_id").agg(F.sum("n").alias("total"))
    per = counts.join(totals, "class_id")
    rarest = per.groupBy("image_id").agg(F.min(F.struct("total", "class_id", "n")).alias("r")).select("image_id", F.col("r.class_id").alias("stratum"), F.col("r.n").alias("n"))
    out = hash_running(rarest, seed, ["image_id"], F.col("n"), "upto", ["stratum"], "of")
    train, val, _ = ratios
    return out.select("image_id", "stratum", F.when(F.col("upto") <= F.lit(train) * F.col("of"), "train").when(F.col("upto") <= F.lit(train + val) * F.col("of"), "val").otherwise("test").alias("split"))


def greedy_split(parsed: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.2, 0.1), seed: int = 42) -> DataFrame:
    """(image_id, split, fits) by the greedy rule: in hash order an image goes to the first split where no class exceeds its target.

    Images that fit nowhere go to train with fits = false.
    """
    return admission.greedy_split(cut(instances(parsed), "instances"), SPLITS, ratios, seed)


def slice_hard_negatives(negatives: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.2, 0.1), seed: int = 42) -> DataFrame:
    """(image_id, split) of images without boxes: int(n * r) of them in hash order to train and val, the rest to test."""
    ranked = hash_rank(negatives.select("image_id"), seed, ["image_id"], "k", all_to="all")
    train, val = (F.floor(F.col("all") * F.lit(r)) for r in ratios[:2])
    return ranked.select("image_id", F.when(F.col("k") <= train, "train").when(F.col("k") <= train + val, "val").otherwise("test").alias("split"))


def split_report(parsed: DataFrame, assigned: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.2, 0.1), counts: DataFrame | None = None) -> DataFrame:
    """Per class and split: boxes used, target and total. counts: instances(parsed), if they are known."""
    counts = instances(parsed) if counts is None else counts
    used = counts.join(assigned.select("image_id", "split"), "image_id").groupBy("class_id", "split").agg(F.sum("n").alias("used"))
    total = used.groupBy("class_id").agg(F.sum("used").alias("total"))
    share = F.element_at(F.create_map(*[F.lit(x) for p in zip(SPLITS[:2], ratios[:2], strict=True) for x in p]), F.col("split"))
    tr, va = (F.floor(F.col("total") * F.lit(r)) for r in ratios[:2])
    target = F.when(F.col("split") == "test", F.col("total") - tr - va).otherwise(F.floor(F.col("total") * F.coalesce(share, F.lit(0.0))))
    return used.join(total, "class_id").select("class_id", "split", "used", target.cast("long").alias("target"), "total")


def mean_fill(report: DataFrame) -> DataFrame:
    """Per split: the mean over classes with a target of used over target, at most 1."""
    return report.where("target > 0").groupBy("split").agg(F.avg(F.least(F.lit(1.0), F.col("used") / F.col("target"))).alias("fill"))
