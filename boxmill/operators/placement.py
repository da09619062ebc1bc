"""Plans of synthetic placements: rows only, no images are made. All draws come from md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import scaled_size
from ..functions.text import hash_order
from .lineage import broadcast_below
from .ordering import range_rank

#: Fixed sizes in pixels a class: least and most width, least and most height.
SIZES = {0: (35, 65, 18, 35), 1: (50, 90, 35, 65), 2: (30, 60, 25, 50), 3: (50, 85, 40, 70), 4: (100, 180, 80, 140), 5: (30, 52, 22, 40)}


def draw(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key only."""
    return F.conv(F.substring(hash_order(seed, *key), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def integral(masks: DataFrame) -> DataFrame:
    """(image_id, x, y, s): mask pixels over 0 at or before x and y. masks has a row for each pixel."""
    rows = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    cols = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return masks.withColumn("s", F.sum((F.col("v") > 0).cast("int")).over(rows)).select("image_id", "x", "y", F.sum("s").over(cols).alias("s"))


def box_share(boxes: DataFrame, sums: DataFrame, to: str = "share") -> DataFrame:
    """boxes (image_id, x0, y0, x1, y1; half open, inside the image) with the share of their pixels in the mask: four look-ups."""
    out = boxes
    for n, (x, y) in enumerate((("x1", "y1"), ("x0", "y1"), ("x1", "y0"), ("x0", "y0"))):
        s = sums.select(F.col("image_id").alias("_i"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("s").alias(f"_s{n}"))
        out = out.join(s, (F.col("image_id") == F.col("_i")) & (F.col(x) - 1 == F.col("_x")) & (F.col(y) - 1 == F.col("_y")), "left").drop("_i", "_x", "_y")
    part = [F.coalesce(F.col(f"_s{n}"), F.lit(0)) for n in range(4)]
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return out.withColumn(to, F.try_divide(part[0] - part[1] - part[2] + part[3], area)).drop(*[f"_s{n}" for n in range(4)])


def eroded(masks: DataFrame, margin: int, width: int, height: int) -> DataFrame:
    """Pixels whose square of the margin around lies whole in the mask and the image."""
    p = masks.where((F.col("v") > 0) & (F.col("x") >= margin) & (F.col("y") >= margin) & (F.col("x") < width - margin) & (F.col("y") < height - margin))
    boxes = p.select("image_id", "x", "y", (F.col("x") - margin).alias("x0"), (F.col("y") - margin).alias("y0"), (F.col("x") + margin + 1).alias("x1"), (F.col("y") + margin + 1).alias("y1"))
    return box_share(boxes, integral(masks)).where("share = 1").select("image_id", "x", "y")


def thinned(candidates: DataFrame, n: int, min_dist: float, *, attempts: int = 500, seed: int = 42) -> DataFrame:
    """At most n candidates (image_id, x, y) an image, in hash order, each at least min_dist from those before."""
    order = hash_order(seed, F.col("image_id"), F.col("x"), F.col("y"))
    c = candidates.withColumn("_h", order).withColumn("_k", F.row_number().over(Window.partitionBy("image_id").orderBy("_h", "x", "y"))).where(F.col("_k") <= attempts)
    c = c.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("_k", "x", "y"))).alias("c"))
    far = F.aggregate("c", F.slice("c", 1, 0), lambda acc, p: F.when((F.size(acc) >= n) | F.exists(acc, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]) < min_dist), acc).otherwise(F.array_append(acc, p)))
    return c.select("image_id", F.posexplode(far).alias("pos", "p")).select("image_id", "pos", "p.x", "p.y")


def drawn_sizes(rows: DataFrame, sizes: dict[int, tuple[int, int, int, int]], key: list[str], seed: int = 42) -> DataFrame:
    """rows with class_id, w, h: class and size are uniform draws; three in ten are turned."""
    k = [F.col(c) for c in key]
    ids = sorted(sizes)
    out = rows.withColumn("class_id", F.lit(ids)[F.floor(draw(seed, *k, F.lit("class")) * len(ids)).cast("int")])
    table = F.create_map(*[x for i in ids for x in (F.lit(i), F.lit(list(sizes[i])))])
    s = table[F.col("class_id")]
    w = s[0] + F.floor(draw(seed, *k, F.lit("w")) * (s[1] - s[0] + 1)).cast("int")
    h = s[2] + F.floor(draw(seed, *k, F.lit("h")) * (s[3] - s[2] + 1)).cast("int")
    turn = draw(seed, *k, F.lit("turn")) < 0.3
    out = out.withColumns({"_w": w, "_h": h, "_t": turn})
    return out.withColumns({"w": F.when(F.col("_t"), F.col("_h")).otherwise(F.col("_w")), "h": F.when(F.col("_t"), F.col("_w")).otherwise(F.col("_h"))}).drop("_w", "_h", "_t")


def find_positions(masks: DataFrame, n: int, sizes: dict[int, tuple[int, int, int, int]], *, width: int, height: int, min_dist: float, margin: int, share: float = 0.85, seed: int = 42) -> DataFrame:
    """(image_id, pos, x, y, class_id, w, h): thinned safe places whose drawn footprint lies in the mask by that share."""
    c = drawn_sizes(eroded(masks, margin, width, height), sizes, ["image_id", "x", "y"], seed)
    half_w, half_h = F.floor(F.col("w") / 2).cast("int"), F.floor(F.col("h") / 2).cast("int")
    boxes = c.withColumns({"x0": F.greatest(F.lit(0), F.col("x") - half_w), "y0": F.greatest(F.lit(0), F.col("y") - half_h), "x1": F.least(F.lit(width), F.col("x") + half_w), "y1": F.least(F.lit(height), F.col("y") + half_h)})
    ok = box_share(boxes.where("x1 > x0 and y1 > y0"), integral(masks)).where(F.col("share") >= share)
    return thinned(ok.select("image_id", "x", "y"), n, min_dist, seed=seed).join(ok.select("image_id", "x", "y", "class_id", "w", "h"), ["image_id", "x", "y"])


def placement_plan(positions: DataFrame, prompts: DataFrame, height: int, seed: int = 42) -> DataFrame:
    """positions with depth-scaled sizes and a drawn prompt (class_id, prompt) of their class."""
    grown = positions.withColumns({k: v for k, v in scaled_size(F.col("w"), F.col("h"), F.col("y"), F.lit(height)).items()})
    numbered = prompts.withColumn("_k", F.row_number().over(Window.partitionBy("class_id").orderBy("prompt")) - 1)
    n = prompts.groupBy("class_id").agg(F.count("*").alias("_n"))
    picked = grown.join(broadcast_below(n), "class_id").withColumn("_k", F.floor(draw(seed, F.col("image_id"), F.col("pos"), F.lit("prompt")) * F.col("_n")).cast("int"))
    return picked.join(broadcast_below(numbered), ["class_id", "_k"]).drop("_k", "_n")


def background_patches(masks: DataFrame, n: int, *, side: int, width: int, height: int, share: float = 0.55, attempts: int = 60, seed: int = 42) -> DataFrame:
    """Up to n drawn squares an image that lie in the mask by that share, in the order of the draws."""
    t = masks.select("image_id").distinct().withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    x = F.floor(draw(seed, F.col("image_id"), F.col("attempt"), F.lit("x")) * (width - side + 1)).cast("int")
    y = F.floor(draw(seed, F.col("image_id"), F.col("attempt"), F.lit("y")) * (height - side + 1)).cast("int")
    b = t.withColumns({"x0": x, "y0": y}).withColumns({"x1": F.col("x0") + side, "y1": F.col("y0") + side})
    ok = box_share(b, integral(masks)).where(F.col("share") >= share)
    k = F.row_number().over(Window.partitionBy("image_id").orderBy("attempt"))
    return ok.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def compositions(objects: DataFrame, backgrounds: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows an object, each with a drawn background and scale; backgrounds (background, number from 0) meet by number."""
    pool = backgrounds.count()
    t = objects.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = t.withColumns({"number": F.floor(draw(seed, F.col(key), F.col("copy"), F.lit("b")) * pool).cast("long"), "scale": F.round(F.lit(0.5) + draw(seed, F.col(key), F.col("copy"), F.lit("s")) / 2, 6)})
    return t.join(backgrounds.withColumn("number", F.col("number").cast("long")), "number").drop("number")


def run_plan(experiments: DataFrame, images: DataFrame) -> DataFrame:
    """Each experiment over each image; experiments are a few rows."""
    return images.join(broadcast_below(experiments))


def zipped(left: DataFrame, right: DataFrame, by: str, name: str) -> DataFrame:
    """The i-th left and the i-th right row of each `by` value, in the order of names."""
    a, b = (range_rank(d.select(by, F.col(name).alias(n)), [n], "k", [by]) for d, n in ((left, "left"), (right, "right")))
    return a.join(b, [by, "k"])
