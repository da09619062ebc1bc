"""Regions as pixel tables: image_id, x, y and a value or colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def mask(pixels: DataFrame, inside: Column) -> DataFrame:
    """A mask of 0 and 255 where the predicate holds."""
    return pixels.select("image_id", "x", "y", F.when(inside, 255).otherwise(0).alias("v"))


def union_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels in either mask."""
    return a.where("v > 0").select("image_id", "x", "y").union(b.where("v > 0").select("image_id", "x", "y")).distinct()


def common_to(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels in both masks."""
    return a.where("v > 0").select("image_id", "x", "y").intersect(b.where("v > 0").select("image_id", "x", "y"))


def coverage(masks: DataFrame) -> DataFrame:
    return masks.groupBy("image_id").agg((F.avg("v") / 255).alias("coverage"))


def covered_images(masks: DataFrame, least: float = 0.4) -> DataFrame:
    """Images of which at least that share is inside."""
    return coverage(masks).where(F.col("coverage") >= least)


def mask_box(masks: DataFrame, width: int, height: int, over: int = 127) -> DataFrame:
    """Normalised centre and size of the pixels over the limit; sizes are max - min. Images without such pixels go."""
    b = masks.where(F.col("v") > over).groupBy("image_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return b.select("image_id", ((F.col("lo_x") + F.col("hi_x")) / 2 / width).alias("cx"), ((F.col("lo_y") + F.col("hi_y")) / 2 / height).alias("cy"), ((F.col("hi_x") - F.col("lo_x")) / width).alias("w"), ((F.col("hi_y") - F.col("lo_y")) / height).alias("h"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(image_id, threshold): the grey value that parts an image's histogram with the largest variance between the sides; the least one on ties."""
    h = pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image_id")
    upto = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"n0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("v")).over(upto), "n_all": F.sum("n").over(w), "s_all": F.sum(F.col("n") * F.col("v")).over(w)})
    n1, s1 = F.col("n_all") - F.col("n0"), F.col("s_all") - F.col("s0")
    gap = (F.col("s0") * n1 - s1 * F.col("n0")).cast("double")
    h = h.where(n1 > 0).withColumn("between", gap * gap / (F.col("n0") * n1))
    return h.groupBy("image_id").agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("threshold"))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0..180, saturation and value 0..255 of 8-bit colours."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    hue = F.when(d == 0, F.lit(0.0)).when(hi == r, 60 * (g - b) / d).when(hi == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d)
    hue = F.when(hue < 0, hue + 360).otherwise(hue)
    return F.round(hue / 2), F.when(hi == 0, F.lit(0.0)).otherwise(F.round(255 * d / hi)), hi


def water_colour(r: Column, g: Column, b: Column, y: Column, height: Column) -> Column:
    """Whether a pixel has a water colour and is no sky: fixed limits of hue, saturation, value and place."""
    h, s, v = hsv(r, g, b)
    blue = h.between(55, 165) & (s >= 5) & v.between(10, 245)
    grey = (s < 15) & (b >= r - 5) & (b >= g - 10) & v.between(30, 200)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y / height - 0.10) / 0.40))
    sky = (y < F.floor(height * 0.10)) | ((y < height * 0.5) & (v > 140 + t * 80))
    warm = ((h < 30) | (h > 160)) & (s > 20)
    return (blue | grey) & ~sky & ~warm


def water_region(pixels: DataFrame, boxes: DataFrame, width: int, height: int, margin: int = 30) -> DataFrame:
    """boxes (image_id, box_no, x1, y1, x2, y2) with inside: the box looks like water.

    The box grown by the margin must lie inside the image and have its centre
    below the top 15 %. Hue, saturation and value are averaged over its pixels
    (image_id, x, y, r, g, b), which meet the boxes by image and range: a mean
    water colour, or a grey whose blue is at most 5 under its red, of medium value.
    """
    grown = boxes.select("image_id", "box_no", *[(F.col(c) - margin).alias(c) for c in ("x1", "y1")], *[(F.col(c) + margin).alias(c) for c in ("x2", "y2")], ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    grown = grown.where((F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") < width) & (F.col("y2") < height) & (F.col("cy") >= 0.15 * height))
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    p = pixels.select("image_id", "x", "y", "r", "b", h.alias("h"), s.alias("s"), v.alias("v"))
    hit = (F.col("p.image_id") == F.col("b.image_id")) & (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    mean = grown.alias("b").join(p.alias("p"), hit).groupBy("b.image_id", "box_no").agg(*[F.avg(f"p.{c}").alias(c) for c in ("h", "s", "v", "r", "b")])
    colour = (F.col("h").between(55, 165) & (F.col("s") >= 5)) | ((F.col("s") < 15) & (F.col("b") >= F.col("r") - 5))
    mean = mean.select("image_id", "box_no", (colour & (F.col("v") > 10) & (F.col("v") < 245)).alias("_ok"))
    out = boxes.join(mean, ["image_id", "box_no"], "left")
    return out.select("image_id", "box_no", F.coalesce("_ok", F.lit(False)).alias("inside"))


def pixel_components(pixels: DataFrame) -> DataFrame:
    """(image_id, x, y, component) of the pixels given: 8-neighbours are connected, the component is its least y, then x, as y * 2**20 + x.

    Labels fall to the least of the neighbourhood, then to the label of the
    label, so a region of n pixels takes about log n rounds.
    """
    code = F.col("y").cast("long") * 2**20 + F.col("x")
    p = cut(pixels.select("image_id", "x", "y", code.alias("p")).distinct(), "pixels")
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    offsets = F.lit([dy * 2**20 + dx for dx, dy in steps])
    edges = p.select("image_id", "p", F.explode(F.transform(offsets, lambda d: d.cast("long") + F.col("p"))).alias("q"))
    edges = cut(edges.join(p.select("image_id", F.col("p").alias("q")), ["image_id", "q"]), "edges")
    labels = cut(p.select("image_id", "p", F.col("p").alias("l")), "labels")
    while True:
        near = edges.join(labels.select("image_id", F.col("p").alias("q"), F.col("l").alias("m")), ["image_id", "q"]).groupBy("image_id", "p").agg(F.min("m").alias("m"))
        low = labels.join(near, ["image_id", "p"], "left").select("image_id", "p", "l", F.least("l", F.coalesce("m", "l")).alias("m"))
        jump = labels.select("image_id", F.col("p").alias("m"), F.col("l").alias("j"))
        new = cut(low.join(jump, ["image_id", "m"]).select("image_id", "p", F.col("l").alias("old"), F.least("m", "j").alias("l")), "labels")
        changed = not new.where("old <> l").isEmpty()
        labels = new.drop("old")
        if not changed:
            break
    return p.join(labels, ["image_id", "p"]).select("image_id", "x", "y", F.col("l").alias("component"))


def component_areas(components: DataFrame) -> DataFrame:
    return components.groupBy("image_id", "component").agg(F.count("*").alias("area"))


def without_small(components: DataFrame, pixels_per_image: int, ratio: float) -> DataFrame:
    """Pixels of the components of at least int(pixels * ratio)."""
    large = component_areas(components).where(F.col("area") >= int(pixels_per_image * ratio)).select("image_id", "component")
    return components.join(large, ["image_id", "component"], "left_semi")


def largest(components: DataFrame) -> DataFrame:
    """(image_id, component, area) of each image's largest component, the least component on ties."""
    a = component_areas(components)
    return a.groupBy("image_id").agg(F.max_by(F.struct("component", "area"), F.struct("area", -F.col("component"))).alias("b")).select("image_id", "b.*")


def changed_box(before: DataFrame, after: DataFrame, over: int, width: int, height: int) -> DataFrame:
    """The box of the largest connected change between two versions of an image."""
    d = before.alias("a").join(after.alias("b"), ["image_id", "x", "y"]).where(F.abs(F.col("a.v") - F.col("b.v")) > over).select("image_id", "x", "y")
    c = pixel_components(d)
    kept = c.join(largest(c).select("image_id", "component"), ["image_id", "component"], "left_semi")
    return mask_box(kept.withColumn("v", F.lit(255)), width, height)


def region_overlaps(regions: DataFrame) -> DataFrame:
    """(group_id, a, b, iou) for the regions (group_id, region_id, x, y) of a group that share pixels."""
    n = regions.groupBy("group_id", "region_id").agg(F.count("*").alias("n"))
    a, b = regions.alias("a"), regions.alias("b")
    same = (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.region_id") < F.col("b.region_id"))
    both = a.join(b, same).groupBy("a.group_id", F.col("a.region_id").alias("a"), F.col("b.region_id").alias("b")).agg(F.count("*").alias("both"))
    both = both.join(n.select("group_id", F.col("region_id").alias("a"), F.col("n").alias("na")), ["group_id", "a"]).join(n.select("group_id", F.col("region_id").alias("b"), F.col("n").alias("nb")), ["group_id", "b"])
    return both.select("group_id", "a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("iou"))


def region_nms(regions: DataFrame, overlaps: DataFrame, threshold: float) -> DataFrame:
    """(group_id, region_id, score) kept by falling score: a region stays if its IoU with all kept ones is under the threshold.

    regions: one row a region. Only the pairs at or over the threshold matter.
    """
    close = overlaps.where(F.col("iou") >= threshold)
    near = close.select("group_id", F.col("a").alias("region_id"), F.col("b").alias("o")).unionByName(close.select("group_id", F.col("b").alias("region_id"), F.col("a").alias("o")))
    near = near.groupBy("group_id", "region_id").agg(F.collect_set("o").alias("near"))
    r = regions.join(near, ["group_id", "region_id"], "left").groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "region_id", "near"))).alias("r"))
    kept = F.aggregate("r", F.slice("r", 1, 0), lambda acc, d: F.when(F.exists(acc, lambda k: F.coalesce(F.array_contains(d["near"], k["region_id"]), F.lit(False))), acc).otherwise(F.array_append(acc, d)))
    return r.select("group_id", F.explode(kept).alias("k")).select("group_id", "k.region_id", (-F.col("k.o")).alias("score"))


def cluster_profiles(pixels: DataFrame, k: int, height: int, seed: int = 1) -> DataFrame:
    """Colour clusters over all pixels (image_id, x, y, r, g, b) with their means an image and whether they look like water."""
    return clustered(pixels, k, height, seed)[1]


def clustered(pixels: DataFrame, k: int, height: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The pixels with their cluster, and the profiles of the clusters in each image."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    p = pixels.withColumn("place", F.col("y") / height * 255)
    p = VectorAssembler(inputCols=["r", "g", "b", "place"], outputCol="features").transform(p)
    p = KMeans(k=k, seed=seed, predictionCol="cluster").fit(p).transform(p).drop("features")
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    m = p.withColumns({"h": h, "s": s, "v": v}).groupBy("image_id", "cluster").agg(*[F.avg(c).alias(c) for c in ("h", "s", "v", "r", "b")], (F.avg("y") / height).alias("at"))
    colour = (F.col("h").between(50, 170) & (F.col("s") >= 3)) | ((F.col("s") < 15) & (F.col("b") >= F.col("r") - 5))
    warm = ((F.col("h") < 30) | (F.col("h") > 160)) & (F.col("s") > 25)
    return p, m.withColumn("water", colour & (F.col("at") >= 0.30) & (F.col("v") < 210) & ~warm)


def otsu_mask(pixels: DataFrame) -> DataFrame:
    """(image_id, x, y, v): 255 over the image's Otsu threshold."""
    grey = F.floor((299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b")) / 1000).cast("int")
    p = pixels.select("image_id", "x", "y", grey.alias("v"))
    return mask(p.join(otsu(p), "image_id"), F.col("v") > F.col("threshold"))


def cluster_mask(pixels: DataFrame, height: int, k: int = 3) -> DataFrame:
    """(image_id, x, y, v): 255 where the pixel's colour cluster looks like water in its image."""
    p, profiles = clustered(pixels, k, height)
    wet = profiles.where("water").select("image_id", "cluster", F.lit(True).alias("wet"))
    return mask(p.join(wet, ["image_id", "cluster"], "left"), F.coalesce("wet", F.lit(False)))


#: Mask methods by name: pixels (image_id, x, y, r, g, b) and the image height to a mask.
MASKS = {
    "colour": lambda pixels, height: mask(pixels, predicate("colour", height)),
    "dark": lambda pixels, height: mask(pixels, predicate("dark", height)),
    "otsu": lambda pixels, height: otsu_mask(pixels),
    "clusters": cluster_mask,
}


def mask_by(name: str, pixels: DataFrame, height: int) -> DataFrame:
    """The mask of the registered method; an unknown name is an error that lists the known ones."""
    if name not in MASKS:
        raise KeyError(f"{name}: not one of {', '.join(sorted(MASKS))}")
    return MASKS[name](pixels, height)


#: Pixel predicates by name: columns r, g, b, y and the image height to a boolean Column.
PREDICATES = {
    "colour": lambda height: water_colour(F.col("r"), F.col("g"), F.col("b"), F.col("y"), F.lit(height)),
    "dark": lambda height: F.greatest("r", "g", "b") < 80,
}


def predicate(name: str, height: int) -> Column:
    if name not in PREDICATES:
        raise KeyError(f"{name}: not one of {', '.join(sorted(PREDICATES))}")
    return PREDICATES[name](height)
