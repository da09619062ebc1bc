"""Queries over pixel regions and placement plans, on 8 x 8 images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import placement as P
from ..operators import regions as R
from .base import Views, query

SIDE = 8
#: Sizes that suit the small images.
SIZES = {0: (2, 3, 2, 3), 1: (2, 4, 2, 2), 2: (3, 4, 2, 3)}


def masks(v: Views, over: int = 110) -> DataFrame:
    return R.mask(v.fx_pixel, F.col("v") >= over)


@query("SELECT image_id, round(avg(CASE WHEN v >= 110 THEN 255 ELSE 0 END) / 255, 6) AS coverage FROM fx_pixel GROUP BY image_id HAVING avg(CASE WHEN v >= 110 THEN 255 ELSE 0 END) / 255 >= 0.4", "fx_pixel")
def mask_coverage_gate(v: Views) -> DataFrame:
    return R.covered_images(masks(v)).withColumn("coverage", F.round("coverage", 6))


@query("SELECT image_id, (min(x) + max(x)) / 2.0::DOUBLE / 8 AS cx, (min(y) + max(y)) / 2.0::DOUBLE / 8 AS cy, (max(x) - min(x)) / 8.0::DOUBLE AS w, (max(y) - min(y)) / 8.0::DOUBLE AS h FROM fx_pixel WHERE v > 140 GROUP BY image_id", "fx_pixel")
def mask_boxes(v: Views) -> DataFrame:
    return R.mask_box(v.fx_pixel, SIDE, SIDE, 140)


@query("""+h AS (SELECT image_id, v, count(*) AS n FROM fx_pixel GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY image_id) AS na, sum(n * v) OVER (PARTITION BY image_id) AS sa FROM h WINDOW w AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, (s0 * (na - n0) - (sa - s0) * n0)::DOUBLE AS gap FROM c WHERE na > n0)
SELECT image_id, arg_max(v, (gap * gap / (n0 * (na - n0))::DOUBLE, -v)) AS threshold FROM g GROUP BY image_id""", "fx_pixel")
def otsu_threshold(v: Views) -> DataFrame:
    return R.otsu(v.fx_pixel)


COMPONENTS = """+p AS (SELECT image_id, x, y, y::BIGINT * 1048576 + x AS p FROM fx_pixel WHERE v >= 130),
reach AS (SELECT image_id, p AS u, x, y, p AS l FROM p UNION SELECT r.image_id, r.u, q.x, q.y, q.p FROM reach r JOIN p q ON q.image_id = r.image_id AND abs(q.x - r.x) <= 1 AND abs(q.y - r.y) <= 1),
comp AS (SELECT image_id, u, min(l) AS component FROM reach GROUP BY ALL)"""


def components(v: Views) -> DataFrame:
    return R.pixel_components(v.fx_pixel.where("v >= 130"))


@query(f"{COMPONENTS} SELECT image_id, component, count(*) AS area FROM comp GROUP BY ALL", "fx_pixel", recursive=True)
def region_components(v: Views) -> DataFrame:
    return R.component_areas(components(v))


@query(f"{COMPONENTS} SELECT image_id, count(*) AS pixels FROM comp WHERE (image_id, component) IN (SELECT (image_id, component) FROM (SELECT image_id, component, count(*) AS a FROM comp GROUP BY ALL) WHERE a >= 6) GROUP BY image_id", "fx_pixel", recursive=True)
def large_regions(v: Views) -> DataFrame:
    return R.without_small(components(v), SIDE * SIDE, 0.1).groupBy("image_id").agg(F.count("*").alias("pixels"))


@query(f"{COMPONENTS} SELECT image_id, arg_max(component, (area, -component)) AS component, max(area) AS area FROM (SELECT image_id, component, count(*) AS area FROM comp GROUP BY ALL) GROUP BY image_id", "fx_pixel", recursive=True)
def largest_region(v: Views) -> DataFrame:
    return R.largest(components(v))


def regions(v: Views) -> DataFrame:
    """Pixels over a limit of ten images as the regions of one group."""
    return v.fx_pixel.where("v >= 120").select(F.floor(F.col("image_id") / 10).alias("group_id"), F.col("image_id").alias("region_id"), "x", "y")


OVERLAPS = """+r AS (SELECT image_id // 10 AS group_id, image_id AS region_id, x, y FROM fx_pixel WHERE v >= 120), n AS (SELECT region_id, count(*) AS n FROM r GROUP BY 1),
ov AS (SELECT a.group_id, a.region_id AS a, b.region_id AS b, count(*)::DOUBLE / (max(na.n) + max(nb.n) - count(*)) AS iou FROM r a JOIN r b ON a.group_id = b.group_id AND a.x = b.x AND a.y = b.y AND a.region_id < b.region_id
 JOIN n na ON na.region_id = a.region_id JOIN n nb ON nb.region_id = b.region_id GROUP BY ALL)"""


@query(f"{OVERLAPS} SELECT group_id, a, b, round(iou, 6) AS iou FROM ov", "fx_pixel")
def region_overlaps(v: Views) -> DataFrame:
    return R.region_overlaps(regions(v)).withColumn("iou", F.round("iou", 6))


@query(f"""{OVERLAPS}, s AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, region_id) AS k FROM (SELECT group_id, region_id, (region_id * 7919 % 101)::DOUBLE AS score FROM r GROUP BY ALL)),
st AS (SELECT group_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM (SELECT DISTINCT group_id FROM s) UNION ALL
 SELECT t.group_id, s.k, CASE WHEN EXISTS (SELECT 1 FROM ov WHERE iou >= 0.5 AND (ov.a = s.region_id AND list_contains(t.kept, ov.b) OR ov.b = s.region_id AND list_contains(t.kept, ov.a))) THEN t.kept ELSE list_append(t.kept, s.region_id) END
 FROM st t JOIN s ON s.group_id = t.group_id AND s.k = t.k + 1)
SELECT group_id, unnest(max_by(kept, k)) AS region_id FROM st GROUP BY group_id""", "fx_pixel", recursive=True)  # fmt: skip
def region_nms(v: Views) -> DataFrame:
    r = regions(v).select("group_id", "region_id").distinct().withColumn("score", (F.col("region_id") * 7919 % 101).cast("double"))
    return R.region_nms(r, R.region_overlaps(regions(v)), 0.5).select("group_id", "region_id")


def colours(v: Views) -> DataFrame:
    """Three grey images in turn as red, green and blue."""
    p = v.fx_pixel.withColumns({"c": F.pmod("image_id", F.lit(3)), "image_id": F.floor(F.col("image_id") / 3)})
    return p.groupBy("image_id", "x", "y").pivot("c", [0, 1, 2]).agg(F.first("v")).select("image_id", "x", "y", *[F.col(str(k)).alias(c) for k, c in enumerate("rgb")]).na.drop()


RGB = """+rgb AS (SELECT image_id // 3 AS image_id, x, y, max(v) FILTER (image_id % 3 = 0) AS r, max(v) FILTER (image_id % 3 = 1) AS g, max(v) FILTER (image_id % 3 = 2) AS b FROM fx_pixel GROUP BY ALL HAVING count(*) = 3),
hs0 AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM rgb),
hs1 AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN 60 * (g - b) / d::DOUBLE WHEN v = g THEN 120 + 60 * (b - r) / d::DOUBLE ELSE 240 + 60 * (r - g) / d::DOUBLE END AS hue FROM hs0),
hs AS (SELECT *, round(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2) AS h, CASE WHEN v = 0 THEN 0 ELSE round(255 * d / v::DOUBLE) END AS s FROM hs1)"""


@query(f"""{RGB} SELECT image_id, x, y FROM hs WHERE ((h BETWEEN 55 AND 165 AND s >= 5 AND v BETWEEN 10 AND 245) OR (s < 15 AND b >= r - 5 AND b >= g - 10 AND v BETWEEN 30 AND 200))
 AND NOT (y < 0 OR (y < 4 AND v > 140 + greatest(0, least(1, (y / 8.0::DOUBLE - 0.10) / 0.40)) * 80)) AND NOT ((h < 30 OR h > 160) AND s > 20)""", "fx_pixel")  # fmt: skip
def water_colour_pixels(v: Views) -> DataFrame:
    return colours(v).where(R.predicate("colour", SIDE)).select("image_id", "x", "y")


@query(f"""{RGB}, w AS (SELECT image_id, x, y, h BETWEEN 55 AND 165 AND s >= 5 AS a, v < 80 AS b FROM hs)
SELECT image_id, count(*) FILTER (a OR b) AS in_either, count(*) FILTER (a AND b) AS in_both FROM w GROUP BY image_id HAVING count(*) FILTER (a OR b) > 0""", "fx_pixel")  # fmt: skip
def mask_set_operations(v: Views) -> DataFrame:
    c = colours(v)
    h, s, _ = R.hsv(F.col("r"), F.col("g"), F.col("b"))
    a, b = R.mask(c, h.between(55, 165) & (s >= 5)), R.mask(c, R.predicate("dark", SIDE))
    either, both = R.union_of(a, b).groupBy("image_id").agg(F.count("*").alias("in_either")), R.common_to(a, b).groupBy("image_id").agg(F.count("*").alias("in_both"))
    return either.join(both, "image_id", "left").na.fill(0)


@query(f"""{RGB}, bx AS (SELECT DISTINCT image_id, i.i AS box_no, 1 + 2 * (i.i % 3) AS x1, 1 + 2 * (i.i // 3) AS y1 FROM rgb, range(6) i(i)),
mn AS (SELECT bx.image_id, box_no, avg(h) AS h, avg(s) AS s, avg(v) AS v, avg(r) AS r, avg(b) AS b FROM bx JOIN hs ON hs.image_id = bx.image_id AND x >= x1 - 1 AND x < x1 + 4 AND y >= y1 - 1 AND y < y1 + 4 WHERE x1 + 4 < 8 AND y1 + 4 < 8 GROUP BY ALL)
SELECT bx.image_id, bx.box_no::INT AS box_no, coalesce(((h BETWEEN 55 AND 165 AND s >= 5) OR (s < 15 AND b >= r - 5)) AND v > 10 AND v < 245, false) AS inside FROM bx LEFT JOIN mn USING (image_id, box_no)""", "fx_pixel")  # fmt: skip
def water_region_test(v: Views) -> DataFrame:
    boxes = colours(v).select("image_id").distinct().withColumn("box_no", F.explode(F.sequence(F.lit(0), F.lit(5))))
    boxes = boxes.withColumns({"x1": 1 + 2 * (F.col("box_no") % 3), "y1": 1 + 2 * F.floor(F.col("box_no") / 3)}).withColumns({"x2": F.col("x1") + 3, "y2": F.col("y1") + 3})
    return R.water_region(colours(v), boxes, SIDE, SIDE, margin=1)


CHANGED = """+p AS (SELECT a.image_id // 2 AS image_id, a.x, a.y, a.y::BIGINT * 1048576 + a.x AS p FROM fx_pixel a JOIN fx_pixel b ON a.image_id + 1 = b.image_id AND a.image_id % 2 = 0 AND a.x = b.x AND a.y = b.y WHERE abs(a.v - b.v) > 20),
reach AS (SELECT image_id, p AS u, x, y, p AS l FROM p UNION SELECT r.image_id, r.u, q.x, q.y, q.p FROM reach r JOIN p q ON q.image_id = r.image_id AND abs(q.x - r.x) <= 1 AND abs(q.y - r.y) <= 1),
comp AS (SELECT image_id, u, min(l) AS component FROM reach GROUP BY ALL), ar AS (SELECT image_id, component, count(*) AS area FROM comp GROUP BY ALL),
big AS (SELECT image_id, arg_max(component, (area, -component)) AS component FROM ar GROUP BY image_id),
px AS (SELECT p.image_id, p.x, p.y FROM p JOIN comp ON comp.image_id = p.image_id AND comp.u = p.p JOIN big ON big.image_id = comp.image_id AND big.component = comp.component)"""


@query(f"{CHANGED} SELECT image_id, (min(x) + max(x)) / 2.0::DOUBLE / 8 AS cx, (min(y) + max(y)) / 2.0::DOUBLE / 8 AS cy, (max(x) - min(x)) / 8.0::DOUBLE AS w, (max(y) - min(y)) / 8.0::DOUBLE AS h FROM px GROUP BY image_id", "fx_pixel", recursive=True)
def changed_boxes(v: Views) -> DataFrame:
    p = v.fx_pixel
    a, b = (p.where(F.col("image_id") % 2 == k).withColumn("image_id", F.floor(F.col("image_id") / 2)) for k in (0, 1))
    return R.changed_box(a, b, 20, SIDE, SIDE)


@query("""+g AS (SELECT image_id // 3 AS image_id, x, y, max(v) FILTER (image_id % 3 = 0) AS r, max(v) FILTER (image_id % 3 = 1) AS g, max(v) FILTER (image_id % 3 = 2) AS b FROM fx_pixel GROUP BY ALL HAVING count(*) = 3),
p AS (SELECT image_id, x, y, (299 * r + 587 * g + 114 * b) // 1000 AS v FROM g), h AS (SELECT image_id, v, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY image_id) AS na, sum(n * v) OVER (PARTITION BY image_id) AS sa FROM h WINDOW w AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, (s0 * (na - n0) - (sa - s0) * n0)::DOUBLE AS gap FROM c WHERE na > n0), t AS (SELECT image_id, arg_max(v, (gap * gap / (n0 * (na - n0))::DOUBLE, -v)) AS threshold FROM k GROUP BY image_id)
SELECT image_id, count(*) FILTER (v > threshold) AS inside FROM p JOIN t USING (image_id) GROUP BY image_id""", "fx_pixel")
def registered_masks(v: Views) -> DataFrame:
    return R.mask_by("otsu", colours(v), SIDE).groupBy("image_id").agg(F.count_if(F.col("v") > 0).alias("inside"))


@query()
def colour_clusters(v: Views) -> DataFrame:
    return R.cluster_profiles(colours(v), 3, SIDE).groupBy("water").agg(F.count("*").alias("n"))


def draw(*key: str) -> str:
    """placement.draw in SQL, with the seed of its default."""
    return f"(CAST('0x' || substr(md5('42:' || {" || ':' || ".join(key)}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


AT = ("image_id", "x", "y")
POSITIONS = f"""+m AS (SELECT image_id, x, y FROM fx_pixel WHERE v >= 110),
e AS (SELECT a.image_id, a.x, a.y FROM m a JOIN m b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 WHERE a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 GROUP BY ALL HAVING count(*) = 9),
c AS (SELECT *, CAST(floor({draw(*AT, "'class'")} * 3) AS INT) AS class_id FROM e),
z AS (SELECT *, [2, 2, 3][class_id + 1] + CAST(floor({draw(*AT, "'w'")} * [2, 3, 2][class_id + 1]) AS INT) AS w0, 2 + CAST(floor({draw(*AT, "'h'")} * [2, 1, 2][class_id + 1]) AS INT) AS h0, {draw(*AT, "'turn'")} < 0.3 AS t FROM c),
k AS (SELECT image_id, x, y, class_id, CASE WHEN t THEN h0 ELSE w0 END AS w, CASE WHEN t THEN w0 ELSE h0 END AS h FROM z),
b AS (SELECT *, greatest(0, x - w // 2) AS x0, greatest(0, y - h // 2) AS y0, least(8, x + w // 2) AS x1, least(8, y + h // 2) AS y1 FROM k),
ok AS (SELECT b.image_id, b.x, b.y, class_id, w, h FROM b JOIN m ON m.image_id = b.image_id AND m.x >= x0 AND m.x < x1 AND m.y >= y0 AND m.y < y1 GROUP BY b.image_id, b.x, b.y, class_id, w, h, x0, y0, x1, y1 HAVING count(*)::DOUBLE / ((x1 - x0) * (y1 - y0)) >= 0.85),
o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5('42:' || image_id || ':' || x || ':' || y), x, y) AS k FROM ok),
st AS (SELECT image_id, 0::BIGINT AS k, []::STRUCT(x INT, y INT)[] AS kept FROM (SELECT DISTINCT image_id FROM o)
 UNION ALL SELECT st.image_id, o.k, CASE WHEN len(kept) >= 3 OR len(list_filter(kept, lambda q: (q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) < 6.25)) > 0 THEN kept ELSE list_append(kept, {{'x': o.x, 'y': o.y}}) END FROM st JOIN o ON o.image_id = st.image_id AND o.k = st.k + 1),
fin AS (SELECT image_id, max_by(kept, k) AS kept FROM st GROUP BY image_id), pl AS (SELECT image_id, kept[i + 1].x AS x, kept[i + 1].y AS y, CAST(i AS INT) AS pos FROM (SELECT image_id, kept, unnest(range(0, len(kept))) AS i FROM fin)),
pos AS (SELECT image_id, x, y, pos, class_id, w, h FROM pl JOIN ok USING (image_id, x, y))"""


def positions(v: Views) -> DataFrame:
    return P.find_positions(masks(v), 3, SIZES, width=SIDE, height=SIDE, min_dist=2.5, margin=1)


@query(f"{POSITIONS} SELECT * FROM pos", "fx_pixel", recursive=True)
def placement_positions(v: Views) -> DataFrame:
    return positions(v)


@query(f"""{POSITIONS} SELECT image_id, x, y, pos, class_id, greatest(25, CAST(floor(w * (0.5::DOUBLE + 0.5::DOUBLE * y / 8)) AS INT)) AS w, greatest(20, CAST(floor(h * (0.5::DOUBLE + 0.5::DOUBLE * y / 8)) AS INT)) AS h,
 CASE WHEN {draw('image_id', 'pos', "'prompt'")} < 0.5 THEN 'a ' ELSE 'one ' END || name AS prompt FROM pos JOIN fx_class USING (class_id)""", "fx_pixel fx_class", recursive=True)  # fmt: skip
def placement_plan(v: Views) -> DataFrame:
    prompts = v.fx_class.select("class_id", F.explode(F.array(F.concat(F.lit("a "), "name"), F.concat(F.lit("one "), "name"))).alias("prompt"))
    return P.placement_plan(positions(v), prompts, SIDE)


@query(f"""+t AS (SELECT image_id, a.i AS attempt, CAST(floor({draw('image_id', 'a.i', "'x'")} * 6) AS INT) AS x0, CAST(floor({draw('image_id', 'a.i', "'y'")} * 6) AS INT) AS y0 FROM (SELECT DISTINCT image_id FROM fx_pixel), range(60) a(i)),
s AS (SELECT t.*, count(*) FILTER (v >= 110)::DOUBLE / 9 AS share FROM t JOIN fx_pixel p ON p.image_id = t.image_id AND p.x >= x0 AND p.x < x0 + 3 AND p.y >= y0 AND p.y < y0 + 3 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY attempt) AS k FROM s WHERE share >= 0.55)
SELECT image_id, CAST(attempt AS INT) AS attempt, x0, y0, x0 + 3 AS x1, y0 + 3 AS y1, round(share, 6) AS share FROM k WHERE k <= 4""", "fx_pixel")  # fmt: skip
def background_patches(v: Views) -> DataFrame:
    return P.background_patches(masks(v), 4, side=3, width=SIDE, height=SIDE).withColumn("share", F.round("share", 6))


@query(f"""+o AS (SELECT image_id || '_' || ann_no AS object, class_id, c.i AS copy FROM fx_box, range(2) c(i))
SELECT object, class_id, CAST(copy AS INT) AS copy, round(0.5::DOUBLE + {draw('object', 'copy', "'s'")} / 2, 6) AS scale, 'bg_' || CAST(floor({draw('object', 'copy', "'b'")} * 5) AS INT) AS background FROM o""", "fx_box")  # fmt: skip
def composition_plan(v: Views) -> DataFrame:
    backgrounds = v.spark.range(5).select(F.concat(F.lit("bg_"), F.col("id").cast("string")).alias("background"), F.col("id").alias("number"))
    return P.compositions(v.fx_box.select(F.concat_ws("_", "image_id", "ann_no").alias("object"), "class_id"), backgrounds, 2, "object")


@query("SELECT image_id, e.name AS experiment, e.steps, coalesce(e.guidance, 30.0::DOUBLE) AS guidance FROM fx_image, (VALUES ('a', 20, NULL::DOUBLE), ('b', 28, 40.0::DOUBLE), ('c', 50, 10.0::DOUBLE)) e(name, steps, guidance)", "fx_image")
def experiment_grid(v: Views) -> DataFrame:
    e = v.spark.createDataFrame([("a", 20, None), ("b", 28, 40.0), ("c", 50, 10.0)], "experiment string, steps int, guidance double")
    return P.run_plan(e.withColumn("guidance", F.coalesce("guidance", F.lit(30.0))), v.fx_image.select("image_id"))


@query("""+n AS (SELECT split, file_name, image_id % 2 AS side, row_number() OVER (PARTITION BY split, image_id % 2 ORDER BY file_name) AS k FROM fx_image)
SELECT a.split, a.k, a.file_name AS "left", b.file_name AS "right" FROM n a JOIN n b ON a.split = b.split AND a.k = b.k AND a.side = 0 AND b.side = 1""", "fx_image")
def zipped_pairs(v: Views) -> DataFrame:
    i = v.fx_image.select("split", "file_name", "image_id")
    return P.zipped(i.where("image_id % 2 = 0"), i.where("image_id % 2 = 1"), "split", "file_name")
