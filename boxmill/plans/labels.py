"""Queries over label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators.lineage import cut
from .base import Views, query

#: Stand-in for label files: images with lines, and every other image an empty file.
FILES = "SELECT image_id FROM fx_image WHERE image_id % 2 = 0 UNION SELECT image_id FROM fx_label_line"
PARSED = """parsed AS (SELECT image_id, line_no, len(t) AS n_tokens, TRY_CAST(t[1] AS INT) AS class_id, TRY_CAST(t[2] AS DOUBLE) AS cx, TRY_CAST(t[3] AS DOUBLE) AS cy,
  TRY_CAST(t[4] AS DOUBLE) AS w, TRY_CAST(t[5] AS DOUBLE) AS h, line FROM (SELECT *, string_split(trim(line), ' ') AS t FROM fx_label_line)),
good AS (SELECT * FROM parsed WHERE n_tokens >= 5 AND class_id IS NOT NULL)"""


def files(v: Views) -> DataFrame:
    return v.fx_image.where("image_id % 2 = 0").select("image_id").union(v.fx_label_line.select("image_id")).distinct()


def parsed(v: Views) -> DataFrame:
    return L.parse_lines(v.fx_label_line)


def quota_report(v: Views) -> DataFrame:
    """The report of the quota split; the lines are parsed once."""
    lines = parsed(v)
    counts = cut(L.instances(lines), "instances")
    return L.split_report(lines, L.quota_split(v.fx_image, lines, counts=counts), counts=counts)


@query(f"+{PARSED} SELECT image_id, line_no, class_id, name, round(cx - w / 2, 6) AS x1, round(cy - h / 2, 6) AS y1, round(cx + w / 2, 6) AS x2, round(cy + h / 2, 6) AS y2 FROM good JOIN fx_class USING (class_id)", "fx_label_line fx_class")
def gold_boxes(v: Views) -> DataFrame:
    g = L.gold_boxes(v.fx_label_line, v.fx_class)
    return g.select("image_id", "line_no", "class_id", "name", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"+{PARSED} SELECT image_id, string_agg(name, ',' ORDER BY name) AS gt FROM (SELECT DISTINCT image_id, name FROM parsed JOIN fx_class USING (class_id)) GROUP BY image_id", "fx_label_line fx_class")
def gold_class_sets(v: Views) -> DataFrame:
    return L.gold_classes(v.fx_label_line, v.fx_class).withColumn("gt", F.array_join("gt", ","))


STATES = f"""+{PARSED}, files AS ({FILES}), boxes AS (SELECT image_id, count(*) AS n FROM parsed WHERE class_id IS NOT NULL GROUP BY 1),
states AS (SELECT i.image_id, i.split, f.image_id IS NOT NULL AS label_exists, coalesce(n, 0) AS n_boxes,
  CASE WHEN f.image_id IS NULL THEN 'missing' WHEN coalesce(n, 0) = 0 THEN 'empty' ELSE 'annotated' END AS state
  FROM fx_image i LEFT JOIN files f USING (image_id) LEFT JOIN boxes b ON b.image_id = i.image_id)"""


def states(v: Views) -> DataFrame:
    return L.label_states(v.fx_image, files(v), v.fx_label_line)


@query(f"{STATES} SELECT image_id, split, label_exists, n_boxes, state FROM states", "fx_image fx_label_line")
def label_states(v: Views) -> DataFrame:
    return states(v).select("image_id", "split", "label_exists", "n_boxes", "state")


@query(f"{STATES} SELECT split, count(*) AS images, count(*) FILTER (label_exists) AS labels, count(*) FILTER (state = 'empty') AS empty, count(*) FILTER (state = 'annotated') AS non_empty, count(*) FILTER (state = 'missing') AS missing FROM states GROUP BY split", "fx_image fx_label_line")
def dataset_structure(v: Views) -> DataFrame:
    return L.structure(states(v))


@query(f"{STATES} SELECT image_id, true AS label_exists, 0 AS n_boxes FROM states WHERE state = 'missing'", "fx_image fx_label_line")
def empty_labels_for_missing(v: Views) -> DataFrame:
    return L.as_empty(L.without_labels(v.fx_image, files(v))).select("image_id", "label_exists", F.col("n_boxes").cast("int").alias("n_boxes"))


@query("SELECT name, image_id, split FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, image_id) AS k FROM (SELECT image_id % 5000 AS name, image_id, split FROM fx_image)) WHERE k = 1", "fx_image")
def first_split_of_name(v: Views) -> DataFrame:
    return L.first_of_name(v.fx_image.select((F.col("image_id") % 5000).alias("name"), "image_id", "split"), "name")


@query(f"+{PARSED} SELECT image_id, class_id, count(*) AS n FROM good GROUP BY ALL", "fx_label_line")
def instances_per_image_and_class(v: Views) -> DataFrame:
    return L.instances(parsed(v))


@query(f"+{PARSED} SELECT class_id, count(*) AS n, count(DISTINCT image_id) AS n_images FROM good GROUP BY ALL", "fx_label_line")
def class_totals_and_frequency(v: Views) -> DataFrame:
    return L.class_totals(parsed(v)).join(L.class_frequency(parsed(v)), "class_id")


@query(f"+{PARSED}, o AS (SELECT DISTINCT image_id, class_id FROM good) SELECT a.class_id AS class_a, b.class_id AS class_b, count(*) AS n FROM o a JOIN o b ON a.image_id = b.image_id AND a.class_id <> b.class_id GROUP BY ALL", "fx_label_line")
def class_cooccurrence(v: Views) -> DataFrame:
    return L.cooccurrence(parsed(v))


@query(f"+{PARSED} SELECT i.image_id, c.class_id FROM fx_image i, fx_class c WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.image_id = i.image_id AND g.class_id = c.class_id)", "fx_image fx_label_line fx_class")
def absent_classes(v: Views) -> DataFrame:
    return L.absent_classes(v.fx_image, parsed(v), list(range(6)))


@query(f"+{PARSED} SELECT image_id, line_no, regexp_replace(trim(line), '^\\S+', '5') AS line FROM good", "fx_label_line")
def collapsed_lines(v: Views) -> DataFrame:
    return L.collapse_lines(v.fx_label_line, 5)


@query(f"""+{PARSED}, files AS ({FILES}), per AS (SELECT image_id, count(*) FILTER (n_tokens >= 5 AND class_id IS NOT NULL) AS kept, count(*) FILTER (NOT coalesce(n_tokens >= 5 AND class_id IS NOT NULL, false)) AS skipped FROM parsed GROUP BY 1)
SELECT split, count(*) AS images, count(*) FILTER (kept > 0) AS converted, count(*) FILTER (f.image_id IS NOT NULL AND coalesce(kept, 0) = 0) AS empty, count(*) FILTER (f.image_id IS NULL) AS missing,
  coalesce(sum(kept), 0)::BIGINT AS kept, coalesce(sum(skipped), 0)::BIGINT AS skipped FROM fx_image i LEFT JOIN files f USING (image_id) LEFT JOIN per p ON p.image_id = i.image_id GROUP BY split""", "fx_image fx_label_line")  # fmt: skip
def collapse_statistics(v: Views) -> DataFrame:
    return L.collapse_report(v.fx_image, files(v), v.fx_label_line)


@query(f"""+{PARSED}, im AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY file_name) AS coco_id FROM fx_image),
b AS (SELECT split, coco_id, line_no, class_id, round(greatest((cx - w / 2) * width, 0), 2) AS x, round(greatest((cy - h / 2) * height, 0), 2) AS y,
  round(least(w * width, width - greatest((cx - w / 2) * width, 0)), 2) AS bw, round(least(h * height, height - greatest((cy - h / 2) * height, 0)), 2) AS bh FROM good JOIN im USING (image_id))
SELECT split, row_number() OVER (PARTITION BY split ORDER BY coco_id, line_no) AS id, coco_id AS image, class_id + 1 AS category_id, round(x, 1) AS bbox_x, round(y, 1) AS bbox_y, round(bw, 1) AS bbox_w, round(bh, 1) AS bbox_h FROM b""", "fx_image fx_label_line")  # fmt: skip
def coco_annotations(v: Views) -> DataFrame:
    a = L.coco_annotations(v.fx_image, v.fx_label_line)
    return a.select("split", "id", "image", "category_id", *[F.round(f"bbox_{c}", 1).alias(f"bbox_{c}") for c in ("x", "y", "w", "h")])


QUOTA = f"""+{PARSED}, tot AS (SELECT class_id, count(*) AS total FROM good GROUP BY 1), per AS (SELECT image_id, class_id, count(*) AS n FROM good GROUP BY ALL),
r AS (SELECT image_id, class_id AS stratum, n FROM (SELECT per.*, row_number() OVER (PARTITION BY image_id ORDER BY total, class_id) AS k FROM per JOIN tot USING (class_id)) WHERE k = 1),
u AS (SELECT *, sum(n) OVER (PARTITION BY stratum ORDER BY md5('42:' || image_id), image_id ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY stratum) AS al FROM r),
split AS (SELECT image_id, stratum, CASE WHEN upto <= CAST(0.7 AS DOUBLE) * al THEN 'train' WHEN upto <= (CAST(0.7 AS DOUBLE) + CAST(0.2 AS DOUBLE)) * al THEN 'val' ELSE 'test' END AS split FROM u)"""


@query(f"{QUOTA} SELECT image_id, stratum, split FROM split", "fx_label_line")
def stratified_split(v: Views) -> DataFrame:
    return L.quota_split(v.fx_image, parsed(v))


@query(f"""{QUOTA}, used AS (SELECT g.class_id, s.split, count(*) AS used FROM good g JOIN split s USING (image_id) GROUP BY ALL), t AS (SELECT class_id, sum(used)::BIGINT AS total FROM used GROUP BY 1)
SELECT class_id, split, used, CASE split WHEN 'train' THEN floor(total * CAST(0.7 AS DOUBLE)) WHEN 'val' THEN floor(total * CAST(0.2 AS DOUBLE)) ELSE total - floor(total * CAST(0.7 AS DOUBLE)) - floor(total * CAST(0.2 AS DOUBLE)) END::BIGINT AS target, total FROM used JOIN t USING (class_id)""", "fx_label_line")  # fmt: skip
def split_quota_report(v: Views) -> DataFrame:
    return quota_report(v)


@query(f"""{QUOTA}, used AS (SELECT g.class_id, s.split, count(*) AS used FROM good g JOIN split s USING (image_id) GROUP BY ALL), t AS (SELECT class_id, sum(used)::BIGINT AS total FROM used GROUP BY 1),
rep AS (SELECT split, used, CASE split WHEN 'train' THEN floor(total * CAST(0.7 AS DOUBLE)) WHEN 'val' THEN floor(total * CAST(0.2 AS DOUBLE)) ELSE total - floor(total * CAST(0.7 AS DOUBLE)) - floor(total * CAST(0.2 AS DOUBLE)) END AS target FROM used JOIN t USING (class_id))
SELECT split, round(avg(least(1.0::DOUBLE, used::DOUBLE / target)), 6) AS fill FROM rep WHERE target > 0 GROUP BY split""", "fx_label_line")  # fmt: skip
def split_mean_fill(v: Views) -> DataFrame:
    return L.mean_fill(quota_report(v)).withColumn("fill", F.round("fill", 6))


@query(f"""{STATES}, neg AS (SELECT image_id, row_number() OVER (ORDER BY md5('42:' || image_id), image_id) AS k, count(*) OVER () AS n FROM states WHERE state <> 'annotated')
SELECT image_id, CASE WHEN k <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN k <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM neg""", "fx_image fx_label_line")  # fmt: skip
def hard_negative_slices(v: Views) -> DataFrame:
    return L.slice_hard_negatives(states(v).where("state <> 'annotated'"))


#: The sequential rule of the greedy split, an image a step: what each split holds of each class is in u0_0 to u2_5.
CLASSES, PARTS = range(6), range(3)
USED = [(s, c) for s in PARTS for c in CLASSES]
FITS = [" AND ".join(f"u{s}_{c} + n{c} <= q{s}_{c}" for c in CLASSES) for s in PARTS]
GREEDY = f"""+{PARSED}, im AS (SELECT image_id, row_number() OVER (ORDER BY md5('42:' || image_id), image_id) AS k, {", ".join(f"count(*) FILTER (class_id = {c}) AS n{c}" for c in CLASSES)} FROM good GROUP BY image_id),
tot AS (SELECT {", ".join(f"sum(n{c}) AS t{c}" for c in CLASSES)} FROM im),
q AS (SELECT {", ".join(f"floor(t{c} * CAST(0.7 AS DOUBLE)) AS q0_{c}, floor(t{c} * CAST(0.2 AS DOUBLE)) AS q1_{c}, t{c} - floor(t{c} * CAST(0.7 AS DOUBLE)) - floor(t{c} * CAST(0.2 AS DOUBLE)) AS q2_{c}" for c in CLASSES)} FROM tot),
st AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS image_id, NULL::INT AS s, {", ".join(f"0::BIGINT AS u{s}_{c}" for s, c in USED)}
  UNION ALL SELECT k, image_id, s, {", ".join(f"u{s}_{c} + CASE WHEN s = {s} THEN n{c} ELSE 0 END" for s, c in USED)}
  FROM (SELECT im.*, {", ".join(f"u{s}_{c}" for s, c in USED)}, CASE {" ".join(f"WHEN {FITS[s]} THEN {s}" for s in PARTS)} END AS s FROM st JOIN im ON im.k = st.k + 1, q))
SELECT image_id, CASE s WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'train' END AS split, s IS NOT NULL AS fits FROM st WHERE k > 0"""


@query(GREEDY, "fx_label_line", recursive=True)
def greedy_split(v: Views) -> DataFrame:
    return L.greedy_split(parsed(v))
