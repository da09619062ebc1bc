"""Queries over detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import fusion as D
from .base import Views, query

IOU = """(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0)
 / (({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0){eps}))"""
AB = IOU.format(a="a.", b="b.", eps="")


def _nms_sql(part: str, eps: str, tail: str) -> str:
    """Greedy suppression as a recursion over ranks; kept boxes are a list; the rows are nms."""
    over = IOU.format(a="k.", b="d.", eps=eps)
    return f"""+d AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, det_id) AS r FROM fx_det),
st AS (SELECT {part}, 1::BIGINT AS r, [{{'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM d WHERE r = 1
  UNION ALL SELECT {', '.join('s.' + p for p in part.split(', '))}, d.r, CASE WHEN len(list_filter(s.kept, lambda k: {over} > 0.5)) > 0 THEN s.kept ELSE list_append(s.kept, {{'det_id': d.det_id, 'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2}}) END
  FROM st s JOIN d ON {' AND '.join(f's.{p} = d.{p}' for p in part.split(', '))} AND d.r = s.r + 1),
fin AS (SELECT {part}, max_by(kept, r) AS kept FROM st GROUP BY ALL), ids AS (SELECT {part}, unnest(kept).det_id AS det_id FROM fin),
nms AS (SELECT f.* FROM fx_det f JOIN ids USING ({part}, det_id)) {tail}"""


CLASSWISE = _nms_sql("image_id, class_id", "", "SELECT image_id, det_id, class_id, round(score, 6) AS score FROM nms")


@query(CLASSWISE, "fx_det", recursive=True)
def nms_classwise(v: Views) -> DataFrame:
    return D.nms(v.fx_det, 0.5).select("image_id", "det_id", "class_id", F.round("score", 6).alias("score"))


FLAGSHIP = _nms_sql("image_id, class_id", "", "SELECT class_id, count(*) AS n, round(avg(score), 6) AS mean_score FROM nms GROUP BY class_id")


@query(FLAGSHIP, "fx_det", recursive=True)
def nms_class_summary(v: Views) -> DataFrame:
    return D.nms(v.fx_det, 0.5).groupBy("class_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(_nms_sql("image_id", " + 1e-6", "SELECT image_id, det_id, class_id, round(score, 6) AS score FROM nms"), "fx_det", recursive=True)
def multi_scale_fusion(v: Views) -> DataFrame:
    return D.multi_scale(v.fx_det).select("image_id", "det_id", "class_id", F.round("score", 6).alias("score"))


def _fused_sql(src: str, p: str) -> str:
    """Weighted box fusion of src as a table `{p}w`."""
    return f"""{p}e AS (SELECT a.image_id, a.det_id AS u, b.det_id AS v FROM {src} a JOIN {src} b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.det_id <> b.det_id WHERE {AB} >= 0.5),
{p}r AS (SELECT image_id, det_id AS u, det_id AS v FROM {src} UNION SELECT r.image_id, r.u, e.v FROM {p}r r JOIN {p}e e ON r.image_id = e.image_id AND r.v = e.u),
{p}l AS (SELECT image_id, u AS det_id, min(v) AS cluster FROM {p}r GROUP BY ALL),
{p}w AS (SELECT image_id, class_id, cluster AS det_id, sum(x1 * score) / sum(score) AS x1, sum(y1 * score) / sum(score) AS y1, sum(x2 * score) / sum(score) AS x2, sum(y2 * score) / sum(score) AS y2, max(score) AS score FROM {src} JOIN {p}l USING (image_id, det_id) GROUP BY image_id, class_id, cluster)"""


def _listed_sql(src: str, order: str) -> str:
    fields = ", ".join(f"'{c}': {c}" for c in ("det_id", "class_id", "x1", "y1", "x2", "y2", "score"))
    return f"SELECT image_id, list({{{fields}}} ORDER BY {order}) AS b FROM {src} GROUP BY image_id"


def _dedup_sql(src: str, p: str = "d") -> str:
    """Priority deduplication of src as a recursion over each image's boxes; the rows are `{p}d`."""
    return f"""{p}l AS ({_listed_sql(src, 'score DESC, det_id')}),
{p}s AS (SELECT image_id, 1 AS i, b, list_transform(b, lambda d: true) AS live FROM {p}l
 UNION ALL SELECT image_id, i + 1, b, CASE WHEN live[i] THEN list_transform(live, lambda l, j: CASE WHEN stop > 0 AND j = i THEN false WHEN near[j] AND (stop = 0 OR j < stop) THEN false ELSE l END) ELSE live END
 FROM (SELECT *, CASE WHEN b[i].class_id = 5 THEN coalesce(list_position(list_transform(near, lambda q, j: q AND b[j].class_id <> 5), true), 0) ELSE 0 END AS stop
  FROM (SELECT *, list_transform(b, lambda d, j: j > i AND live[j] AND {IOU.format(a='b[i].', b='d.', eps='')} >= 0.5) AS near FROM {p}s WHERE i <= len(b)))),
{p}d AS (SELECT image_id, unnest(list_filter(b, lambda d, j: live[j]), recursive := true) FROM {p}s WHERE i = len(b) + 1)"""


def _confident_sql(src: str, p: str = "c") -> str:
    """The confidence filter of src as a recursion over each image's boxes; the rows are `{p}d`."""
    over = IOU.format(a="b[i].", b="b[j].", eps="")
    return f"""{p}l AS ({_listed_sql(src, 'class_id, score DESC, det_id')}),
{p}s AS (SELECT image_id, 1 AS i, b, list_transform(b, lambda d: false) AS used, []::BIGINT[] AS kept FROM {p}l
 UNION ALL SELECT image_id, i + 1, b, CASE WHEN used[i] THEN used ELSE list_transform(used, lambda u, j: u OR list_contains(g, j)) END, CASE WHEN used[i] THEN kept ELSE list_append(kept, CASE WHEN len(high) >= 2 AND b[high[1].j].class_id = 5 THEN high[2].j ELSE o[1].j END) END
 FROM (SELECT *, list_filter(o, lambda x: -x.o > 0.5) AS high FROM (SELECT *, list_sort(list_transform(g, lambda j: {{'o': -b[j].score, 'j': j}})) AS o
  FROM (SELECT *, list_filter(range(1, len(b) + 1), lambda j: j = i OR (j > i AND NOT used[j] AND {over} > 0.5)) AS g FROM {p}s WHERE i <= len(b))))),
{p}d AS (SELECT image_id, unnest(list_transform(kept, lambda j: b[j]), recursive := true) FROM {p}s WHERE i = len(b) + 1)"""


SHORT = "SELECT image_id, det_id, class_id, round(score, 6) AS score FROM"
CLUSTERS = f"""+edge AS (SELECT a.image_id, a.class_id, a.det_id AS u, b.det_id AS v FROM fx_det a JOIN fx_det b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.det_id <> b.det_id WHERE {AB} >= 0.5),
reach AS (SELECT image_id, det_id AS u, det_id AS v FROM fx_det UNION SELECT r.image_id, r.u, e.v FROM reach r JOIN edge e ON r.image_id = e.image_id AND r.v = e.u),
lab AS (SELECT image_id, u AS det_id, min(v) AS cluster FROM reach GROUP BY ALL)"""


@query(f"{CLUSTERS} SELECT image_id, det_id, cluster FROM lab", "fx_det", recursive=True)
def overlap_clusters(v: Views) -> DataFrame:
    return D.cluster(v.fx_det, 0.5).select("image_id", "det_id", "cluster")


@query(f"""{CLUSTERS} SELECT image_id, class_id, cluster AS det_id, round(sum(x1 * score) / sum(score), 6) AS x1, round(sum(y1 * score) / sum(score), 6) AS y1, round(sum(x2 * score) / sum(score), 6) AS x2, round(sum(y2 * score) / sum(score), 6) AS y2,
  round(max(score), 6) AS score, count(*) AS n_boxes FROM fx_det JOIN lab USING (image_id, det_id) GROUP BY image_id, class_id, cluster""", "fx_det", recursive=True)  # fmt: skip
def weighted_box_fusion(v: Views) -> DataFrame:
    w = D.weighted_box_fusion(v.fx_det, 0.5)
    return w.select("image_id", "class_id", "det_id", *[F.round(c, 6).alias(c) for c in G.CORNERS], F.round("score", 6).alias("score"), "n_boxes")


@query(f"""+pr AS (SELECT a.image_id, a.det_id AS a, b.det_id AS b, {AB} AS iou FROM fx_det a JOIN fx_det b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.det_id < b.det_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)
SELECT image_id, a, b, CAST(floor(iou * 1000000) AS BIGINT) AS iou_ppm FROM pr WHERE iou >= 0.3""", "fx_det")  # fmt: skip
def iou_pairs(v: Views) -> DataFrame:
    return D.iou_pairs(v.fx_det, 0.3).select("image_id", "a", "b", F.floor(F.col("iou") * 1_000_000).alias("iou_ppm"))


@query(f"""SELECT c.image_id, c.det_id, c.class_id, round(score, 6) AS score FROM fx_det c WHERE source = 1 AND NOT EXISTS (SELECT 1)
 OR source = 1 AND coalesce((SELECT max({IOU.format(a='c.', b='f.', eps='')}) FROM fx_det f WHERE f.source = 0 AND f.image_id = c.image_id AND f.class_id = c.class_id), 0) >= 0.85
 OR source = 1 AND coalesce((SELECT max({IOU.format(a='c.', b='f.', eps='')}) FROM fx_det f WHERE f.source = 0 AND f.image_id = c.image_id AND f.class_id = c.class_id), 0) < 0.3""", "fx_det")  # fmt: skip
def smart_crop_filter(v: Views) -> DataFrame:
    d = v.fx_det
    return D.smart_crop_filter(d.where("source = 1"), d.where("source = 0")).select("image_id", "det_id", "class_id", F.round("score", 6).alias("score"))


@query(f"+{_dedup_sql('fx_det')} {SHORT} dd", "fx_det", recursive=True)
def deduplicated(v: Views) -> DataFrame:
    return D.deduplicate(v.fx_det, 0.5, 5).select("image_id", "det_id", "class_id", F.round("score", 6).alias("score"))


@query(f"+{_confident_sql('fx_det')} {SHORT} cd", "fx_det", recursive=True)
def confidence_filtered(v: Views) -> DataFrame:
    return D.confidence_filter(v.fx_det, 0.5, 5).select("image_id", "det_id", "class_id", F.round("score", 6).alias("score"))


HYBRID = f"""+f0 AS (SELECT * FROM fx_det WHERE source = 0 AND score >= 0.25), k0 AS (SELECT * FROM fx_det WHERE source = 1 AND score >= 0.25), {_fused_sql('k0', 'k')},
mo AS (SELECT c.*, coalesce((SELECT max({IOU.format(a='c.', b='f.', eps='')}) FROM f0 f WHERE f.image_id = c.image_id AND f.class_id = c.class_id), 0) AS o FROM kw c),
sf AS (SELECT * FROM mo WHERE o >= 0.85 OR o < 0.3),
un AS (SELECT image_id, det_id * 2 AS det_id, class_id, x1, y1, x2, y2, score FROM f0 UNION ALL SELECT image_id, det_id * 2 + 1, class_id, x1, y1, x2, y2, score FROM sf), {_fused_sql('un', 'u')}, {_confident_sql('uw')},
al AS (SELECT image_id, 'full' AS s FROM f0 UNION ALL SELECT image_id, 'crops_raw' FROM kw UNION ALL SELECT image_id, 'crops_filtered' FROM sf UNION ALL SELECT image_id, 'merged' FROM uw UNION ALL SELECT image_id, 'final' FROM cd)"""


@query(f"""{HYBRID} SELECT image_id, count(*) FILTER (s = 'full') AS "full", count(*) FILTER (s = 'crops_raw') AS crops_raw, count(*) FILTER (s = 'crops_filtered') AS crops_filtered, count(*) FILTER (s = 'merged') AS merged, count(*) FILTER (s = 'final') AS final FROM al GROUP BY image_id""", "fx_det", recursive=True)
def hybrid_stage_counts(v: Views) -> DataFrame:
    d = v.fx_det
    stages = D.hybrid(d.where("source = 0"), d.where("source = 1"))
    rows = None
    for name, out in stages.items():
        part = out.select("image_id", *[F.lit(int(n == name)).alias(n) for n in stages])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("image_id").agg(*[F.sum(n).alias(n) for n in stages])


@query(f"+t0 AS (SELECT * FROM fx_det WHERE source < 2), {_fused_sql('t0', 't')}, {_dedup_sql('tw')} {SHORT} dd", "fx_det", recursive=True)
def tiled_fusion(v: Views) -> DataFrame:
    return D.tiled(v.fx_det.where("source < 2")).select("image_id", "det_id", "class_id", F.round("score", 6).alias("score"))


@query(_nms_sql("image_id", " + 1e-6", f", {_dedup_sql('nms', 'ag')} {SHORT} agd"), "fx_det", recursive=True)
def augmented_fusion(v: Views) -> DataFrame:
    return D.augmented(v.fx_det).select("image_id", "det_id", "class_id", F.round("score", 6).alias("score"))


@query(_nms_sql("image_id", " + 1e-6", f""", {_fused_sql('fx_det', 't')}, {_dedup_sql('tw')}, {_dedup_sql('nms', 'ag')},
{_nms_sql('image_id, class_id', '', '').removeprefix('+').replace('nms AS', 'cn AS').replace('fin AS', 'cfin AS').replace('FROM fin', 'FROM cfin').replace('ids AS', 'cids AS').replace('JOIN ids', 'JOIN cids').replace('st AS', 'cst AS').replace('FROM st', 'FROM cst').replace('d AS (SELECT *, row', 'cr AS (SELECT *, row').replace('JOIN d ON', 'JOIN cr d ON').replace('FROM d WHERE', 'FROM cr WHERE')}
SELECT method, count(*) AS n, round(avg(score), 6) AS mean_score FROM (SELECT 'tiled' AS method, score FROM dd UNION ALL SELECT 'multi_scale', score FROM nms UNION ALL SELECT 'augmented', score FROM agd UNION ALL SELECT 'nms', score FROM cn) GROUP BY method"""), "fx_det", recursive=True)  # fmt: skip
def method_comparison(v: Views) -> DataFrame:
    return D.compare_methods(v.fx_det).withColumn("mean_score", F.round("mean_score", 6)).drop("elapsed_s")


@query("SELECT source, class_id, count(*) AS n, round(avg(score), 6) AS mean_score FROM fx_det WHERE score >= 0.25 GROUP BY ALL", "fx_det")
def detection_summary(v: Views) -> DataFrame:
    return D.above(v.fx_det, 0.25).groupBy("source", "class_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) AS rank FROM fx_det", "fx_det")
def confidence_rank(v: Views) -> DataFrame:
    w = Window.partitionBy("image_id", "class_id").orderBy(F.desc("score"), "det_id")
    return v.fx_det.select("image_id", "det_id", F.row_number().over(w).alias("rank"))


TILES = """+g AS (SELECT image_id, width, height, t.i AS tile, width / (3 - 2 * CAST(0.2 AS DOUBLE)) AS cw, height / (2 - 1 * CAST(0.2 AS DOUBLE)) AS ch FROM fx_image, range(6) t(i)),
tiles AS (SELECT image_id, tile, (tile % 3) * cw * (1 - CAST(0.2 AS DOUBLE)) AS x1, (tile // 3) * ch * (1 - CAST(0.2 AS DOUBLE)) AS y1, least(width, (tile % 3) * cw * (1 - CAST(0.2 AS DOUBLE)) + cw) AS x2, least(height, (tile // 3) * ch * (1 - CAST(0.2 AS DOUBLE)) + ch) AS y2 FROM g)"""


@query(f"{TILES} SELECT image_id, tile::INT AS tile, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM tiles", "fx_image")
def tile_grid(v: Views) -> DataFrame:
    return D.tile_grid(v.fx_image, 6, 0.2).select("image_id", "tile", *[F.round(c, 4).alias(c) for c in G.CORNERS])


@query(f"{TILES} SELECT d.image_id, d.det_id, round(d.x1 + t.x1, 4) AS x1, round(d.y1 + t.y1, 4) AS y1, round(d.x2 + t.x1, 4) AS x2, round(d.y2 + t.y1, 4) AS y2 FROM fx_det d JOIN tiles t ON t.image_id = d.image_id AND t.tile = d.det_id % 6", "fx_image fx_det")
def tile_to_image(v: Views) -> DataFrame:
    d = v.fx_det.withColumn("tile", F.pmod("det_id", F.lit(6)).cast("int"))
    return D.to_image(d, D.tile_grid(v.fx_image, 6, 0.2)).select("image_id", "det_id", *[F.round(c, 4).alias(c) for c in G.CORNERS])


@query("""+k AS (SELECT d.*, width, height, ['flip_h', 'flip_v', 'flip_hv', 'scale', 'brightness'][(det_id % 5 + 1)::INT] AS kind FROM fx_det d JOIN fx_image USING (image_id))
SELECT image_id, det_id, kind, round(CASE WHEN kind IN ('flip_h', 'flip_hv') THEN width - x2 WHEN kind = 'scale' THEN x1 / 1.25 ELSE x1 END, 4)::DOUBLE AS x1, round(CASE WHEN kind IN ('flip_v', 'flip_hv') THEN height - y2 WHEN kind = 'scale' THEN y1 / 1.25 ELSE y1 END, 4)::DOUBLE AS y1,
 round(CASE WHEN kind IN ('flip_h', 'flip_hv') THEN width - x1 WHEN kind = 'scale' THEN x2 / 1.25 ELSE x2 END, 4)::DOUBLE AS x2, round(CASE WHEN kind IN ('flip_v', 'flip_hv') THEN height - y1 WHEN kind = 'scale' THEN y2 / 1.25 ELSE y2 END, 4)::DOUBLE AS y2 FROM k""", "fx_det fx_image")  # fmt: skip
def undo_augmentation(v: Views) -> DataFrame:
    kinds = F.lit(["flip_h", "flip_v", "flip_hv", "scale", "brightness"])
    d = v.fx_det.join(v.fx_image, "image_id").withColumn("kind", kinds[F.pmod("det_id", F.lit(5)).cast("int")])
    out = d.withColumns(G.undo_augmentation(F.col("kind"), F.lit(1.25), F.col("width"), F.col("height")))
    return out.select("image_id", "det_id", "kind", *[F.round(c, 4).alias(c) for c in G.CORNERS])


@query("""+s AS (SELECT image_id, ann_no, width, height, x1 + w / 2 AS cx, y1 + h / 2 AS cy, w, h FROM fx_box JOIN fx_image USING (image_id)),
c AS (SELECT *, CAST(floor(cx) AS INT) AS ix, CAST(floor(cy) AS INT) AS iy, greatest(256, least(640, greatest(w, h) * 2.5))::DOUBLE AS raw FROM s),
e AS (SELECT *, greatest(16, CAST(floor(floor(raw) / 16) * 16 AS INT)) AS side FROM c),
f AS (SELECT *, greatest(0, least(ix - side // 2, width - side)) AS x0, greatest(0, least(iy - side // 2, height - side)) AS y0 FROM e)
SELECT image_id, ann_no, x0, y0, least(width, x0 + side) AS x1, least(height, y0 + side) AS y1,
 greatest(25, CAST(floor(w * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * iy / height)) AS INT)) AS obj_w, greatest(20, CAST(floor(h * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * iy / height)) AS INT)) AS obj_h FROM f""", "fx_box fx_image")  # fmt: skip
def crop_regions(v: Views) -> DataFrame:
    b = v.fx_box.join(v.fx_image, "image_id").withColumns({"ix": F.floor(F.col("x1") + F.col("w") / 2).cast("int"), "iy": F.floor(F.col("y1") + F.col("h") / 2).cast("int")})
    region = G.crop_region(F.col("width"), F.col("height"), F.col("ix"), F.col("iy"), F.col("w"), F.col("h"))
    size = G.scaled_size(F.col("w"), F.col("h"), F.col("iy"), F.col("height"))
    return b.select("image_id", "ann_no", *[c.alias(k) for k, c in region.items()], size["w"].alias("obj_w"), size["h"].alias("obj_h"))


@query("SELECT image_id, greatest(16, CAST(round_even(width * least(1024.0::DOUBLE / greatest(width, height), 1) / 16, 0) * 16 AS INT)) AS w, greatest(16, CAST(round_even(height * least(1024.0::DOUBLE / greatest(width, height), 1) / 16, 0) * 16 AS INT)) AS h FROM fx_image", "fx_image")
def resize_plan(v: Views) -> DataFrame:
    plan = G.resized(F.col("width"), F.col("height"))
    return v.fx_image.select("image_id", plan["w"].alias("w"), plan["h"].alias("h"))
