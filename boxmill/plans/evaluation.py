"""Queries over grounding answers, matches, average precision and training curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grounding as G
from ..operators import validation as V
from .base import Views, query
from .probing import NAMES

PARSE = f"""+m AS (SELECT image_id, width, height, regexp_extract_all(response, '{T.BOX}', 1) AS a, regexp_extract_all(response, '{T.BOX}', 2) AS b, regexp_extract_all(response, '{T.BOX}', 3) AS c, regexp_extract_all(response, '{T.BOX}', 4) AS d,
 string_split_regex(response, '{T.BOX}') AS w FROM fx_ground JOIN fx_image USING (image_id)),
u AS (SELECT image_id, width, height, i - 1 AS pos, a[i]::DOUBLE AS x1, b[i]::DOUBLE AS y1, c[i]::DOUBLE AS x2, d[i]::DOUBLE AS y2, trim(regexp_replace(regexp_replace(regexp_replace(w[i], '{T.TAG}', '', 'g'), '{T.ASIDE}', '', 'g'), '{T.TAIL}', '')) AS t
 FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM m)),
k AS (SELECT *, CASE WHEN t <> '' THEN regexp_replace(lower(t), '{T.GAP}', '_', 'g') END AS raw FROM u),
n AS (SELECT *, CASE WHEN raw IN ('container', 'plastic', 'metal', 'polystyrene', 'trash_pile', 'trash') THEN raw ELSE list_filter(['polystyrene', 'trash_pile', 'container', 'plastic', 'metal', 'trash'], lambda c: contains(raw, c) OR contains(c, raw))[1] END AS named FROM k),
f AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY image_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cls, greatest(x1, y1, x2, y2) <= 1 AS small FROM n),
z AS (SELECT image_id, pos, cls, round(greatest(0, least(1, CASE WHEN small THEN x1 ELSE x1 / width END)), 4) AS x1, round(greatest(0, least(1, CASE WHEN small THEN y1 ELSE y1 / height END)), 4) AS y1,
 round(greatest(0, least(1, CASE WHEN small THEN x2 ELSE x2 / width END)), 4) AS x2, round(greatest(0, least(1, CASE WHEN small THEN y2 ELSE y2 / height END)), 4) AS y2 FROM f WHERE cls IS NOT NULL),
parsed AS (SELECT image_id, pos, cls, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, x1, y1, x2, y2 ORDER BY pos) AS k FROM z) WHERE k = 1)"""


def answers(v: Views) -> DataFrame:
    return v.fx_ground.join(v.fx_image.select("image_id", "width", "height"), "image_id")


@query(f"{PARSE} SELECT image_id, pos, cls, CAST(floor(x1 * 1000) AS INT) AS x1, CAST(floor(y1 * 1000) AS INT) AS y1, CAST(floor(x2 * 1000) AS INT) AS x2, CAST(floor(y2 * 1000) AS INT) AS y2 FROM parsed", "fx_ground fx_image")
def grounding_boxes(v: Views) -> DataFrame:
    return G.parse_answers(answers(v), NAMES).withColumns({c: F.floor(F.col(c) * 1000).cast("int") for c in ("x1", "y1", "x2", "y2")})


IOU = """greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0) / ((g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0))"""
MATCH = f"""+p AS (SELECT * FROM fx_det WHERE source = 1), gr AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gt_no) AS r FROM fx_gt),
cand AS (SELECT g.image_id, g.r, g.gt_no, list({{'o': {IOU}, 'd': p.det_id}} ORDER BY {IOU} DESC, p.det_id) FILTER (p.det_id IS NOT NULL) AS c FROM gr g LEFT JOIN p ON p.image_id = g.image_id AND p.class_id = g.class_id GROUP BY ALL),
st AS (SELECT image_id, 0::BIGINT AS r, []::INT[] AS used, NULL::INT AS gt_no, NULL::INT AS det_id, NULL::DOUBLE AS iou FROM (SELECT DISTINCT image_id FROM fx_gt)
 UNION ALL SELECT s.image_id, c.r, CASE WHEN b.o >= 0.3 THEN list_append(s.used, b.d) ELSE s.used END, c.gt_no, CASE WHEN b.o >= 0.3 THEN b.d END, coalesce(b.o, 0)
 FROM st s JOIN (SELECT * FROM cand) c ON c.image_id = s.image_id AND c.r = s.r + 1, LATERAL (SELECT list_filter(c.c, lambda x: NOT list_contains(s.used, x.d))[1] AS b) t),
mt AS (SELECT image_id, gt_no, det_id, round(iou, 3) AS iou FROM st WHERE r > 0)"""


def matches(v: Views) -> DataFrame:
    return G.match(v.fx_gt, v.fx_det.where("source = 1"))


@query(f"{MATCH} SELECT image_id, gt_no, det_id, CAST(round(iou * 1000) AS INT) AS iou_permille FROM mt", "fx_gt fx_det", recursive=True)
def gold_matches(v: Views) -> DataFrame:
    return matches(v).select("image_id", "gt_no", "det_id", F.round(F.col("iou") * 1000).cast("int").alias("iou_permille"))


@query(f"""{MATCH}, g AS (SELECT image_id, count(*) AS n_gt, string_agg(DISTINCT class_id::VARCHAR, ',' ORDER BY class_id::VARCHAR) AS gt_classes FROM fx_gt GROUP BY 1), pr AS (SELECT image_id, count(*) AS n_pred, string_agg(DISTINCT class_id::VARCHAR, ',' ORDER BY class_id::VARCHAR) AS pred_classes FROM p GROUP BY 1),
m AS (SELECT image_id, count(*) AS n_matched, avg(iou) AS mean_iou FROM mt WHERE det_id IS NOT NULL GROUP BY 1)
SELECT image_id, coalesce(n_gt, 0) AS n_gt, coalesce(n_pred, 0) AS n_pred, coalesce(n_matched, 0) AS n_matched, coalesce(gt_classes, '') AS gt_classes, coalesce(pred_classes, '') AS pred_classes,
 round(mean_iou, 6) AS mean_iou, round(coalesce(n_matched, 0)::DOUBLE / n_pred, 6) AS precision, round(coalesce(n_matched, 0)::DOUBLE / n_gt, 6) AS recall FROM g FULL JOIN pr USING (image_id) LEFT JOIN m USING (image_id)""", "fx_gt fx_det", recursive=True)  # fmt: skip
def grounding_image_rows(v: Views) -> DataFrame:
    rows = G.image_rows(v.fx_gt, v.fx_det.where("source = 1"), matches(v))
    return rows.withColumns({"mean_iou": F.round("mean_iou", 6), "precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query(f"""{MATCH} SELECT n_gt, n_pred, n_matched, round(n_matched::DOUBLE / n_pred, 6) AS precision, round(n_matched::DOUBLE / n_gt, 6) AS recall, round(mean_iou, 4) AS mean_iou
FROM (SELECT count(*) AS n_gt FROM fx_gt), (SELECT count(*) AS n_pred FROM p), (SELECT count(*) AS n_matched, avg(iou) AS mean_iou FROM mt WHERE det_id IS NOT NULL)""", "fx_gt fx_det", recursive=True)  # fmt: skip
def grounding_summary(v: Views) -> DataFrame:
    m = matches(v)
    out = G.summary(G.image_rows(v.fx_gt, v.fx_det.where("source = 1"), m), m)
    return out.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6), "mean_iou": F.round("mean_iou", 4)})


def curves(v: Views, thresholds: list[float]) -> DataFrame:
    return V.precision_recall(V.judged(v.fx_det.where("source = 1"), v.fx_gt, thresholds), v.fx_gt)


JUDGED = f"""+p AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) AS r FROM fx_det WHERE source = 1),
cand AS (SELECT p.image_id, p.class_id, p.r, p.det_id, p.score, list({{'o': {IOU}, 'g': g.gt_no}} ORDER BY {IOU} DESC, g.gt_no) FILTER (g.gt_no IS NOT NULL) AS c FROM p LEFT JOIN fx_gt g ON p.image_id = g.image_id AND p.class_id = g.class_id GROUP BY ALL),
st AS (SELECT image_id, class_id, 0::BIGINT AS r, []::INT[] AS used, NULL::INT AS det_id, NULL::DOUBLE AS score, NULL::BOOLEAN AS tp FROM (SELECT DISTINCT image_id, class_id FROM p)
 UNION ALL SELECT s.image_id, s.class_id, c.r, CASE WHEN b.o >= 0.5 THEN list_append(s.used, b.g) ELSE s.used END, c.det_id, c.score, coalesce(b.o >= 0.5, false)
 FROM st s JOIN cand c ON c.image_id = s.image_id AND c.class_id = s.class_id AND c.r = s.r + 1, LATERAL (SELECT list_filter(c.c, lambda x: NOT list_contains(s.used, x.g))[1] AS b) t),
j AS (SELECT * FROM st WHERE r > 0), n AS (SELECT class_id, count(*) AS n_gold FROM fx_gt GROUP BY 1),
pr AS (SELECT *, sum(tp::INT) OVER w AS hits, (sum(tp::INT) OVER w)::DOUBLE / count(*) OVER w AS precision FROM j WINDOW w AS (PARTITION BY class_id ORDER BY score DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)),
en AS (SELECT *, max(precision) OVER (PARTITION BY class_id ORDER BY score DESC, image_id, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM pr)"""


@query(f"{JUDGED} SELECT image_id, class_id, det_id, tp, round(precision, 6) AS precision, round(hits::DOUBLE / n_gold, 6) AS recall, round(envelope, 6) AS envelope FROM en JOIN n USING (class_id)", "fx_gt fx_det", recursive=True)
def precision_recall_curve(v: Views) -> DataFrame:
    return curves(v, [0.5]).select("image_id", "class_id", "det_id", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "envelope")])


@query(f"{JUDGED} SELECT class_id, 0.5::DOUBLE AS threshold, round(sum(CASE WHEN tp THEN envelope ELSE 0 END) / max(n_gold), 6) AS ap, round(count(*) FILTER (tp)::DOUBLE / count(*), 6) AS precision, round(count(*) FILTER (tp)::DOUBLE / max(n_gold), 6) AS recall FROM en JOIN n USING (class_id) GROUP BY class_id", "fx_gt fx_det", recursive=True)
def average_precision(v: Views) -> DataFrame:
    out = V.average_precisions(v.fx_det.where("source = 1"), v.fx_gt, [0.5])
    return out.withColumns({c: F.round(c, 6) for c in ("ap", "precision", "recall")})


THRESHOLDS = [round(0.5 + 0.05 * k, 2) for k in range(10)]


#: JUDGED at all thresholds: the recursion carries th.
ALL = (
    JUDGED.replace("st AS (SELECT image_id,", "th AS (SELECT unnest(" + str(THRESHOLDS) + "::DOUBLE[]) AS th),\nst AS (SELECT th, image_id,").replace("FROM (SELECT DISTINCT image_id, class_id FROM p)", "FROM (SELECT DISTINCT image_id, class_id FROM p), th")
    .replace("UNION ALL SELECT s.image_id", "UNION ALL SELECT s.th, s.image_id").replace("b.o >= 0.5", "b.o >= s.th").replace("PARTITION BY class_id", "PARTITION BY th, class_id")
)
PER_CLASS = f"""{ALL}, ap AS (SELECT th, class_id, sum(CASE WHEN tp THEN envelope ELSE 0 END) / max(n_gold) AS ap, count(*) FILTER (tp)::DOUBLE / count(*) AS p, count(*) FILTER (tp)::DOUBLE / max(n_gold) AS r FROM en JOIN n USING (class_id) GROUP BY ALL),
k AS (SELECT class_id, max(p) FILTER (th = 0.5) AS p, max(r) FILTER (th = 0.5) AS r, max(ap) FILTER (th = 0.5) AS ap50, max(ap) FILTER (th = 0.75) AS ap75, avg(ap) AS ap FROM ap GROUP BY class_id),
pc AS (SELECT class_id, name, coalesce(p, 0) AS precision, coalesce(r, 0) AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, coalesce(ap50, 0) AS ap50, coalesce(ap75, 0) AS ap75, coalesce(ap, 0) AS ap FROM fx_class LEFT JOIN k USING (class_id))"""


@query(f"{PER_CLASS} SELECT class_id, name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(ap50, 6) AS ap50, round(ap75, 6) AS ap75, round(ap, 6) AS ap, round(ap * 100 / sum(ap) OVER (), 6) AS share FROM pc", "fx_gt fx_det fx_class", recursive=True)
def validation_per_class(v: Views) -> DataFrame:
    out = V.per_class(V.average_precisions(v.fx_det.where("source = 1"), v.fx_gt, THRESHOLDS), v.fx_class)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "ap50", "ap75", "ap", "share")})


@query(f"""{PER_CLASS} SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(ap50, 6) AS ap50, round(ap75, 6) AS ap75, round(ap, 6) AS ap
FROM (SELECT avg(precision) AS p, avg(recall) AS r, avg(ap50) AS ap50, avg(ap75) AS ap75, avg(ap) AS ap FROM pc)""", "fx_gt fx_det fx_class", recursive=True)  # fmt: skip
def validation_overall(v: Views) -> DataFrame:
    out = V.overall(V.per_class(V.average_precisions(v.fx_det.where("source = 1"), v.fx_gt, THRESHOLDS), v.fx_class))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "ap50", "ap75", "ap")})


@query("SELECT run, arg_max(epoch, (map5095, -epoch)) AS epoch, max(map5095) AS map5095 FROM fx_epoch WHERE map5095 IS NOT NULL GROUP BY run", "fx_epoch")
def best_epoch(v: Views) -> DataFrame:
    return V.best_epoch(v.fx_epoch, "map5095")


@query("""+r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i, greatest(0, max(map5095) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)) AS best FROM fx_epoch WHERE map5095 IS NOT NULL),
m AS (SELECT *, best > coalesce(lag(best) OVER (PARTITION BY run ORDER BY epoch), 0) AS improved FROM r)
SELECT run, epoch, map5095, best, improved, i - coalesce(last_value(CASE WHEN improved THEN i END IGNORE NULLS) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS since FROM m""", "fx_epoch")  # fmt: skip
def epoch_patience(v: Views) -> DataFrame:
    return V.patience(v.fx_epoch, "map5095")
