"""Queries over probing questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion as D
from ..operators import probing as P
from ..operators import scoring as X
from ..operators.ordering import first_by_hash
from .base import Views, query

NAMES = ["container", "plastic", "metal", "polystyrene", "trash_pile", "trash"]
FIRST = "lower(string_split_regex(trim(response), '[.!?\\n]')[1])"
PRED = f"CASE WHEN trim(response) = 'TIMEOUT' THEN 'timeout' WHEN regexp_matches({FIRST}, '\\bno\\b|\\bnot\\b|\\bcannot\\b|\\bdon''t\\b|\\bdoesn''t\\b') THEN 'no' ELSE 'yes' END"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"SELECT question_id, {PRED} AS pred, CASE WHEN regexp_replace(lower(trim(response)), '\\.+$', '') IN ('yes', 'no') THEN regexp_replace(lower(trim(response)), '\\.+$', '') END AS strict, substring(trim(response), 1, 300) AS short FROM fx_answer", "fx_answer")
def parsed_answers(v: Views) -> DataFrame:
    r = F.col("response")
    return v.fx_answer.select("question_id", T.predicted(r).alias("pred"), T.strict_answer(r).alias("strict"), T.shortened(r).alias("short"))


CELLS = f"""+p AS (SELECT *, {PRED} AS pred FROM fx_answer),
cells AS (SELECT model, tier, cls, count(*) FILTER (pred <> 'timeout' AND pred = 'yes' AND label = 'yes') AS tp, count(*) FILTER (pred <> 'timeout' AND pred = 'yes' AND label <> 'yes') AS fp,
 count(*) FILTER (pred <> 'timeout' AND pred <> 'yes' AND label = 'yes') AS fn, count(*) FILTER (pred <> 'timeout' AND pred <> 'yes' AND label <> 'yes') AS tn, count(*) FILTER (pred = 'timeout') AS timeouts
 FROM p GROUP BY GROUPING SETS ((model, tier), (model, tier, cls))),
met AS (SELECT *, tp * 100.0::DOUBLE / nullif(tp + fp, 0) AS precision, tp * 100.0::DOUBLE / nullif(tp + fn, 0) AS recall, 2 * tp * 100.0::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1,
 (tp + tn) * 100.0::DOUBLE / nullif(tp + fp + fn + tn, 0) AS accuracy, (tp + fp) * 100.0::DOUBLE / nullif(tp + fp + fn + tn, 0) AS yes_ratio FROM cells WHERE cls IS NULL OR tp + fp + fn + tn > 0)"""
METRICS = ("precision", "recall", "f1", "accuracy", "yes_ratio")


@query(f"{CELLS} SELECT model, tier, cls, tp, fp, fn, tn, timeouts, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM met", "fx_answer")
def answer_metrics(v: Views) -> DataFrame:
    return rounded(P.confusion(v.fx_answer), *METRICS)


@query(f"{CELLS} SELECT model, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)} FROM met WHERE cls IS NULL GROUP BY model", "fx_answer")
def tier_means(v: Views) -> DataFrame:
    return rounded(P.tier_mean(P.confusion(v.fx_answer)), *METRICS)


CARDS = """+a AS (SELECT *, CASE WHEN regexp_replace(lower(trim(response)), '\\.+$', '') IN ('yes', 'no') THEN regexp_replace(lower(trim(response)), '\\.+$', '') END AS said FROM (SELECT concat(model, '_', (question_id % 4)::VARCHAR) AS model, * EXCLUDE (model) FROM fx_answer)),
c AS (SELECT model, count(*) FILTER (said = 'yes' AND label = 'yes') AS tp, count(*) FILTER (said = 'yes' AND label = 'no') AS fp, count(*) FILTER (said = 'no' AND label = 'yes') AS fn, count(said) AS valid, count(*) FILTER (said = 'yes') AS sy, count(*) AS n_total, median(inference_s) AS median_s FROM a GROUP BY model),
m AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM c WHERE valid > 0),
cards AS (SELECT model, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, precision, recall, sy::DOUBLE / valid AS yes_ratio, valid::DOUBLE / n_total AS valid_rate, median_s, n_total FROM m)"""


def cards(v: Views) -> DataFrame:
    return P.model_cards(v.fx_answer.withColumn("model", F.concat("model", F.lit("_"), F.pmod("question_id", F.lit(4)).cast("string"))))


@query(f"{CARDS} SELECT model, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall, round(yes_ratio, 6) AS yes_ratio, round(valid_rate, 6) AS valid_rate, round(median_s, 6) AS median_s, n_total, round(abs(yes_ratio - 0.5), 6) AS deviation FROM cards", "fx_answer")
def model_cards(v: Views) -> DataFrame:
    return rounded(P.calibration(cards(v)), "f1", "precision", "recall", "yes_ratio", "valid_rate", "median_s", "deviation")


@query(f"{CARDS}, r AS (SELECT model, round(f1, 2) AS f1, round(median_s, 1) AS median_s FROM cards) SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.f1 >= a.f1 AND b.median_s <= a.median_s AND (b.f1 > a.f1 OR b.median_s < a.median_s))", "fx_answer")
def pareto_frontier(v: Views) -> DataFrame:
    return P.pareto(cards(v).select("model", F.round("f1", 2).alias("f1"), F.round("median_s", 1).alias("median_s")))


@query("SELECT model, tier, count(*) AS n, count(*) FILTER (trim(response) = 'TIMEOUT') AS timeouts, round(sum(inference_s), 4) AS total_s, round(avg(inference_s), 6) AS mean_s FROM fx_answer GROUP BY ALL", "fx_answer")
def latency_totals(v: Views) -> DataFrame:
    return P.latency(v.fx_answer).withColumns({"total_s": F.round("total_s", 4), "mean_s": F.round("mean_s", 6)})


@query("SELECT question_id, model, tier FROM fx_answer q WHERE NOT EXISTS (SELECT 1 FROM fx_answer a WHERE a.question_id = q.question_id AND a.response <> 'TIMEOUT')", "fx_answer")
def resume_unanswered(v: Views) -> DataFrame:
    return P.unanswered(v.fx_answer, v.fx_answer.where("response <> 'TIMEOUT'"), ["question_id"]).select("question_id", "model", "tier")


RANK = "CASE tier WHEN 'random' THEN 1 WHEN 'popular' THEN 2 ELSE 3 END"


@query(f"SELECT image_id, cls, tier, question_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY {RANK}, question_id) AS k FROM fx_answer) WHERE k = 1", "fx_answer")
def first_seen_samples(v: Views) -> DataFrame:
    return P.first_seen(v.fx_answer).select("image_id", "cls", "tier", "question_id")


@query(f"SELECT image_id, cls, question_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY {RANK}, question_id) AS k FROM fx_answer) WHERE k = 1 ORDER BY md5('42:' || image_id || ':' || cls), image_id, cls LIMIT 500", "fx_answer")
def seeded_sample_cap(v: Views) -> DataFrame:
    return P.first_seen(v.fx_answer, 500).select("image_id", "cls", "question_id")


@query(f"""{CELLS.replace('+p AS (SELECT *', '+p AS (SELECT *, question_id % 2 AS stage')
 .replace('SELECT model, tier, cls, count', 'SELECT stage, model, tier, cls, count').replace('((model, tier), (model, tier, cls))', '((stage, model, tier), (stage, model, tier, cls))')}
SELECT b.model, b.tier, b.cls, round(b.f1, 6) AS f1_before, round(a.f1, 6) AS f1_after, round(a.f1 - b.f1, 6) AS delta FROM (SELECT * FROM met WHERE stage = 0) b LEFT JOIN (SELECT * FROM met WHERE stage = 1) a
ON a.model = b.model AND a.tier = b.tier AND a.cls IS NOT DISTINCT FROM b.cls""", "fx_answer")  # fmt: skip
def before_after_f1(v: Views) -> DataFrame:
    a = v.fx_answer
    return rounded(P.before_after(P.confusion(a.where("question_id % 2 = 0")), P.confusion(a.where("question_id % 2 = 1"))), "f1_before", "f1_after", "delta")


@query("SELECT model, tier, count(*) AS n FROM fx_answer WHERE model NOT IN ('model_1') GROUP BY ALL", "fx_answer")
def excluded_models(v: Views) -> DataFrame:
    return P.excluding(v.fx_answer, "model", ["model_1"]).groupBy("model", "tier").agg(F.count("*").alias("n"))


QUESTIONS = """+g AS (SELECT DISTINCT image_id, class_id FROM fx_gt), n AS (SELECT image_id, count(*) AS n FROM g GROUP BY 1), df AS (SELECT class_id, count(*) AS df FROM g GROUP BY 1),
co AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS n FROM g a JOIN g b ON a.image_id = b.image_id AND a.class_id <> b.class_id GROUP BY ALL),
ab AS (SELECT i.image_id, c.class_id FROM fx_image i, fx_class c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.image_id = i.image_id AND g.class_id = c.class_id)),
ad AS (SELECT g.image_id, co.b AS class_id, sum(co.n) AS s FROM g JOIN co ON co.a = g.class_id GROUP BY ALL),
c AS (SELECT ab.image_id, ab.class_id, coalesce(n.n, 3) AS want, coalesce(df, 0) AS pop, coalesce(s, 0) AS adv, md5('42:' || ab.image_id || ':' || ab.class_id) AS h
 FROM ab LEFT JOIN n USING (image_id) LEFT JOIN df ON df.class_id = ab.class_id LEFT JOIN ad ON ad.image_id = ab.image_id AND ad.class_id = ab.class_id),
neg AS (SELECT tier, image_id, class_id, 'no' AS label FROM (SELECT *, row_number() OVER (PARTITION BY tier, image_id ORDER BY CASE tier WHEN 'popular' THEN pop WHEN 'adversarial' THEN adv ELSE 0 END DESC, CASE tier WHEN 'random' THEN h ELSE '' END, class_id) AS k
 FROM c, (SELECT unnest(['random', 'popular', 'adversarial']) AS tier)) WHERE k <= want),
al AS (SELECT tier, image_id, class_id, 'yes' AS label FROM g, (SELECT unnest(['random', 'popular', 'adversarial']) AS tier) UNION ALL SELECT * FROM neg),
r AS (SELECT *, row_number() OVER (PARTITION BY tier, label ORDER BY md5('42:' || image_id || ':' || class_id), image_id, class_id) AS k FROM al),
le AS (SELECT tier, least(count(*) FILTER (label = 'yes'), count(*) FILTER (label = 'no')) AS m FROM al GROUP BY 1),
q AS (SELECT tier, row_number() OVER (PARTITION BY tier ORDER BY md5('43:' || image_id || ':' || class_id), image_id, class_id) AS question_id, image_id, class_id, label FROM r JOIN le USING (tier) WHERE k <= m)"""


@query(f"{QUESTIONS} SELECT tier, question_id, image_id, name AS cls, 'Is there any ' || name || ' in this image?' AS text, label FROM q JOIN fx_class USING (class_id)", "fx_gt fx_image fx_class")
def probing_questions(v: Views) -> DataFrame:
    return P.build_questions(v.fx_image, v.fx_gt, v.fx_class, list(range(6)))


@query("SELECT image_id, split FROM (SELECT i.image_id, i.split, CASE split WHEN 'val' THEN 1 WHEN 'train' THEN 2 ELSE 3 END AS s, file_name, g.image_id IS NOT NULL AS has FROM fx_image i LEFT JOIN (SELECT DISTINCT image_id FROM fx_gt) g USING (image_id)) ORDER BY has DESC, s, file_name LIMIT 200", "fx_image fx_gt")
def labelled_first_limit(v: Views) -> DataFrame:
    has = v.fx_gt.select("image_id").distinct().withColumn("has", F.lit(True))
    i = v.fx_image.join(has, "image_id", "left").withColumn("s", F.array_position(F.lit(["val", "train", "test"]), F.col("split")))
    return i.orderBy(F.coalesce("has", F.lit(False)).desc(), "s", "file_name").limit(200).select("image_id", "split")


@query("SELECT image_id, file_name FROM fx_image ORDER BY md5('7:' || image_id), image_id LIMIT 100", "fx_image")
def random_image_subset(v: Views) -> DataFrame:
    return first_by_hash(v.fx_image.select("image_id", "file_name"), 100, 7, ["image_id"])


@query("SELECT name, min_by(path, (name <> file, dir_rank, path)) AS path FROM (SELECT i.file_name AS name, f.file_name AS file, d.dir_rank, d.dir_rank || '/' || f.file_name AS path, regexp_extract(i.file_name, '^(.*)\\.[^.]*$', 1) AS stem FROM fx_image i JOIN fx_image f USING (image_id) JOIN (SELECT image_id, (image_id % 3)::INT AS dir_rank FROM fx_image) d USING (image_id) WHERE image_id % 2 = 0) GROUP BY name", "fx_image")
def resolved_image_paths(v: Views) -> DataFrame:
    rank = F.pmod("image_id", F.lit(3)).cast("int")
    f = v.fx_image.where("image_id % 2 = 0").select(F.col("file_name").alias("name"), rank.alias("dir_rank"), F.lit(0).alias("ext_rank"), F.concat(rank.cast("string"), F.lit("/"), "file_name").alias("path"))
    return P.resolved_paths(v.fx_image.select(F.col("file_name").alias("name")), f)


@query("SELECT model, count(*) AS n, true AS p50_holds, true AS p90_holds FROM fx_answer GROUP BY model", "fx_answer")
def latency_quantiles(v: Views) -> DataFrame:
    """Sketches of each tier merged to models, and whether their quantiles stand at the ranks they should, counted over all rows."""
    a = v.fx_answer
    q = P.sketched_quantiles(P.merged_sketches(P.latency_sketches(a, ["model", "tier"]), ["model"]), p50=0.5, p90=0.9)
    both = a.join(q.select("model", "p50", "p90"), "model")

    def holds(name: str, rank: float) -> Column:
        below, upto = F.count_if(F.col("inference_s") < F.col(name)) / F.count("*"), F.count_if(F.col("inference_s") <= F.col(name)) / F.count("*")
        return (below <= rank + P.RANK_ERROR) & (upto >= rank - P.RANK_ERROR)

    return both.groupBy("model").agg(F.count("*").alias("n"), holds("p50", 0.5).alias("p50_holds"), holds("p90", 0.9).alias("p90_holds"))


def shouting():
    """An answerer that hangs on a few questions."""
    import time

    return lambda image, text: time.sleep(3600) if int(image) % 200_000 == 17 else text.upper()


@query("SELECT question_id, CASE WHEN question_id % 200000 = 17 THEN 'TIMEOUT' ELSE upper(cls) END AS response FROM fx_answer", "fx_answer")
def answered_in_time(v: Views) -> DataFrame:
    asked = v.fx_answer.select("question_id", F.col("question_id").cast("string").alias("image"), F.col("cls").alias("text"))
    return X.answered(asked, "shouting", shouting, limit_s=10.0, waiting=15).select("question_id", "response")


def corner_boxes():
    """A detector of up to two boxes a tile, by arithmetic."""
    import numpy as np

    def predict(image_id, tile):
        x = (image_id * 7 + tile * 13) % 100
        box = np.stack([(image_id + tile) % 6, x, tile, x + 10.0, tile + 5.0, (image_id % 97 + 1) / 98], axis=1)
        out = np.stack([box, box + np.array([0, 3, 3, 3, 3, 0])], axis=1).astype(float)
        out[image_id % 3 == 0, 1] = np.nan
        out[image_id % 5 == 0] = np.nan
        return out

    return predict


@query("""+t AS (SELECT image_id, tile::INT AS tile, CAST((image_id * 7 + tile * 13) % 100 AS DOUBLE) AS x, ((image_id + tile) % 6)::INT AS class_id, (image_id % 97 + 1) / 98::DOUBLE AS score FROM fx_image, range(4) r(tile) WHERE image_id % 5 <> 0)
SELECT image_id, tile, k AS det_id, class_id, x + 3 * k AS x1, CAST(tile + 3 * k AS DOUBLE) AS y1, x + 10 + 3 * k AS x2, CAST(tile + 5 + 3 * k AS DOUBLE) AS y2, round(score, 6) AS score FROM t, range(2) s(k) WHERE k = 0 OR image_id % 3 <> 0""", "fx_image")  # fmt: skip
def detected_tiles(v: Views) -> DataFrame:
    tiles = D.tile_grid(v.fx_image, 4, 0.1).select("image_id", "tile")
    return X.detected_in_batches(tiles, corner_boxes).withColumn("score", F.round("score", 6))
