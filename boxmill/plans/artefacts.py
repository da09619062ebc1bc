"""Queries over logs, reviews, questions and results that are written as files from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grounding as G
from ..operators import labels as L
from ..sources import sinks as K
from ..sources import tables as B
from .base import Views, query
from .files import folder
from .labels import PARSED

#: Images of one file, so that a file's rows fit in one row.
IN_A_FILE = 2000
#: As many for answers, which are dealt by model, stage and tier as well.
ANSWERED_IN_A_FILE = 20_000


def csv_files(rows: DataFrame, path: Column, header: str, columns: list[Column], root: str) -> None:
    """rows as CSV files, every value quoted; quotes in values are doubled, nulls are empty."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    files = rows.groupBy(path.alias("path")).agg(F.concat(F.lit(header + "\n"), F.array_join(F.collect_list(F.concat_ws(",", *quoted)), "\n"), F.lit("\n")).alias("content"))
    K.write_files(files, root)


def of_schema(schema: str) -> str:
    return ",".join(c.split(" ")[0] for c in schema.split(", "))


def chunk(prefix: str, images: int = IN_A_FILE) -> Column:
    return F.concat(F.lit(prefix), F.floor(F.col("image_id") / images).cast("string"))


def log(v: Views) -> DataFrame:
    """Generation logs of experiments in which the same names of images occur, from their files."""
    root, b = folder(v, "logs"), v.fx_box.join(v.fx_class, "class_id")
    stem = F.concat(F.lit("img_"), (F.col("image_id") % IN_A_FILE).cast("string"))
    whole = {k: F.floor(c).cast("int") for k, c in {"cx": F.col("x1") + F.col("w") / 2, "cy": F.col("y1") + F.col("h") / 2, "obj_w": F.col("w"), "obj_h": F.col("h")}.items()}
    columns = [F.concat(F.lit("out/"), stem, F.lit("_s.png")), F.concat(stem, F.lit(".jpg")), F.col("class_id"), F.col("name"), F.lit('a "wet" stone,\nfar away'), *whole.values(), *[F.lit(0.5)] * 4, F.lit(7.5), F.lit(20)]
    csv_files(b, F.concat(chunk("exp_"), F.lit("/generation_log.csv")), of_schema(B.LOG), columns, root)
    return B.generation_log(v.spark, root)


LOGGED = f"""+l AS (SELECT concat('exp_', CAST(image_id // {IN_A_FILE} AS VARCHAR)) AS experiment, concat('img_', CAST(image_id % {IN_A_FILE} AS VARCHAR), '_s') AS stem, name, floor(y1 + h / 2) AS cy, floor(x1 + w / 2) AS cx, image_id FROM fx_box JOIN fx_class USING (class_id)),
c AS (SELECT experiment, stem, string_agg(name, ',' ORDER BY cy, cx, name) AS classes, any_value(image_id) AS image_id FROM l GROUP BY ALL)"""


@query(f"{LOGGED} SELECT experiment, stem, classes FROM c", "fx_box fx_class")
def logged_classes(v: Views) -> DataFrame:
    """The classes of each artefact, by experiment and name; prompts in the logs hold quotes and line ends."""
    return B.classes_of_artefacts(log(v)).withColumn("classes", F.array_join("classes", ","))


@query(f"{LOGGED} SELECT experiment, stem, classes, concat(experiment, '_', stem) AS export_name FROM c WHERE image_id % 3 = 0", "fx_box fx_class")
def accepted_artefacts(v: Views) -> DataFrame:
    """The artefacts that reviewers took, exported and read back; others are rejected or not decided."""
    at = v.fx_box.where("image_id % 3 < 2").select("image_id").distinct()
    stem = F.concat(F.lit("img_"), (F.col("image_id") % IN_A_FILE).cast("string"), F.lit("_s"))
    decisions = at.select(chunk("exp_").alias("experiment"), stem.alias("stem"), (F.col("image_id") % 3 == 0).alias("accepted"))
    root = folder(v, "accepted")
    K.append(B.accepted(B.classes_of_artefacts(log(v)), decisions), root)
    return v.spark.read.parquet(root).withColumn("classes", F.array_join("classes", ","))


@query("""SELECT s AS stem, concat('made/', s, '.jpg') AS image, CASE WHEN image_id % 4 > 0 THEN concat('labels/', s, '.txt') END AS label, CASE WHEN image_id % 5 > 0 THEN concat('seen/', s, '_debug.png') END AS debug
FROM (SELECT image_id, regexp_extract(file_name, '^([^.]*)', 1) AS s FROM fx_image)""", "fx_image")  # fmt: skip
def artefact_triplets(v: Views) -> DataFrame:
    """Image, label and debug image of each artefact, of which some have not all."""
    s = T.stem(F.col("file_name"))
    parts = [(F.lit(True), "made/", ".jpg"), (F.col("image_id") % 4 > 0, "labels/", ".txt"), (F.col("image_id") % 5 > 0, "seen/", "_debug.png")]
    made = F.array(*[F.when(there, F.struct(F.concat(s, F.lit(end)).alias("name"), F.concat(F.lit(at), s, F.lit(end)).alias("path"))) for there, at, end in parts])
    return B.triplets(v.fx_image.select(F.inline(F.filter(made, lambda x: x.isNotNull()))))


@query("""SELECT image_id::VARCHAR AS image, name AS cls, x1, y1, x1 + w AS x2, y1 + h AS y2, count(*) OVER (PARTITION BY image_id)::INT AS n_pred FROM fx_box JOIN fx_class USING (class_id) WHERE image_id % 13 > 0 AND image_id % 17 > 0
UNION ALL SELECT image_id::VARCHAR, NULL, NULL, NULL, NULL, NULL, count(*)::INT FROM fx_box WHERE image_id % 13 = 0 OR image_id % 17 = 0 GROUP BY image_id""", "fx_box fx_class")  # fmt: skip
def grounding_from_files(v: Views) -> DataFrame:
    """Boxes from result files that hold them as JSON, some of it cut off or empty: these images have no boxes."""
    root, b = folder(v, "grounding"), v.fx_box.join(v.fx_class, "class_id")
    boxes = b.select("image_id", F.col("ann_no").alias("pos"), F.col("name").alias("cls"), "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))
    rows = G.boxes_json(boxes).join(boxes.groupBy("image_id").agg(F.count("*").alias("n")), "image_id")
    text = F.when(F.col("image_id") % 17 == 0, "").when(F.col("image_id") % 13 == 0, F.expr("left(pred_boxes, length(pred_boxes) - 9)")).otherwise(F.col("pred_boxes"))
    columns = [F.col("image_id"), F.lit(0), F.col("n"), F.lit(0), *[F.lit(0.0)] * 3, F.lit(""), F.lit(""), text, F.lit(0.5)]
    csv_files(rows, F.concat(chunk("part_"), F.lit("/grounding.csv")), of_schema(B.GROUNDING), columns, root)
    one = F.explode_outer("pred_boxes").alias("p")
    return B.grounding_results(v.spark, root).select("image", "n_pred", one).select("image", "n_pred", "p.cls", *[F.get("p.box", F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])


@query("SELECT question_id, image_id::VARCHAR AS image, cls, concat('Is there a ', cls, ', \"now\"?') AS text, label, tier FROM fx_answer", "fx_answer")
def questions_from_files(v: Views) -> DataFrame:
    """Questions as JSON lines in a folder a tier."""
    root = folder(v, "questions")
    text = F.concat(F.lit("Is there a "), "cls", F.lit(', "now"?'))
    K.write_questions(v.fx_answer.select("question_id", F.col("image_id").cast("string").alias("image"), "cls", text.alias("text"), "label", "tier"), root)
    return B.questions(v.spark, root).select(F.col("question_id").cast("long").alias("question_id"), "image", "cls", "text", "label", "tier")


@query("SELECT 'set/images' AS folders, 'a,b' AS classes, count(DISTINCT image_id)::INT AS n_images, 42 AS seed FROM fx_answer", "fx_answer")
def question_set_metadata(v: Views) -> DataFrame:
    m = K.question_metadata(v.fx_answer, ["a", "b"], ["set/images"], 42)
    return m.select(F.array_join("images_dirs", ",").alias("folders"), F.array_join("classes", ",").alias("classes"), "n_images", "seed")


@query("""+m AS (SELECT * FROM (VALUES ('model_0', 2), ('model_1', 7)) t(model, size))
SELECT question_id, model, tier, CASE image_id % 3 WHEN 0 THEN 'pre' ELSE 'post' END AS stage, size, label, response, inference_s FROM fx_answer JOIN m USING (model) WHERE image_id % 3 < 2""", "fx_answer")  # fmt: skip
def staged_answers_from_files(v: Views) -> DataFrame:
    """Answers before and after tuning by their folders, with the sizes of the models; other folders and unknown models go."""
    root = folder(v, "staged")
    stage = F.element_at(F.array(F.lit("pre"), F.lit("post"), F.lit("draft")), (F.col("image_id") % 3 + 1).cast("int"))
    path = F.concat_ws("/", chunk("part_", ANSWERED_IN_A_FILE), F.concat_ws("_", "model", stage), F.concat(F.lit("pope_x_"), "tier", F.lit(".csv")))
    csv_files(v.fx_answer, path, of_schema(B.ANSWERS), [*map(F.col, ("question_id", "image_id", "cls", "label", "response", "inference_s")), F.lit(0.0)], root)
    models = v.spark.createDataFrame([("model_0", 2), ("model_1", 7), ("model_9", 9)], "model string, size int")
    return B.staged_answers(v.spark, root, models).select(F.col("question_id").cast("long").alias("question_id"), "model", "tier", "stage", "size", "label", "response", "inference_s")


@query(f"+{PARSED} SELECT image_id, line_no, printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h) AS line FROM good WHERE class_id IN (1, 3)", "fx_label_line")
def rendered_lines_of_classes(v: Views) -> DataFrame:
    kept = L.of_classes(L.parse_lines(v.fx_label_line), [1, 3])
    return kept.select("image_id", "line_no", T.label_line(*[F.col(c) for c in ("class_id", "cx", "cy", "w", "h")]).alias("line"))


@query("SELECT class_id, count(*) AS n, round(avg(score), 4) AS score, round(max(x2), 4) AS widest FROM fx_det GROUP BY class_id", "fx_det")
def metrics_from_file(v: Views) -> DataFrame:
    root = folder(v, "metrics")
    K.write_metrics(v.fx_det.groupBy("class_id").agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.max("x2").alias("widest")), root)
    return v.spark.read.schema("class_id int, n long, score double, widest double").option("header", True).csv(root)
