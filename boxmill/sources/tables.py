"""Prompts, questions, answers, logs and curves from files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import broadcast_below

PROMPTS = "prompt string, class_name string, class_id int"
QUESTIONS = "question_id int, image string, cls string, text string, label string"
ANSWERS = "question_id int, image string, cls string, label string, response string, inference_s double, vram_mb double"
GROUNDING = "image string, n_gt int, n_pred int, n_matched int, precision double, recall double, mean_iou double, gt_classes string, pred_classes string, pred_boxes string, inference_s double"
LOG = "image_out string, source_image string, class_id int, class_name string, prompt string, cx int, cy int, obj_w int, obj_h int, bbox_xc double, bbox_yc double, bbox_w double, bbox_h double, guidance_scale double, num_inference_steps int"
#: Names of a curve's metric column; the first one present is it.
METRICS = ("metrics/mAP50-95(B)", "metrics/mAP_0.5:0.95", "map50-95", "metrics/mAP50-95", "val/mAP50-95")


def _csv(spark: SparkSession, path: str, schema: str, glob: str | None = None) -> DataFrame:
    r = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("recursiveFileLookup", True)
    return (r.option("pathGlobFilter", glob) if glob else r).csv(path)


def prompts(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, PROMPTS)


def prompts_by_class(rows: DataFrame) -> DataFrame:
    """(class_id, name, prompts): each id's first name and its prompts, trimmed, in the order of the rows."""
    at = F.monotonically_increasing_id()
    kept = rows.select("class_id", at.alias("at"), F.trim("class_name").alias("name"), F.regexp_replace(F.trim("prompt"), r'^"+|"+$', "").alias("prompt"))
    lines = F.sort_array(F.collect_list(F.struct("at", "prompt")))
    return kept.groupBy("class_id").agg(F.min_by("name", "at").alias("name"), F.transform(lines, lambda x: x["prompt"]).alias("prompts"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines; blank lines are skipped."""
    return spark.read.schema(QUESTIONS).json(path).where("question_id is not null")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers with model and tier from file names pope_{model}_{tier}.csv, at any depth."""
    a = _csv(spark, path, ANSWERS, "pope_*.csv").withColumn("file", F.col("_metadata.file_name")).withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    name = r"^pope_(.+)_(random|popular|adversarial)\.csv$"
    a = a.withColumns({"model": F.regexp_extract("file", name, 1), "tier": F.regexp_extract("file", name, 2), "label": F.lower(F.trim("label"))})
    return a.where("model <> ''").drop("file")


def staged_answers(spark: SparkSession, path: str, models: DataFrame) -> DataFrame:
    """Answers in folders {model}_{pre,post}, with the stage and the models' own columns (model, ...)."""
    a = answers(spark, path).withColumn("stage", F.regexp_extract("folder", r"_(pre|post)$", 1)).where("stage <> ''")
    return a.withColumn("model", F.regexp_replace("folder", r"_(pre|post)$", "")).join(broadcast_below(models), "model").drop("folder")


def generation_log(spark: SparkSession, path: str) -> DataFrame:
    """Logs at any depth, with experiment (the folder) and stem of the image made."""
    log = _csv(spark, path, LOG, "generation_log.csv").withColumn("experiment", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    return log.withColumn("stem", F.regexp_extract("image_out", r"([^/\\]*?)(\.[^./\\]*)?$", 1))


def classes_of_artefacts(log: DataFrame) -> DataFrame:
    """(experiment, stem, classes): the class names of each artefact in the order of their places."""
    return log.groupBy("experiment", "stem").agg(F.transform(F.sort_array(F.collect_list(F.struct("cy", "cx", "class_name"))), lambda s: s["class_name"]).alias("classes"))


def training_curve(spark: SparkSession, path: str) -> DataFrame:
    """(run, epoch, metric) from CSV files with one of the known metric columns; the run is the file's folder."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("recursiveFileLookup", True).csv(path)
    name = next((m for m in METRICS if m in raw.columns), None)
    if name is None:
        raise ValueError(f"none of the metric columns {', '.join(METRICS)}")
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return raw.select(run.alias("run"), F.col("epoch").try_cast("int").alias("epoch"), F.col(f"`{name}`").try_cast("double").alias("metric"))


def experiments(spark: SparkSession, shared: dict, rows: list[dict]) -> DataFrame:
    """The experiments of a grid: shared values, with each row's own over them."""
    fields = sorted({k for r in rows for k in r} | set(shared))
    return spark.createDataFrame([tuple(({**shared, **r}).get(f) for f in fields) for r in rows], fields)


def grounding_results(spark: SparkSession, path: str) -> DataFrame:
    """Grounding rows with pred_boxes parsed; bad JSON gives no boxes."""
    from ..operators.grounding import boxes_from_json

    return boxes_from_json(_csv(spark, path, GROUNDING))


def triplets(artefacts: DataFrame) -> DataFrame:
    """(stem, image, label, debug) of artefacts (name, path): labels are .txt, debug images end in _debug."""
    from ..functions.text import extension, stem

    s = stem(F.col("name"))
    kind = F.when(extension(F.col("name")) == ".txt", "label").when(s.endswith("_debug"), "debug").otherwise("image")
    a = artefacts.select(F.regexp_replace(s, r"_debug$", "").alias("stem"), kind.alias("kind"), "path")
    return a.groupBy("stem").pivot("kind", ["image", "label", "debug"]).agg(F.min("path"))


def accepted(log_classes: DataFrame, decisions: DataFrame) -> DataFrame:
    """The accepted artefacts (experiment, stem), with the name they are exported by."""
    yes = decisions.where("accepted").select("experiment", "stem")
    return log_classes.join(yes, ["experiment", "stem"], "left_semi").withColumn("export_name", F.concat_ws("_", "experiment", "stem"))


def newest_answer(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One answer a key: the last by order."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
