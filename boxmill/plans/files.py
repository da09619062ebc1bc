"""Queries over files that are written from the given tables first and read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.lineage import shared_dir
from ..sources import labels as S
from ..sources import sinks as K
from ..sources import tables as B
from .base import Views, query, twin_of


def folder(v: Views, name: str) -> str:
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def named_lines(v: Views) -> DataFrame:
    i = v.fx_image.select("image_id", "split", T.stem(F.col("file_name")).alias("stem"))
    return v.fx_label_line.join(i, "image_id").select("split", "stem", "line_no", "line")


@query("SELECT split, regexp_extract(file_name, '^([^.]*)', 1) AS stem, CAST(row_number() OVER (PARTITION BY image_id ORDER BY line_no) - 1 AS INT) AS line_no, line FROM fx_label_line JOIN fx_image USING (image_id)", "fx_image fx_label_line")
def labels_from_files(v: Views) -> DataFrame:
    root = folder(v, "labels")
    K.write_labels(named_lines(v), root, packed=True)
    return S.label_lines(S.split_label_files(v.spark, root))


@query("""+ok AS (SELECT split, count(*) AS n FROM fx_label_line JOIN fx_image USING (image_id) WHERE len(string_split(line, ' ')) >= 5 AND TRY_CAST(string_split(line, ' ')[1] AS INT) IS NOT NULL GROUP BY split)
SELECT split, count(*) AS images, max(n) AS annotations, 6::BIGINT AS categories FROM fx_image JOIN ok USING (split) GROUP BY split""", "fx_image fx_label_line")  # fmt: skip
def coco_from_files(v: Views) -> DataFrame:
    """The documents have an object a line, so any number of tasks can read one."""
    root = folder(v, "coco")
    K.write_coco(v.fx_image, v.fx_label_line, v.fx_class, root)
    lines = v.spark.read.text(root).select("value", T.stem(F.col("_metadata.file_name")).alias("split")).where(F.trim("value").startswith('{"id"'))
    kinds = {"images": "file_name", "annotations": "bbox", "categories": "supercategory"}
    return lines.groupBy("split").agg(*[F.count_if(F.col("value").contains(f'"{mark}":')).alias(k) for k, mark in kinds.items()])


def tree(v: Views) -> DataFrame:
    """A label file for every image, without content where it has no lines."""
    docs = K.label_documents(v.fx_label_line, ("image_id",))
    return v.fx_image.join(docs, "image_id", "left").select("split", T.stem(F.col("file_name")).alias("stem"), "content")


TREE = """+t AS (SELECT split, regexp_extract(file_name, '^([^.]*)', 1) AS stem, coalesce(n, 0) AS n_lines, coalesce(chars, 0)::BIGINT AS chars FROM fx_image
 LEFT JOIN (SELECT image_id, count(*) AS n, sum(length(line) + 1) AS chars FROM fx_label_line GROUP BY image_id) USING (image_id))"""


def counted(files: DataFrame) -> DataFrame:
    return files.select("split", "stem", F.regexp_count("content", F.lit("\n")).cast("long").alias("n_lines"), F.length("content").cast("long").alias("chars"))


@query(f"{TREE} SELECT split, stem, n_lines, chars FROM t WHERE split <> 'train'", "fx_image fx_label_line")
def label_tree_splits(v: Views) -> DataFrame:
    """Label trees are written for all splits, and two are read, without looking into the folder of the third."""
    root = folder(v, "tree")
    K.write_label_tree(tree(v), root, packed=True)
    return counted(S.read_label_tree(v.spark, root)).where(F.col("split").isin("val", "test"))


@query(f"{TREE} SELECT NULL::VARCHAR AS split, stem, n_lines, chars FROM t", "fx_image fx_label_line")
def label_tree_flat(v: Views) -> DataFrame:
    root = folder(v, "flat")
    K.write_label_tree(tree(v).withColumn("split", F.lit(None).cast("string")), root, packed=True)
    return counted(S.flat_label_files(v.spark, root))


@twin_of("coco_annotations")
def coco_document(v: Views) -> DataFrame:
    """The annotations that the documents hold; an object is a line, so any number of tasks can read one."""
    root = folder(v, "coco")
    K.write_coco(v.fx_image, v.fx_label_line, v.fx_class, root)
    lines = v.spark.read.text(root).select("value", T.stem(F.col("_metadata.file_name")).alias("split")).where(F.col("value").contains('"bbox":'))
    a = lines.select("split", F.from_json(F.rtrim(F.col("value"), F.lit(",")), "id long, image_id int, category_id int, bbox array<double>").alias("a"))
    return a.select("split", "a.id", F.col("a.image_id").alias("image"), "a.category_id", *[F.round(F.col("a.bbox")[k], 1).alias(f"bbox_{c}") for k, c in enumerate("xywh")])


@query("SELECT question_id, model, tier, label, response, inference_s FROM fx_answer", "fx_answer")
def answers_from_files(v: Views) -> DataFrame:
    root, a = folder(v, "answers"), v.fx_answer
    quoted = [F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')) for c in ("question_id", "image_id", "cls", "label", "response", "inference_s")]
    line = F.concat_ws(",", *quoted, F.lit("0.0"))
    part = F.concat_ws("/", F.floor(F.col("image_id") / 2000).cast("string"), F.concat(F.lit("pope_"), "model", F.lit("_"), "tier", F.lit(".csv")))
    head = "question_id,image,cls,label,response,inference_s,vram_mb"
    K.write_files(a.groupBy(part.alias("path")).agg(F.concat(F.lit(head + "\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n")).alias("content")), root)
    return B.answers(v.spark, root).select(F.col("question_id").cast("long").alias("question_id"), "model", "tier", "label", "response", "inference_s")


@query("SELECT concat('run_', CAST(run AS VARCHAR)) AS run, epoch, map5095 AS metric FROM fx_epoch", "fx_epoch")
def curves_from_files(v: Views) -> DataFrame:
    root, e = folder(v, "curves"), v.fx_epoch
    line = F.concat_ws(",", F.col("epoch").cast("string"), F.coalesce(F.col("map5095").cast("string"), F.lit("")))
    files = e.groupBy(F.concat(F.lit("run_"), F.col("run").cast("string"), F.lit("/results.csv")).alias("path"))
    K.write_files(files.agg(F.concat(F.lit("epoch,map50-95\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n")).alias("content")), root)
    return B.training_curve(v.spark, root)


@query("SELECT question_id, CASE WHEN question_id % 3 = 0 THEN upper(response) ELSE response END AS response FROM fx_answer", "fx_answer")
def newest_of_appended(v: Views) -> DataFrame:
    """An image of over 16 questions shares their ids with the next image, so an answer is known by both."""
    root, a = folder(v, "appended"), v.fx_answer.select("image_id", "question_id", "response")
    K.append(a.withColumn("run", F.lit(1)), root)
    K.append(a.where("question_id % 3 = 0").withColumns({"response": F.upper("response"), "run": F.lit(2)}), root)
    return B.newest_answer(v.spark.read.parquet(root), ["image_id", "question_id"], "run").select("question_id", "response")


@query("SELECT image_id, split FROM fx_image", "fx_image")
def manifest_from_files(v: Views) -> DataFrame:
    root = folder(v, "manifest")
    K.write_manifest(v.fx_image.select("image_id", "split"), root)
    return v.spark.read.parquet(root).select("image_id", "split")


@query("""SELECT image_id, regexp_extract(file_name, '^([^.]*)', 1) AS stem, '.jpg' AS extension, split AS split_name, concat('__data__', split, '__images__', regexp_extract(file_name, '^([^.]*)', 1)) AS unique_name,
 CASE WHEN image_id % 9000 >= 3600 THEN printf('%dh%02dm', (image_id % 9000) // 3600, ((image_id % 9000) // 60) % 60) WHEN image_id % 9000 >= 60 THEN printf('%dm%02ds', (image_id % 9000) // 60, image_id % 60) ELSE printf('%ds', image_id % 9000) END AS duration,
 concat('a ', CASE WHEN split = 'train' THEN 'bright' ELSE 'dim' END, ' scene') AS prompt FROM fx_image""", "fx_image")  # fmt: skip
def names_and_times(v: Views) -> DataFrame:
    path = F.concat(F.lit("/data/"), "split", F.lit("/images/"), "file_name")
    light = T.lighting(F.lit("a [LIGHTING] scene"), F.col("split"), {"train": "bright", "night": "dim"}, "night")
    return v.fx_image.select("image_id", T.stem(path).alias("stem"), T.extension(path).alias("extension"), T.split_of(path).alias("split_name"), T.unique_name(path).alias("unique_name"), T.duration(F.col("image_id") % 9000).alias("duration"), light.alias("prompt"))
