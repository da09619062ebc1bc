"""Writers: split manifests, label files, COCO documents, questions, logs and metric tables."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.labels import coco_annotations, coco_images
from ..operators.lineage import cut
from .label_tree import write_label_tree


def write_manifest(assigned: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The assignment of images, a folder a split; no image is copied."""
    assigned.write.mode(mode).partitionBy("split").parquet(path)


def label_documents(lines: DataFrame, keys: tuple[str, ...] = ("split", "image_id")) -> DataFrame:
    """Keys and content: the lines of an image in order, each with a newline behind."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"])
    return lines.groupBy(*keys).agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("content"))


#: Files that a Python worker of write_files holds at once; Spark's own number of rows would be hundreds of MB of them.
ROWS = 50


def write_files(files: DataFrame, root: str) -> int:
    """A file for each row (path, content) below root, and how many there are.

    Each partition writes its own files, to a name of its own first and then
    under the final one, so a task that runs again leaves the same files. root
    is a path or URI of a file system that all executors share.
    """
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root.replace("file:///", "/").replace("file:/", "/"))
        made, n = set(), 0
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                target = f"{base}/{path}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                own = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(own) as out:
                    out.write(content.encode())
                system.move(own, target)
                n += 1
        yield pd.DataFrame({"n": [n]})

    spark, known = files.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(known)
    spark.conf.set(known, ROWS)
    try:
        return files.select("path", "content").mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finally:
        spark.conf.set(known, before)


def write_labels(lines: DataFrame, path: str, *, packed: bool = False) -> int:
    """One text file an image, split/labels/stem.txt, of lines (split, stem, line_no, line), and how many there are; packed as write_label_tree() does it."""
    seen = Observation()
    docs = label_documents(lines, ("split", "stem")).observe(seen, F.count("*").alias("n"))
    write_label_tree(docs, path, packed=packed)
    return seen.get["n"]


def coco_documents(images: DataFrame, lines: DataFrame, classes: DataFrame) -> DataFrame:
    """(split, part, id, value): the JSON objects of a split's categories, images and annotations, in the order of part and id."""
    ids = coco_images(images)
    i = ids.select("split", F.lit("2 images").alias("part"), F.col("coco_id").cast("long").alias("id"), F.to_json(F.struct(F.col("coco_id").alias("id"), "file_name", "width", "height")).alias("value"))
    a = coco_annotations(images, lines, ids)
    box = F.array("bbox_x", "bbox_y", "bbox_w", "bbox_h").alias("bbox")
    a = a.select("split", F.lit("3 annotations").alias("part"), F.col("id").cast("long"), F.to_json(F.struct("id", F.col("image").alias("image_id"), "category_id", box, "area", F.array().cast("array<double>").alias("segmentation"), F.lit(0).alias("iscrowd"))).alias("value"))
    c = classes.select(F.col("class_id").cast("long").alias("id"), F.to_json(F.struct((F.col("class_id") + 1).alias("id"), "name", F.lit("object").alias("supercategory"))).alias("value"))
    c = images.select("split").distinct().crossJoin(c).select("split", F.lit("1 categories").alias("part"), "id", "value")
    return i.unionByName(a).unionByName(c)


#: The sections of a document in their order, as coco_documents() numbers them; each object has two bytes in front.
SECTIONS = ("1 categories", "2 images", "3 annotations")
FIRST, NEXT = b"\n ", b",\n"


def _places(sizes: list, today: str) -> tuple[dict[str, list[tuple[int, bytes]]], dict[tuple[str, str, int], tuple[int, bool]], dict[str, int]]:
    """Of the bytes (split, part, range, bytes) of each range: the text between the objects of each document by offset, the offset of each range and whether it begins its section, and the length of each document."""
    frame: dict[str, list[tuple[int, bytes]]] = {}
    starts: dict[tuple[str, str, int], tuple[int, bool]] = {}
    lengths: dict[str, int] = {}
    for split in sorted({r["split"] for r in sizes}):
        info = json.dumps({"description": f"Dataset {split}", "date_created": today})
        at, text, frame[split] = 0, f'{{"info": {info},\n"licenses": []', []
        for part in SECTIONS:
            frame[split].append((at, (text + f',\n"{part[2:]}": [').encode()))
            at += len(frame[split][-1][1])
            for k, r in enumerate(sorted((r for r in sizes if r["split"] == split and r["part"] == part), key=lambda r: r["range"])):
                starts[split, part, r["range"]] = at, k == 0
                at += r["bytes"]
            text = "\n]"
        frame[split].append((at, b"\n]\n}\n"))
        lengths[split] = at + len(frame[split][-1][1])
    return frame, starts, lengths


def write_coco(images: DataFrame, lines: DataFrame, classes: DataFrame, path: str) -> int:
    """One COCO document a split, path/split.json, with info and licenses, and how many there are.

    A document's objects, one a line, are dealt into ranges of their order. The
    bytes of each range give its offset in the document, so any number of tasks
    write one document at the same time, each with one object in memory. They
    write to a file beside it that gets its name when all have ended; a task that
    runs again writes the same bytes to the same place, and after a failure
    nothing is left. path is in a file system that all executors mount, as
    offsets need one.
    """
    spark, base = images.sparkSession, path.replace("file:///", "/").replace("file:/", "/").rstrip("/")
    if "://" in base:
        raise ValueError(f"{path}: documents are written by offsets, which needs a mounted file system")
    rows = coco_documents(images, lines, classes)
    ranged = cut(rows.repartitionByRange("split", "part", "id").withColumn("range", F.spark_partition_id()), "objects")
    sizes = ranged.groupBy("split", "part", "range").agg(F.sum(F.octet_length("value") + len(NEXT)).alias("bytes")).collect()  # a row a range
    today = spark.range(1).select(F.date_format(F.current_date(), "yyyy/MM/dd")).first()[0]
    frame, starts, lengths = _places(sizes, today)
    own = {split: f"{base}/.{uuid.uuid4().hex}" for split in frame}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, n = None, None, 0
        try:
            for batch in batches:
                for split, part, range_, value in zip(*(batch.column(c).to_pylist() for c in ("split", "part", "range", "value")), strict=True):
                    if (split, part, range_) != at:
                        if out:
                            out.close()
                        at = split, part, range_
                        offset, first = starts[at]
                        out = open(own[split], "r+b")
                        out.seek(offset)
                        out.write(FIRST if first else NEXT)
                    else:
                        out.write(NEXT)
                    out.write(value.encode())
                    n += 1
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    os.makedirs(base, exist_ok=True)
    try:
        for split, file in own.items():
            with open(file, "wb") as f:
                f.truncate(lengths[split])
                for offset, text in frame[split]:
                    f.seek(offset)
                    f.write(text)
        runs = ranged.repartition("split", "part", "range").sortWithinPartitions("split", "part", "range", "id")
        runs.select("split", "part", "range", "value").mapInArrow(put, "n long").agg(F.sum("n")).first()
        for split, file in own.items():
            os.replace(file, f"{base}/{split}.json")
    finally:
        for file in own.values():
            if os.path.exists(file):
                os.remove(file)
    return len(own)


def write_questions(questions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in a folder a tier; each task writes its own rows, as a tier can be a third of the table."""
    questions.write.mode(mode).partitionBy("tier").json(path)


def question_metadata(questions: DataFrame, class_names: list[str], folders: list[str], seed: int) -> DataFrame:
    """One row: image folders, classes, build time, number of images, seed."""
    n = questions.agg(F.count_distinct("image_id").cast("int").alias("n_images"))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return n.select(F.lit(folders).alias("images_dirs"), F.lit(class_names).alias("classes"), stamp.alias("built_at"), "n_images", F.lit(seed).alias("seed"))


def append(rows: DataFrame, path: str) -> None:
    """Rows added to a result table that later runs add to as well."""
    rows.write.mode("append").parquet(path)


def write_metrics(rows: DataFrame, path: str, digits: int = 4, mode: str = "errorifexists") -> None:
    """A small metric table as one CSV file, doubles rounded."""
    out = rows.withColumns({c: F.round(c, digits) for c, kind in rows.dtypes if kind == "double"})
    out.coalesce(1).write.mode(mode).option("header", True).csv(path)
