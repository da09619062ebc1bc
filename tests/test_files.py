"""Label trees and COCO documents as files written by several tasks."""

from __future__ import annotations

import importlib
import json
import os

import pytest

from boxmill.sources import labels as S
from boxmill.sources import sinks as K
from boxmill.sources.label_tree import LabelReader, read_label_tree, write_label_tree
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

KIND = "split string, stem string, content string"


@pytest.fixture
def rows():
    return [("train" if k % 3 else "val", f"i{k}", f"0 0.5 0.5 0.1 0.{k}\né\n" if k % 5 else "") for k in range(50)]


def test_a_tree_comes_back_with_its_empty_files(spark, tmp_path, rows):
    root = f"file:{tmp_path}/tree"
    write_label_tree(spark.createDataFrame(rows, KIND).repartition(5), root)
    for layout in ("split", "auto"):
        files = read_label_tree(spark, root, layout, files_per_task=7)
        assert files.rdd.getNumPartitions() == 8  # 33 and 17 files
        assert sorted(map(tuple, files.collect())) == sorted(rows)
    assert sorted(os.listdir(tmp_path / "tree")) == ["train", "val"]
    write_label_tree(spark.createDataFrame([("val", "i0", "new"), ("test", "t", None)], KIND), root)
    assert {(r["stem"], r["content"]) for r in read_label_tree(spark, root).where("split = 'test' or stem = 'i0'").collect()} == {("i0", "new"), ("t", "")}
    write_label_tree(spark.createDataFrame(rows[:3], KIND), root, "overwrite")
    assert read_label_tree(spark, root).count() == 3


def test_filters_on_the_split_choose_folders(spark, tmp_path, rows):
    root = str(tmp_path / "tree")
    write_label_tree(spark.createDataFrame(rows, KIND), root)
    for filters, splits, left in [([EqualTo(("split",), "val")], {"val"}, 0), ([In(("split",), ("val", "test")), EqualTo(("stem",), "i0")], {"val"}, 1), ([EqualTo(("split",), "no")], set(), 0)]:
        reader = LabelReader({"path": root, "layout": "split"})
        assert len(list(reader.pushFilters(filters))) == left
        assert {p.split for p in reader.partitions() if p.names} == splits
    files = read_label_tree(spark, root)
    assert files.where("split = 'val' and stem like 'i1%'").count() == sum(s == "val" and n.startswith("i1") for s, n, _ in rows)
    with pytest.raises(Exception, match="layout"):
        read_label_tree(spark, root, "deep").collect()


def test_flat_and_empty_folders(spark, tmp_path):
    write_label_tree(spark.createDataFrame([(None, "a", "1 2"), (None, "b", None)], KIND), str(tmp_path / "flat"))
    (tmp_path / "flat/a.jpg").write_bytes(b"x")
    for files in (S.flat_label_files(spark, str(tmp_path / "flat")), read_label_tree(spark, str(tmp_path / "flat"))):
        assert sorted(map(tuple, files.collect()), key=str) == [(None, "a", "1 2"), (None, "b", "")]
    assert S.split_label_files(spark, str(tmp_path / "flat")).count() == 0
    assert read_label_tree(spark, str(tmp_path / "missing")).count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path, rows):
    bad = spark.createDataFrame(rows, KIND).repartition(4).withColumn("content", F.when(F.col("stem") == "i7", F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        write_label_tree(bad, str(tmp_path / "bad"))
    assert [f for _, _, files in os.walk(tmp_path / "bad") for f in files] == []


def coco_input(spark, n: int):
    images = spark.createDataFrame([(k, f"ü{k:04d}.jpg", ("train", "val", "none")[k % 3 if k < n - 1 else 2], 100, 50) for k in range(n)], "image_id long, file_name string, split string, width int, height int")
    lines = spark.createDataFrame([(k, j, f"{j % 2} 0.5 0.5 0.2 0.{j + 1}") for k in range(n) if k % 3 < 2 for j in range(k % 4)], "image_id long, line_no int, line string")
    return images.repartition(4), lines.repartition(4), S.class_table(spark, ["p", "q"])


def test_a_document_by_many_tasks(spark, tmp_path):
    images, lines, classes = coco_input(spark, 60)
    assert K.write_coco(images, lines, classes, f"file://{tmp_path}/coco") == 3
    assert sorted(os.listdir(tmp_path / "coco")) == ["none.json", "train.json", "val.json"]
    for split in ("train", "val", "none"):
        found = json.loads((tmp_path / f"coco/{split}.json").read_text())
        assert list(found) == ["info", "licenses", "categories", "images", "annotations"]
        names = sorted(r["file_name"] for r in images.where(F.col("split") == split).collect())
        assert [(i["id"], i["file_name"]) for i in found["images"]] == list(enumerate(names, 1))
        assert [a["id"] for a in found["annotations"]] == list(range(1, len(found["annotations"]) + 1))
        want = [(names.index(n) + 1, j % 2 + 1) for n in names for j in range(int(n[1:5]) % 4) if int(n[1:5]) % 3 < 2]
        assert [(a["image_id"], a["category_id"]) for a in found["annotations"]] == want
    assert not json.loads((tmp_path / "coco/none.json").read_text())["annotations"]


def test_a_failed_document_leaves_nothing(spark, tmp_path, monkeypatch):
    images, lines, classes = coco_input(spark, 12)
    monkeypatch.setattr(K, "_places", lambda *_: ({"val": [(0, b"x")]}, {}, {"val": 1}))  # no task finds its place
    with pytest.raises(Exception, match="KeyError"):
        K.write_coco(images, lines, classes, str(tmp_path / "coco"))
    assert os.listdir(tmp_path / "coco") == []
    with pytest.raises(ValueError, match="mounted"):
        K.write_coco(images, lines, classes, "hdfs://host/coco")


def test_a_packed_tree_takes_few_files_and_comes_back_whole(spark, tmp_path, rows):
    root = f"file:{tmp_path}/packed"
    write_label_tree(spark.createDataFrame(rows, KIND).repartition(2), root, packed=True)
    for layout in ("split", "auto"):
        assert sorted(map(tuple, read_label_tree(spark, root, layout).collect())) == sorted(rows)
    assert read_label_tree(spark, root).where("split = 'val'").count() == sum(s == "val" for s, _, _ in rows)
    assert sum(len(files) for _, _, files in os.walk(tmp_path / "packed")) <= 4  # two tasks, two splits
    with pytest.raises(Exception, match="without label files"):
        write_label_tree(spark.createDataFrame(rows, KIND), root, packed=True)
    write_label_tree(spark.createDataFrame([(None, "a", "1 2"), (None, "a", None)], KIND), root, "overwrite", packed=True)
    assert sorted(map(tuple, S.flat_label_files(spark, root).collect())) == [(None, "a", ""), (None, "a", "1 2")]


def test_archives_are_closed_when_they_are_full(tmp_path, monkeypatch):
    import pyarrow as pa
    from boxmill.sources import label_tree as L
    from pyarrow import fs

    monkeypatch.setattr(L, "PACKED", 10)
    batch = pa.RecordBatch.from_pydict({"split": ["a"] * 25, "stem": [str(k) for k in range(25)], "content": ["x"] * 25})
    writer = L.LabelWriter({"path": str(tmp_path), "packed": "true"}, False)
    assert len(writer._packs(iter([batch]), fs.LocalFileSystem(), str(tmp_path))) == 3
    reader = L.LabelReader({"path": str(tmp_path)})
    got = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("stem").to_pylist()]
    assert sorted(map(int, got)) == list(range(25))


def test_the_label_queries_write_no_file_an_image(spark, tmp_path, monkeypatch):
    """A file an image took a block of the disk each: 9 million of them 36 GB."""
    from boxmill.plans import registry

    P = importlib.import_module("boxmill.plans.files")
    monkeypatch.setattr(P, "folder", lambda v, name: f"file://{tmp_path}/{name}")
    for query, name in (("labels_from_files", "labels"), ("label_tree_splits", "tree"), ("label_tree_flat", "flat")):
        assert registry.QUERIES[query](spark, "/root/testdata/sf0.001").count() > 0
        assert sum(len(files) for _, _, files in os.walk(tmp_path / name)) < 60


def test_annotations_are_numbered_across_buckets_without_running_twice(spark, monkeypatch):
    from boxmill.operators import labels

    monkeypatch.setattr(labels, "OF_A_BUCKET", 3)
    images, lines, _ = coco_input(spark, 60)
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    got = labels.coco_annotations(images, lines.mapInArrow(counted, lines.schema)).orderBy("split", "id").collect()
    assert ran.value == lines.count()
    for split in ("train", "val"):
        own = [r for r in got if r["split"] == split]
        assert [r["id"] for r in own] == list(range(1, len(own) + 1)) and [r["image"] for r in own] == sorted(r["image"] for r in own)


def test_a_tier_is_written_by_many_tasks(spark, tmp_path):
    questions = spark.range(400).selectExpr("id AS question_id", "'a' AS tier").repartition(4)
    K.write_questions(questions, str(tmp_path / "q"))
    assert len([f for f in os.listdir(tmp_path / "q/tier=a") if f.endswith(".json")]) == 4
    assert spark.read.json(str(tmp_path / "q")).count() == 400


def test_few_files_are_held_at_once(spark, tmp_path, monkeypatch):
    """A batch of 10,000 files of 50 KB was 500 MB in each worker."""
    seen = []
    monkeypatch.setattr(K, "ROWS", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    first = type(spark.range(1)).first
    monkeypatch.setattr(type(spark.range(1)), "first", lambda df: (seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), first(df))[1])
    assert K.write_files(spark.range(30).selectExpr("concat('f', id) AS path", "'x' AS content"), str(tmp_path)) == 30
    assert seen == ["7"] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
