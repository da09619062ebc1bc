"""Label sets from files, splits and writers."""

from __future__ import annotations

import json
import random

import pytest

from boxmill.functions import text as T
from boxmill.operators import admission as A
from boxmill.operators import labels as L
from boxmill.sources import labels as S
from boxmill.sources import sinks as K
from boxmill.sources import tables as B
from pyspark.sql import functions as F


@pytest.fixture
def root(tmp_path):
    for split, names in {"train": ["a", "b"], "val": ["a", "c"]}.items():
        (tmp_path / split / "images").mkdir(parents=True)
        (tmp_path / split / "labels").mkdir()
        for n in names:
            (tmp_path / split / "images" / f"{n}.jpg").write_bytes(b"x")
    (tmp_path / "train/labels/a.txt").write_text("0 0.5 0.5 0.2 0.2\n\n1 0.1 0.1 0.1 0.1\n")
    (tmp_path / "train/labels/b.txt").write_text("")
    return tmp_path


def test_empty_label_files_are_hard_negatives(spark, root):
    files, images = S.split_label_files(spark, str(root)), S.images(spark, str(root))
    found = {(r["split"], r["stem"]): (r["label_exists"], r["content"]) for r in S.labelled_images(images, files).collect()}
    assert found[("train", "b")] == (True, "")
    assert found[("val", "c")][0] is False
    assert S.has_split_layout(images)
    assert [r["line_no"] for r in S.label_lines(files).orderBy("line_no").collect()] == [0, 2]


def lines(spark, rows):
    return spark.createDataFrame([(1, k, x) for k, x in enumerate(rows)], "image_id long, line_no int, line string")


def test_bad_lines(spark):
    rows = lines(spark, ["0 0.5 0.5 0.2 0.2", "", "1 0.5", "x 0.5 0.5 0.1 0.1"])
    assert L.parse_lines(rows).count() == 1
    assert sorted(r["ok"] for r in L.parse_lines(rows, mode="count").collect()) == [False, False, True]
    with pytest.raises(Exception, match="bad label line"):
        L.parse_lines(rows, mode="raise").collect()


def test_greedy_split_is_the_sequential_rule(spark):
    """Many boxes an image and a class in a third of all rows: images that fit nowhere, and quotas that fill early."""
    rng = random.Random(7)
    counts = [(i, c, rng.choice((1, 1, 2, 9, 40))) for i in range(400) for c in {0 if rng.random() < 0.5 else rng.randrange(6) for _ in range(1 + i % 3)}]
    counts += [(900, None, 3), (901, None, 1), (None, 2, 1)]
    rows = spark.createDataFrame(counts, "image_id long, class_id int, n int")
    got = {r["image_id"]: (r["split"], r["fits"]) for r in A.greedy_split(rows, L.SPLITS, (0.7, 0.2, 0.1), 42).collect()}
    hashes = {r["image_id"]: r["h"] for r in rows.select("image_id", T.hash_order(42, F.col("image_id")).alias("h")).distinct().collect()}
    total = {c: sum(n for _, d, n in counts if d == c) for _, c, _ in counts}
    quota = [{c: int(t * 0.7) for c, t in total.items()}, {c: int(t * 0.2) for c, t in total.items()}]
    quota.append({c: t - quota[0][c] - quota[1][c] for c, t in total.items()})
    used = [dict.fromkeys(total, 0) for _ in range(3)]
    want = {}
    for image in sorted(hashes, key=lambda i: (hashes[i] or "", i is not None, i)):
        own = {c: n for i, c, n in counts if i == image}
        s = next((s for s in range(3) if all(used[s][c] + n <= quota[s][c] for c, n in own.items())), None)
        want[image] = ("train" if s is None else L.SPLITS[s], s is not None)
        for c, n in own.items() if s is not None else ():
            used[s][c] += n
    assert got == want and sum(not fits for _, fits in want.values()) > 0
    assert A.greedy_split(rows.limit(0), L.SPLITS, (0.7, 0.2, 0.1), 42).count() == 0


def test_greedy_split_of_parsed_lines_has_each_image_once(spark):
    parsed = spark.range(200).select("id", F.pmod("id", F.lit(3)).cast("int").alias("class_id")).withColumnRenamed("id", "image_id")
    parsed = parsed.unionByName(parsed.where("image_id % 5 = 0").withColumn("class_id", F.lit(2)))
    out = L.greedy_split(parsed)
    assert out.count() == out.select("image_id").distinct().count() == 200
    used = {(r["class_id"], r["split"]): r["count"] for r in parsed.join(out.where("fits"), "image_id").groupBy("class_id", "split").count().collect()}
    for r in parsed.groupBy("class_id").count().collect():
        assert used[(r["class_id"], "val")] <= int(r["count"] * 0.2)


def test_class_names():
    assert S.read_class_names("names: [a, 'b c']\nnc: 2") == ["a", "b c"]
    assert S.read_class_names("names:\n  0: a\n  3: b\npath: x") == {0: "a", 3: "b"}
    assert S.read_class_names("names:\n- a\n- b\n") == ["a", "b"]


def test_writers(spark, tmp_path):
    images = spark.createDataFrame([(1, "a.jpg", "train", 100, 50), (2, "b.jpg", "val", 100, 50)], "image_id long, file_name string, split string, width int, height int")
    rows = lines(spark, ["0 0.5 0.5 0.2 0.2", "1 0.05 0.5 0.2 0.2"])
    assert K.write_coco(images, rows, S.class_table(spark, ["p", "q"]), str(tmp_path / "coco")) == 2
    train, val = (json.loads((tmp_path / f"coco/{k}.json").read_text()) for k in ("train", "val"))
    assert list(train) == ["info", "licenses", "categories", "images", "annotations"] and train["info"]["description"] == "Dataset train" and len(train["info"]["date_created"]) == 10
    assert [(x["id"], x["category_id"], x["bbox"]) for x in train["annotations"]] == [(1, 1, [40.0, 20.0, 20.0, 10.0]), (2, 2, [0.0, 20.0, 20.0, 10.0])]
    assert [c["name"] for c in train["categories"]] == ["p", "q"] and val["annotations"] == [] and val["images"][0]["file_name"] == "b.jpg"
    assert K.write_labels(rows.select(F.lit("train").alias("split"), F.lit("a").alias("stem"), "line_no", "line"), str(tmp_path / "out")) == 1
    assert (tmp_path / "out/train/labels/a.txt").read_text() == "0 0.5 0.5 0.2 0.2\n1 0.05 0.5 0.2 0.2\n"
    docs = K.label_documents(rows.withColumn("split", F.lit("train")))
    assert docs.first()["content"] == "0 0.5 0.5 0.2 0.2\n1 0.05 0.5 0.2 0.2\n"
    K.write_manifest(spark.createDataFrame([(1, "train"), (2, "val")], "image_id long, split string"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("split = 'val'").count() == 1


def test_answer_files(spark, tmp_path):
    (tmp_path / "m_pre").mkdir()
    (tmp_path / "m_pre/pope_big_model_random.csv").write_text('question_id,image,cls,label,response,inference_s,vram_mb\n1,a.jpg,trash, Yes ,"No, none",0.5,1\n')
    (tmp_path / "m_pre/other.csv").write_text("x\n1\n")
    (r,) = B.answers(spark, str(tmp_path)).collect()
    assert (r["model"], r["tier"], r["label"], r["response"]) == ("big_model", "random", "yes", "No, none")
    (r,) = B.staged_answers(spark, str(tmp_path), spark.createDataFrame([("m", 7)], "model string, size int")).collect()
    assert (r["stage"], r["size"]) == ("pre", 7)


def test_logs_and_curves(spark, tmp_path):
    (tmp_path / "exp1").mkdir()
    (tmp_path / "exp1/generation_log.csv").write_text(B.LOG.replace(" string", "").replace(" int", "").replace(" double", "").replace(", ", ",") + "\nout/a_s.png,a.jpg,1,plastic,p,5,6,7,8,0.1,0.1,0.1,0.1,30,20\n")
    log = B.classes_of_artefacts(B.generation_log(spark, str(tmp_path)))
    assert [tuple(r) for r in log.collect()] == [("exp1", "a_s", ["plastic"])]
    yes = B.accepted(log, spark.createDataFrame([("exp1", "a_s", True)], "experiment string, stem string, accepted boolean"))
    assert yes.first()["export_name"] == "exp1_a_s"
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1/results.csv").write_text("epoch, metrics/mAP50-95\n1,0.5\n2,\n")
    assert {tuple(r) for r in B.training_curve(spark, str(tmp_path / "run1")).collect()} == {("run1", 1, 0.5), ("run1", 2, None)}


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(T.duration(F.lit(s))) for s in (5, 65, 3725.0)] == ["5s", "1m05s", "1h02m"]
    assert get(T.unique_name(F.lit("a/b.c/d.jpg"))) == "a__b.c__d"
    assert get(T.lighting(F.lit("at [LIGHTING]"), F.lit("x"), {"midday": "noon", "night": "dark"}, "midday")) == "at noon"
    assert [get(T.yes_or_no(F.lit(x))) for x in ("", "It is not. Yes", "Yes! no")] == ["yes", "no", "yes"]
    assert get(T.matched_class(F.lit("a_trash_pile_b"), ["trash", "trash_pile"])) == "trash_pile"
    assert get(T.label_line(F.lit(1), F.lit(0.5), F.lit(0.25), F.lit(0.1), F.lit(0.2))) == "1 0.500000 0.250000 0.100000 0.200000"


def test_first_names_and_curves(spark, tmp_path):
    (tmp_path / "p.csv").write_text('prompt,class_name,class_id\n"b, one",zebra,0\n" a two ",apple,0\nc,x,1\n')
    got = {r["class_id"]: (r["name"], r["prompts"]) for r in B.prompts_by_class(B.prompts(spark, str(tmp_path / "p.csv"))).collect()}
    assert got == {0: ("zebra", ["b, one", "a two"]), 1: ("x", ["c"])}
    for name in B.METRICS:
        folder = tmp_path / f"run{len(name)}"
        folder.mkdir(exist_ok=True)
        (folder / "results.csv").write_text(f"epoch, {name}\n1, 0.25\n2, x\n")
        assert [(r["epoch"], r["metric"]) for r in B.training_curve(spark, str(folder)).orderBy("epoch").collect()] == [(1, 0.25), (2, None)]


def test_pooled_and_chosen(spark):
    a, b = spark.createDataFrame([(1, 0)], "image_id long, class_id int"), spark.createDataFrame([(2, 3)], "image_id long, class_id int")
    both = S.pooled(train=a, val=b)
    assert {tuple(r) for r in both.collect()} == {(1, 0, "train"), (2, 3, "val")}
    assert [r["image_id"] for r in L.of_classes(both, [3, 4]).collect()] == [2]
