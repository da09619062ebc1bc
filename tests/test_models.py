"""User models, placement invariants and streams with late and repeated files."""

from __future__ import annotations

import math
import time

import pytest

from boxmill.operators import placement as P
from boxmill.operators import probing as Q
from boxmill.operators import regions as R
from boxmill.operators import scoring as X
from boxmill.streaming import answers as A
from boxmill.streaming import monitor as M
from pyspark.sql import functions as F


def test_answers_and_timeouts(spark):
    q = spark.createDataFrame([(1, "a.jpg", "fast"), (2, "b.jpg", "slow")], "question_id long, image string, text string")

    def load():
        import time

        return lambda image, text: (time.sleep(0.3 if text == "slow" else 0), f" yes {image} ")[1]

    out = {r["question_id"]: r["response"] for r in X.answered(q, "stub", load, limit_s=0.2).collect()}
    assert out == {1: "yes a.jpg", 2: "TIMEOUT"}


def test_a_hanging_model_is_replaced(spark):
    q = spark.createDataFrame([(k, str(k), "hang" if k in (2, 3) else "ok") for k in range(6)], "question_id long, image string, text string").coalesce(1)

    def load():
        import os
        import time

        return lambda image, text: time.sleep(600) if text == "hang" else f"{os.getpid()}"

    out = {r["question_id"]: r for r in X.answered(q, "hangs", load, limit_s=0.5, rows=2).collect()}
    assert [k for k, r in out.items() if r["response"] == "TIMEOUT"] == [2, 3] and max(r["inference_s"] for r in out.values()) < 60
    assert out[0]["response"] == out[1]["response"] != out[4]["response"] == out[5]["response"]


def test_hanging_answers_are_waited_for_together(spark, tmp_path):
    """Each hanging answer held up its worker for the whole limit."""
    texts = ["hang" if k % 10 == 3 else "late" if k == 15 else "ok" for k in range(100)]
    q = spark.createDataFrame([(k, str(k), t) for k, t in enumerate(texts)], "question_id long, image string, text string").coalesce(1)
    log = str(tmp_path / "asked")

    def load():
        import time

        def answer(image, text):
            with open(log, "a") as f:
                f.write(f"{image}\n")
            time.sleep({"hang": 600, "late": 1, "ok": 0}[text])
            return image

        return answer

    began = time.monotonic()
    out = {r["question_id"]: r["response"] for r in X.answered(q, "together", load, limit_s=4.0, rows=30, waiting=20).collect()}
    assert time.monotonic() - began < 30
    assert out == {k: "TIMEOUT" if t == "hang" else str(k) for k, t in enumerate(texts)}
    assert sorted(map(int, open(log).read().split())) == list(range(100))


def test_a_failing_model_fails_the_job(spark):
    q = spark.createDataFrame([(1, "a", "b")], "question_id long, image string, text string")

    def load():
        return lambda image, text: 1 / 0

    with pytest.raises(Exception, match="ZeroDivisionError"):
        X.answered(q, "fails", load).collect()


def test_detections_in_batches(spark):
    def load():
        import numpy as np

        def predict(image_id, tile):
            out = np.full((len(tile), 3, 6), np.nan)
            for row, t in enumerate(tile):
                for k in range(t):
                    out[row, k] = [k, 0.0, 0.0, image_id[row], 1.0, 0.5]
            return out

        return predict

    tiles = spark.createDataFrame([(i, t) for i in range(5) for t in range(4)], "image_id long, tile int").repartition(3)
    got = sorted((r["image_id"], r["tile"], r["det_id"], r["class_id"], r["x2"]) for r in X.detected_in_batches(tiles, load, batch_size=3).collect())
    assert got == [(i, t, k, k, float(i)) for i in range(5) for t in range(4) for k in range(t)]
    assert X.detected_in_batches(tiles.limit(0), load).count() == 0


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("part"), F.lit("m").alias("model"), F.when(F.col("id") % 10 > 0, F.col("id").cast("double")).alias("inference_s"))
    merged = Q.sketched_quantiles(Q.merged_sketches(Q.latency_sketches(rows, ["model", "part"]), ["model"]), p10=0.1, p50=0.5, p99=0.99).first()
    assert merged["n"] == 27_000
    for name, rank in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
        assert abs(rows.where(F.col("inference_s") <= merged[name]).count() / 27_000 - rank) <= Q.RANK_ERROR
    assert Q.latency_sketches(rows.limit(0), ["model"]).count() == 0


def test_detections(spark):
    tiles = spark.createDataFrame([(1, 0), (1, 1)], "image_id long, tile int")
    out = X.detected(tiles, "stub2", lambda: lambda i, t: [(3, 0.0, 0.0, 1.0, 1.0, 0.5)] * t)
    assert [(r["tile"], r["det_id"], r["class_id"]) for r in out.collect()] == [(1, 0, 3)]


def test_places_are_far_apart_and_inside(spark):
    mask = spark.range(400).select(F.lit(1).cast("long").alias("image_id"), (F.col("id") % 20).cast("int").alias("x"), F.floor(F.col("id") / 20).cast("int").alias("y")).withColumn("v", F.when(F.col("x") < 15, 255).otherwise(0))
    out = P.find_positions(mask, 5, {0: (2, 4, 2, 4)}, width=20, height=20, min_dist=4, margin=1).collect()
    assert len(out) == 5
    assert all(math.hypot(a["x"] - b["x"], a["y"] - b["y"]) >= 4 for a in out for b in out if a["pos"] < b["pos"])
    assert all(1 <= r["x"] <= 13 for r in out)
    again = P.find_positions(mask, 5, {0: (2, 4, 2, 4)}, width=20, height=20, min_dist=4, margin=1).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_long_component(spark):
    snake = [(1, x, y) for y in range(0, 40, 2) for x in range(20)] + [(1, 19 if (y // 2) % 2 == 0 else 0, y + 1) for y in range(0, 38, 2)]
    pixels = spark.createDataFrame(snake, "image_id long, x int, y int")
    assert R.component_areas(R.pixel_components(pixels)).collect()[0]["area"] == len(snake)


def test_resumed_stream_adds_nothing_twice(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").cast("int").alias("question_id"), F.lit("m").alias("model"), F.lit("random").alias("tier"))
    rows.write.parquet(str(tmp_path / "in"))
    schema = "question_id int, model string, tier string"
    for run in ("a", "b"):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        A.answer_stream(A.stream(spark, str(tmp_path / "in"), schema), lambda d: d.withColumn("response", F.lit("yes")), str(tmp_path / "out"), str(tmp_path / run)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_silent_runs_end_and_late_epochs_go(spark, tmp_path):
    """Batches out of order, epochs at the watermark, repeated rows, a run that falls silent and one that comes back."""
    schema = "run long, epoch int, map5095 double, at timestamp"

    def after(rows):
        d = spark.createDataFrame(rows, "run long, epoch int, map5095 double, s long").selectExpr("run", "epoch", "map5095", "timestamp_seconds(s) AS at")
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with M.keyed_state(spark):
            epochs = A.stream(spark, str(tmp_path / "in"), schema)
            A.append_stream(M.run_monitor(epochs, "at", delay_s=100, idle_s=1000, patience=2), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
        out = spark.read.parquet(str(tmp_path / "out")).selectExpr("run", "unix_seconds(at)", "epoch", "best", "improved", "since", "status")
        return sorted(map(tuple, out.collect()), key=lambda r: (r[0] or 0, r[1], r[6] == "idle", r[5]))

    first = [(1, 10, 1, 0.5, True, 0, "epoch"), (1, 70, 2, 0.5, False, 1, "epoch")]
    assert after([(1, 2, 0.4, 70), (1, 1, 0.5, 10), (None, 1, 0.3, 30), (2, 1, 0.1, 180), (1, 4, None, 20), (1, 5, math.nan, 20), (1, None, 0.9, 20), (1, 6, 0.9, None)]) == [(None, 30, 1, 0.3, True, 0, "epoch"), *first[:1], *first[1:]]
    second = [*first, (1, 110, 3, 0.5, False, 2, "stop"), (1, 110, 3, 0.5, False, 3, "epoch")]
    assert after([(1, 3, 0.5, 110), (1, 3, 0.5, 110), (1, 9, 0.9, 60), (2, 2, 0.2, 300)])[1:] == [*second, (2, 180, 1, 0.1, True, 0, "epoch")]
    third = after([(1, 4, 0.2, 1300), (3, 1, 0.1, 1401)])
    assert [r for r in third if r[0] == 1] == [*second, (1, 110, 3, 0.5, False, 3, "idle"), (1, 1300, 4, 0.2, True, 0, "epoch")]
    assert [(r[0], r[6]) for r in third if r[6] == "idle"] == [(None, "idle"), (1, "idle"), (2, "idle")]
