"""What larger tables bring: ids that meet, and many rows in one place."""

from __future__ import annotations

import time

import pytest

from boxmill.operators import labels as L
from boxmill.operators import lineage
from boxmill.operators import validation as V
from boxmill.plans import registry, streams
from boxmill.plans.base import Views
from boxmill.streaming import monitor as M
from pyspark.sql import functions as F


@pytest.fixture
def crowded(spark, tmp_path):
    """Two images, of which the first has 20 boxes: its last ids are those of the second one's first."""
    spark.range(2).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    rows = spark.createDataFrame([(0, k) for k in range(1, 21)] + [(1, k) for k in range(1, 6)], "l_orderkey long, l_linenumber int")
    rows = rows.selectExpr("*", "1L AS l_partkey", "1L AS l_suppkey", "1D AS l_quantity", "1D AS l_extendedprice", "'N' AS l_returnflag")
    rows.withColumn("l_linenumber", F.lit(3)).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_newest_answers_of_images_that_share_ids(spark, crowded):
    assert registry.QUERIES["newest_of_appended"](spark, crowded).count() == 25


def test_resumed_answers_of_images_that_share_ids(spark, crowded):
    assert registry.QUERIES["stream_resumed_answers"](spark, crowded).count() == 25


def test_answers_of_a_table_of_many_files_come_in_few_batches(spark, crowded, monkeypatch):
    """Two files a batch made batches, each of which reads the keys of all answers, as many as the table is large."""
    runs, staged, answers = [], streams.staged, streams.answer_stream
    monkeypatch.setattr(streams, "staged", lambda df: staged(df.repartition(20)))
    monkeypatch.setattr(streams, "answer_stream", lambda *args: runs.append(answers(*args)) or runs[-1])
    assert registry.QUERIES["stream_resumed_answers"](spark, crowded).count() == 25
    assert [len({p["batchId"] for p in q.recentProgress}) for q in runs] == [2, 2]


def test_a_bin_of_very_many_rows(spark):
    """Envelopes looked at all later rows of a bin for each row: 120,000 rows took minutes."""
    n = 120_000
    rows = spark.range(n).selectExpr("id AS image_id", "0 AS class_id", "0.5D AS threshold", "id AS det_id", "0.5D AS score", "id % 7 < 3 AS tp")
    gold = spark.range(n).selectExpr("0 AS class_id")
    began = time.perf_counter()
    out = V.precision_recall(rows, gold).orderBy("det_id").toPandas()
    assert time.perf_counter() - began < 60
    want = (rows.toPandas()["tp"].cumsum() / range(1, n + 1))
    assert (out["precision"] - want).abs().max() < 1e-12
    assert (out["envelope"] - want[::-1].cummax()[::-1]).abs().max() < 1e-12


def test_all_thresholds_in_one_row_give_the_averages_of_the_curves(spark):
    def boxes(number, shift, n):
        return spark.range(n).selectExpr("id % 40 AS image_id", "cast(id % 3 AS int) AS class_id", f"id AS {number}", f"cast(id % 5 * 50 + {shift} AS double) AS x1", "0D AS y1", f"cast(id % 5 * 50 + {shift} + 40 AS double) AS x2", "40D AS y2")

    gold, dets = boxes("gt_no", "0", 600), boxes("det_id", "id % 23", 900).withColumn("score", F.col("det_id") * 37 % 101 / 101)
    key = lambda r: (r["class_id"], r["threshold"])
    one = sorted(V.average_precisions(dets, gold, [0.5, 0.75]).collect(), key=key)
    two = sorted(V.average_precision(V.precision_recall(V.judged(dets, gold, [0.5, 0.75]), gold), gold).collect(), key=key)
    assert [r[c] for r in one for c in ("class_id", "threshold", "ap", "precision", "recall")] == pytest.approx([r[c] for r in two for c in ("class_id", "threshold", "ap", "precision", "recall")])
    assert len(one) == 6 and any(0 < r["ap"] < 1 for r in one)


def test_detections_are_judged_once_for_all_thresholds(spark):
    """Each read of the bins judged all detections again, each threshold in a fold of its own, which took twice the time for each threshold."""
    boxes = "id % 40 AS image_id, cast(id % 3 AS int) AS class_id, id AS {}, cast(id % 7 * 3 AS double) AS x1, 0D AS y1, cast(id % 7 * 3 + 40 AS double) AS x2, cast(30 + id % 5 AS double) AS y2"
    gold, dets = spark.range(600).selectExpr(*boxes.format("gt_no").split(", ")), spark.range(900).selectExpr(*boxes.format("det_id").split(", "), "id * 37 % 101 / 101D AS score")
    thresholds = [k / 70 for k in range(69, -1, -1)]  # more than the bits of an integer

    def shares(a, b):
        shared = max(min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), 0) * max(min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]), 0)
        return shared / ((a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - shared)

    groups, want = {}, {}
    for g in gold.collect():
        groups.setdefault((g["image_id"], g["class_id"]), []).append(g)
    used = {t: set() for t in thresholds}
    for d in sorted(dets.collect(), key=lambda d: (-d["score"], d["det_id"])):
        near = sorted((-shares(d, g), g["gt_no"]) for g in groups.get((d["image_id"], d["class_id"]), []))
        best = {t: next(((-o, n) for o, n in near if n not in used[t]), (-1, None)) for t in thresholds}
        want[d["det_id"]] = [best[t][0] >= t for t in thresholds]
        for t in thresholds:
            used[t] |= {best[t][1]} if best[t][0] >= t else set()
    assert {r["det_id"]: r["tp"] for r in V.judged_at(dets, gold, thresholds).collect()} == want

    out = V.average_precisions(dets, gold, [0.5, 0.75, 0.9])
    assert out.count() and len(out.collect()) == 9
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("posexplode(d") == 1


def test_a_run_calls_its_state_a_few_times_however_many_its_epochs():
    """Each epoch had three calls and a timer of its own."""
    calls = []

    class Kept:
        value = None

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                if name in ("appendList", "put", "update"):
                    self.value = [*(self.value or []), *given[0]] if name == "appendList" else given[0]
                if name == "clear":
                    self.value = None
                return iter(self.value or []) if name == "get" and self.listed else self.value

            return call

    class Handle(Kept):
        def getListState(self, *_):  # noqa: N802
            kept = Kept()
            kept.listed = True
            return kept

        def getValueState(self, *_):  # noqa: N802
            kept = Kept()
            kept.listed = False
            return kept

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 10_000

    m = M.RunMonitor(1 << 60, 3)
    m.init(Handle())
    m.handleInputRows((1,), ({"at": k * 1000, "epoch": k, "metric": 0.5} for k in range(500)), None)
    assert len(list(m.handleExpiredTimer((1,), Now(), None))) == 500
    assert len(calls) < 10


def test_a_line_is_split_once_whatever_stands_behind(spark):
    """Filters and joins on parsed columns split each line again."""
    lines = spark.createDataFrame([(1, 1, " 0 0.5 0.5 0.1 0.1 "), (1, 2, "x 0.5 0.5 0.1 0.1"), (2, 1, "1 0.5"), (2, 2, " "), (3, 1, None)], "image_id long, line_no int, line string")
    boxes = L.gold_boxes(lines, spark.createDataFrame([(0, "a"), (1, "b")], "class_id int, name string"))
    assert boxes._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r["image_id"] for r in boxes.collect()] == [1]
    counted = L.parse_lines(lines, mode="count").orderBy("image_id", "line_no").select("n_tokens", "class_id", "ok").collect()
    assert [tuple(r) for r in counted] == [(5, 0, True), (5, None, False), (2, 1, False)]


def test_lines_are_parsed_in_one_place_of_a_split(spark, crowded, monkeypatch):
    """The report of a split parsed all lines three times."""
    seen = []
    monkeypatch.setattr(L, "instances", lambda parsed, real=L.instances: seen.append(1) or real(parsed))
    registry.QUERIES["split_quota_report"](spark, crowded).collect()
    assert len(seen) == 1


def shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {b for b in held.split() if b.startswith("shuffle_")}


def test_cut_tables_leave_no_shuffle_files(spark):
    """Every round of near-dedup left its shuffles on disk until the driver's memory was cleared."""
    before = shuffle_files(spark)
    table = lineage.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert shuffle_files(spark) <= before
    assert table.count() == 7 and spark.conf.get(lineage.CLEANUP) == "false"


def test_tables_cut_on_the_way_are_deleted(spark):
    way = []
    out = lineage.cut_alone(lambda: way.append(lineage.cut(spark.range(5), "first")) or way[0].where("id > 1"), "second")
    assert out.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(way[0].inputFiles()[0]).count()


def test_a_table_without_its_large_columns_replaces_the_first(spark):
    first = lineage.cut(spark.range(5).selectExpr("id", "id AS large"), "first")
    at = first.inputFiles()[0]
    out = lineage.dropped(first, "large")
    assert out.columns == ["id"] and out.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(at).count()


def test_questions_read_their_gold_boxes_once(spark):
    """Gold boxes, behind a window over all of them, were made again for every place that asked for them."""
    from boxmill.operators import probing as P

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    images = spark.range(40).selectExpr("id AS image_id")
    gold = spark.range(120).selectExpr("id % 30 AS image_id", "cast(id % 4 AS int) AS class_id").mapInPandas(counted, "image_id long, class_id int")
    classes = spark.range(6).selectExpr("cast(id AS int) AS class_id", "concat('c', id) AS name")
    rows = P.build_questions(images, gold, classes, list(range(6))).collect()
    assert made.value == 120 and len({(r["tier"], r["question_id"]) for r in rows}) == len(rows) > 0


def test_methods_are_compared_on_detections_made_once(spark):
    """Each method made the detections anew, behind a window over all boxes, and exchanged them."""
    from boxmill.operators import fusion as D

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    dets = spark.range(200).selectExpr("id % 20 AS image_id", "id AS det_id", "cast(id % 3 AS int) AS class_id", "id * 7D AS x1", "0D AS y1", "id * 7D + 30 AS x2", "9D AS y2", "(id + 1) / 201D AS score")
    out = D.compare_methods(dets.mapInPandas(counted, dets.schema)).collect()
    assert made.value == 200
    assert {r["method"]: r["n"] for r in out} == {m: f(dets).count() for m, f in D.METHODS.items()}


def test_a_table_of_many_files_is_replayed_in_few_batches(spark, tmp_path, monkeypatch):
    """Two files a batch made batches, each of which looks at the whole state, as many as the table is large."""
    path, schema = str(tmp_path / "in"), "question_id long, model string, tier string"
    spark.range(0, 60, 1, 30).selectExpr("id % 45 AS question_id", "'m' AS model", "'t' AS tier").write.parquet(path)
    seen = []
    monkeypatch.setattr(streams, "stream", lambda spark, path, schema, n: seen.append(n))
    streams.replayed(Views(spark, ""), path, schema)
    assert -(-30 // seen[0]) <= streams.REPLAYED
