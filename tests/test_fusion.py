"""Fusion rules on boxes worked out by hand, and against plain loops."""

from __future__ import annotations

import random

import pytest

from boxmill.operators import fusion as D

SCHEMA = "image_id long, det_id int, class_id int, x1 double, y1 double, x2 double, y2 double, score double"


def dets(spark, rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], SCHEMA)


def ids(df):
    return sorted(r["det_id"] for r in df.collect())


def box(x, cls=0, score=0.5, y=0.0, side=10.0):
    return (cls, float(x), float(y), float(x) + side, float(y) + side, float(score))


def iou(a, b):
    w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
    i = max(w, 0) * max(h, 0)
    u = (a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - i
    return i / u if u > 0 else 0.0


def test_nms_is_strict_at_the_threshold(spark):
    rows = [box(0, score=0.9), box(0, score=0.8, side=10), box(5, score=0.7)]
    assert ids(D.nms(dets(spark, rows), 1.0)) == [0, 1, 2]  # IoU 1 is not over 1
    assert ids(D.nms(dets(spark, rows), 0.5)) == [0, 2]


def test_nms_ties_keep_the_lower_id(spark):
    assert ids(D.nms(dets(spark, [box(0), box(1)]), 0.5)) == [0]


def test_chains_join_one_cluster(spark):
    rows = [box(0, score=0.9), box(6, score=0.1), box(3, score=0.5)]  # ends overlap the middle only
    c = {r["det_id"]: r["cluster"] for r in D.cluster(dets(spark, rows), 0.5).collect()}
    assert c == {0: 0, 1: 0, 2: 0}


def test_fused_box_is_weighted(spark):
    (r,) = D.weighted_box_fusion(dets(spark, [box(0, score=0.75), box(2, score=0.25)]), 0.5).collect()
    assert (r["x1"], r["x2"], r["score"], r["n_boxes"]) == (0.5, 10.5, 0.75, 2)


def test_zero_scores_fuse_to_null(spark):
    (r,) = D.weighted_box_fusion(dets(spark, [box(0, score=0.0)]), 0.5).collect()
    assert r["x1"] is None


def test_strong_generic_gives_way_to_weak_specific(spark):
    assert ids(D.deduplicate(dets(spark, [box(0, 5, 0.9), box(1, 2, 0.3)]), 0.5, 5)) == [1]


def test_what_a_losing_generic_dropped_stays_dropped(spark):
    rows = [box(0, 5, 0.9), box(1, 5, 0.8), box(2, 2, 0.3)]
    assert ids(D.deduplicate(dets(spark, rows), 0.5, 5)) == [2]


def test_deduplicate_without_priority_or_work(spark):
    rows = [box(0, 5, 0.9), box(1, 2, 0.3)]
    assert ids(D.deduplicate(dets(spark, rows), 0.5, 5, prioritize=False)) == [0]
    assert ids(D.deduplicate(dets(spark, rows), 0.5, 5, keep_all=True)) == [0, 1]


def test_second_best_if_the_best_is_generic(spark):
    rows = [box(0, 2, 0.6), box(1, 5, 0.9), box(2, 3, 0.2)]
    assert ids(D.confidence_filter(dets(spark, rows), 0.5, 5)) == [0]
    rows = [box(0, 2, 0.4), box(1, 5, 0.9)]
    assert ids(D.confidence_filter(dets(spark, rows), 0.5, 5)) == [1]


@pytest.mark.parametrize("seed", range(3))
def test_deduplicate_equals_a_loop(spark, seed):
    r = random.Random(seed)
    rows = [box(r.randint(0, 30), r.choice([1, 2, 5]), r.random(), r.randint(0, 10)) for _ in range(25)]
    order = sorted(range(len(rows)), key=lambda k: (-rows[k][5], k))
    live, kept = dict.fromkeys(order, True), []
    for n, i in enumerate(order):
        if not live[i]:
            continue
        for j in order[n + 1 :]:
            if live[j] and iou(rows[i], rows[j]) >= 0.3:
                if rows[i][0] == 5 and rows[j][0] != 5:
                    live[i] = False
                    break
                live[j] = False
        if live[i]:
            kept.append(i)
    assert ids(D.deduplicate(dets(spark, rows), 0.3, 5)) == sorted(kept)


def test_empty_input(spark):
    none = dets(spark, [])
    for out in (D.nms(none, 0.5), D.weighted_box_fusion(none, 0.5), D.deduplicate(none, 0.5, 5), D.confidence_filter(none, 0.5, 5)):
        assert out.count() == 0


def test_methods_by_name(spark):
    assert D.method("tiled")(dets(spark, [box(0)])).count() == 1
    with pytest.raises(KeyError, match="tiled"):
        D.method("none")


def test_odd_tile_numbers_are_refused(spark):
    images = spark.createDataFrame([(1, 100, 50)], "image_id long, width int, height int")
    with pytest.raises(ValueError, match="even"):
        D.tile_grid(images, 3, 0.2)
    assert D.tile_grid(images, 4, 0.0).count() == 4
