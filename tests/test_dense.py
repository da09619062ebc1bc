"""Grids and rounds against folds and plain loops."""

from __future__ import annotations

import random

import pytest

from boxmill.operators import dense as N
from boxmill.operators import fusion as D

KIND = "image_id long, det_id long, class_id int, x1 double, y1 double, x2 double, y2 double, score double"


def boxes(n: int, seed: int, images: int = 2, extent: float = 300.0):
    """Boxes of many sizes, some alike, some without area, some across 0, and equal scores."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y, w, h = rng.uniform(-extent / 4, extent), rng.uniform(-extent / 4, extent), 2 ** rng.uniform(-2, 7), 2 ** rng.uniform(-2, 7)
        if out and rng.random() < 0.5:  # near another one
            _, _, _, a, b, c, d, _ = rng.choice(out)
            x, y, w, h = a + rng.uniform(-2, 2), b + rng.uniform(-2, 2), (c - a) * rng.uniform(0.6, 1.3), (d - b) * rng.uniform(0.6, 1.3)
        w = -1.0 if rng.random() < 0.03 else w
        out.append((rng.randrange(images), k, rng.randrange(2), x, y, x + w, y + h, rng.randrange(20) / 20))
    return [*out, (0, n, 0, 0.0, 0.0, 64.0, 64.0, 0.5), (0, n + 1, 0, 0.0, 0.0, 64.0, 64.0, 0.5), (0, n + 2, 0, 64.0, 0.0, 128.0, 64.0, 0.5)]


@pytest.fixture(scope="module")
def dets(spark):
    return spark.createDataFrame(boxes(400, 4), KIND).cache()


def found(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("same_class", [True, False])
def test_pairs(dets, threshold, same_class):
    got = found(N.named_pairs(dets, threshold, same_class=same_class), "image_id", "a", "b", "iou")
    assert got == found(D.iou_pairs(dets, threshold, same_class=same_class), "image_id", "a", "b", "iou") and got


def test_pairs_tried_grow_with_the_boxes(spark):
    """On an image that grows with its boxes, the pairs that meet stay in proportion to them."""
    tried = [N.met(d, d, 0.5).where("a.det_id < b.det_id").count() for d in (spark.createDataFrame(boxes(n, 1, 1, 40 * n**0.5), KIND) for n in (500, 2000))]
    assert tried[1] < 5 * tried[0] and tried[1] < 2000 * 1999 / 2 / 50


def test_suppression(dets):
    for kw in ({}, {"class_agnostic": True}, {"class_agnostic": True, "eps": 1e-6}):
        got = found(N.nms(dets, 0.4, **kw), *D.FIELDS)
        assert got == found(D.nms(dets, 0.4, **kw), *D.FIELDS) and 0 < len(got) < dets.count()


def test_a_chain_of_suppressions(spark):
    """Each box overlaps the next: every second one stays, one a round."""
    chain = spark.createDataFrame([(1, k, 0, 4.0 * k, 0.0, 4.0 * k + 10, 10.0, 1 - k / 10) for k in range(8)], KIND)
    assert found(N.nms(chain, 0.4), "det_id") == [(0,), (2,), (4,), (6,)] == found(D.nms(chain, 0.4), "det_id")
    assert found(N.nms(chain, 0.4, max_det=2), "det_id") == [(0,)]
    assert N.nms(chain.limit(0), 0.4).count() == 0


def test_clusters(dets):
    assert found(N.cluster(dets, 0.5), "image_id", "det_id", "cluster") == found(D.cluster(dets, 0.5), "image_id", "det_id", "cluster")
    assert N.cluster(dets.limit(0), 0.5).count() == 0


def test_fusion_and_crops(dets):
    a, b = (f.select("image_id", "class_id", "det_id", "n_boxes", "score") for f in (N.weighted_box_fusion(dets, 0.5, 0.2), D.weighted_box_fusion(dets, 0.5, 0.2)))
    assert found(a, *a.columns) == found(b, *b.columns)
    crops, full = dets.where("det_id % 2 = 0"), dets.where("det_id % 2 = 1")
    for high, low in ((0.85, 0.3), (0.6, 0.1)):
        assert found(N.smart_crop_filter(crops, full, high, low), "det_id") == found(D.smart_crop_filter(crops, full, high, low), "det_id")
    with pytest.raises(ValueError):
        N.met(dets, dets, 0.0)


def test_few_boxes_meet_in_one_cell_and_many_in_theirs(spark, monkeypatch):
    """Each box was exchanged once for each of its cells, also in images of a few boxes."""
    few = [(1, k, 0, 10.0 * k, 0.0, 10.0 * k + 15, 20.0, 0.5) for k in range(6)]
    many = [(2, k, 0, 10.0 * k, 0.0, 10.0 * k + 15, 20.0, 0.5) for k in range(9)]
    d = spark.createDataFrame(few + many, "image_id long, det_id long, class_id int, x1 double, y1 double, x2 double, y2 double, score double")
    monkeypatch.setattr(N, "FEW", 8)
    crowded = d.groupBy("image_id").count().where("count > 8").select("image_id")
    rows = {r["image_id"]: r["count"] for r in N._celled(d, 0.1, ["image_id", "class_id"], crowded).groupBy("image_id").count().collect()}
    assert rows[1] == 6 and rows[2] > 9
    pairs = {tuple(r) for r in N.named_pairs(d, 0.1).select("image_id", "a", "b").collect()}
    assert pairs == {(i, k, k + 1) for i, n in ((1, 6), (2, 9)) for k in range(n - 1)}
