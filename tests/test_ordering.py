"""Ranks and running sums over tables with null groups, and how often inputs run."""

from __future__ import annotations

import pytest

from boxmill.operators import labels as L
from boxmill.operators import ordering as O
from boxmill.operators import probing as Q
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, None if k % 3 == 0 else f"g{k % 3}", k % 5) for k in range(60)], "id long, grp string, n int").repartition(4)


def test_null_groups_are_ranked(rows):
    for out in (O.hash_rank(rows, 1, ["id"], "place", ["grp"], "of"), O.range_rank(rows.withColumn("of", F.lit(20)), ["id"], "place", ["grp"])):
        found = out.collect()
        for g in (None, "g1", "g2"):
            assert sorted(r["place"] for r in found if r["grp"] == g) == list(range(1, 21))
        assert {r["of"] for r in found} == {20}


def test_running_sums_of_null_groups(rows):
    out = O.hash_running(rows, 1, ["id"], F.col("n"), "upto", ["grp"], "of").collect()
    assert len(out) == 60 and all(max(r["upto"] for r in out if r["grp"] == g) == sum(r["n"] for r in out if r["grp"] == g) for g in (None, "g1", "g2"))


def test_a_plan_counts_no_side_beforehand(spark):
    """Building a question set runs no job; the plan runs when it is asked for its rows."""
    gold = spark.createDataFrame([(k % 5, k % 3) for k in range(15)], "image_id long, class_id int")
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    Q.class_frequency(gold)
    L.quota_split(gold.select("image_id").distinct(), gold)
    assert not status.getJobIdsForGroup("plan")
    spark.sparkContext.setJobGroup("", "")
