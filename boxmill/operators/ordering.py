"""Ranks and running sums over whole tables, without one task holding all rows.

Rows are ordered inside buckets of their order; what lies in the buckets before
is added from the buckets' totals, which are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_order
from .lineage import cut

#: Hexadecimal digits of a hash that make a bucket: 4096 of them.
DIGITS = 3


def _beside(rows: DataFrame, sums: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """rows with the sums of their group and bucket; null groups are groups."""
    named = sums.withColumnsRenamed({c: f"_of_{c}" for c in (*by, bucket)})
    same = F.col(bucket) == F.col(f"_of_{bucket}")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(named, same).drop(*[f"_of_{c}" for c in (*by, bucket)])


def hash_running(df: DataFrame, seed: int, key: list[str], amount: Column, to: str, by: list[str] | None = None, all_to: str | None = None) -> DataFrame:
    """df with `to`: the sum of amount over the rows with the same `by` up to this one, by md5(seed:key), then key.

    all_to: a column for the sum over all rows with the same `by`.
    """
    by = by or []
    h = df.withColumns({"_h": hash_order(seed, *[F.col(k) for k in key]), "_a": amount})
    h = h.withColumn("_b", F.substring("_h", 1, DIGITS))
    group = Window.partitionBy(*by)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = h.groupBy(*by, "_b").agg(F.sum("_a").alias("_n"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(group)}).drop("_n")
    inside = F.sum("_a").over(Window.partitionBy(*by, "_b").orderBy("_h", *key).rowsBetween(Window.unboundedPreceding, 0))
    out = _beside(h, sums, by, "_b").withColumn(to, (inside + F.col("_before")).cast("long"))
    out = out.withColumn(all_to, F.col("_all")) if all_to else out
    return out.drop("_h", "_b", "_a", "_before", "_all")


def running_sums(df: DataFrame, amounts: dict[str, Column], order: list[str], bucket: str, by: list[str]) -> DataFrame:
    """df with a column for each amount: its sum over the rows with the same `by` up to this one, in the order of bucket, then order.

    bucket is a column of few values that order never contradicts, such as the
    first digits of a hash; the sums of buckets are all that meets in one place.
    """
    named = {f"_n_{k}": v for k, v in amounts.items()}
    rows = df.withColumns(named)
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, bucket).agg(*[F.sum(n).alias(n) for n in named])
    sums = sums.select(*by, bucket, *[F.coalesce(F.sum(f"_n_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in amounts])
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({k: F.sum(f"_n_{k}").over(inside) for k in amounts})
    out = _beside(rows, sums, by, bucket)
    return out.withColumns({k: (F.col(k) + F.col(f"_before_{k}")).cast("long") for k in amounts}).drop(*named, *[f"_before_{k}" for k in amounts])


def hash_rank(df: DataFrame, seed: int, key: list[str], to: str, by: list[str] | None = None, all_to: str | None = None) -> DataFrame:
    """df with `to`: the place, from 1, in hash order among the rows with the same `by`; all_to: how many these are."""
    return hash_running(df, seed, key, F.lit(1), to, by, all_to)


def range_rank(df: DataFrame, order: list[str], to: str, by: list[str]) -> DataFrame:
    """df with `to`: the place, from 1, in the order of columns among the rows with the same `by`.

    The table is exchanged into ranges once and written, so that the ranges stay
    the same while their counts are added up.
    """
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("_r", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*by, "_r").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_r").orderBy(*order))
    return _beside(ranged, counts, by, "_r").withColumn(to, (inside + F.col("_before")).cast("long")).drop("_r", "_before")


def hash_rank_once(df: DataFrame, seed: int, key: list[str], to: str, by: list[str]) -> DataFrame:
    """hash_rank for rows that are dear to make: df runs once, and its rows are written."""
    h = df.withColumn("_h", hash_order(seed, *[F.col(k) for k in key])).withColumn("_b", F.substring("_h", 1, DIGITS))
    return bucket_rank(h, ["_h", *key], "_b", to, by, spare=("_h",))


def bucket_rank(df: DataFrame, order: list[str], bucket: str, to: str, by: list[str], spare: tuple[str, ...] = ()) -> DataFrame:
    """df without bucket and with `to`: the place, from 1, in the order of bucket, then order, among the rows with the same `by`.

    bucket is a column that order never contradicts, so no ranges are looked for,
    which would run df twice; df runs once, and its rows are written with their
    places inside the buckets, without the columns of spare.
    """
    inside = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order))
    rows = cut(df.withColumn("_in", inside).drop(*spare), "bucketed")
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, bucket).agg(F.max("_in").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return _beside(rows, F.broadcast(counts), by, bucket).withColumn(to, (F.col("_in") + F.col("_before")).cast("long")).drop("_in", "_before", bucket)


def first_by_hash(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """A reproducible random sample of n rows."""
    return df.orderBy(hash_order(seed, *[F.col(k) for k in key]), *key).limit(n)
