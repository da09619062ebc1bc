"""Connected components of a link table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _with_least(edges: DataFrame) -> DataFrame:
    """edges without repeats, with the smallest b of each a as m; one exchange serves the repeats, the minima and their join.

    changed is true if it is for any edge of a. Both sides of the join use the same columns, so that they share the exchange.
    """
    once = edges.repartition("a").groupBy("a", "b").agg(F.max("changed").alias("changed"))
    least = once.groupBy("a").agg(F.min("b").alias("m"), F.max("changed").alias("any"))
    return once.join(least, "a").withColumn("changed", F.col("changed") | F.col("any")).drop("any")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node of its neighbourhood."""
    # named for both sides of the join: a filter that only one of them infers would part their exchanges
    both = edges.where("a is not null and b is not null").select("a", "b", F.lit(False).alias("changed"))
    near = _with_least(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "changed")))
    # b is at least m; with m in it, the filter stays behind the join, and its two sides read one exchange
    return near.where(F.greatest("b", "m") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"), (F.col("m") < F.col("a")).alias("changed"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them; rows are (larger, smaller)."""
    near = _with_least(edges)
    moved = F.col("b") > F.col("m")
    return near.select(F.when(moved, F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"), (moved | F.col("changed")).alias("changed"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node it can reach.

    Repeated links, both directions and loops are allowed; null ends are left
    out; without links the result is empty. Minima are aggregated and joined
    back, so no neighbourhood is ever held in one row. Each round is two exchanges,
    written to the shared folder; rounds end when one has changed no link. A round
    never has more rows than the one before, so repeats wait for the next exchange.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct()
    edges = cut(edges, "links")
    while not edges.isEmpty():
        edges = cut(_small_star(_large_star(edges)), "stars")
        if edges.where("changed").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
