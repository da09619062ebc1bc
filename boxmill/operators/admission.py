"""Greedy splits of whole tables: admission of images under class quotas, in rounds.

The rule is sequential: in hash order an image goes to the first split in which
none of its classes passes its target. Every round bounds what an image would find:
at least what was admitted before it, at most that and all that are open before
it. An image whose upper bounds fit is admitted, one with a lower bound too large
goes on to the next split, and the others wait for a round with closer bounds. The
first open image has equal bounds, so each round decides some, and the result is
that of the sequential rule on the whole table.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_order
from .lineage import cut
from .ordering import running_sums

log = logging.getLogger(__name__)


def quotas(counts: DataFrame, ratios: tuple[float, ...]) -> DataFrame:
    """(class_id, q0, q1, ..): whole shares of a class's boxes for each split, the last one the remainder."""
    total = counts.groupBy("class_id").agg(F.sum("n").alias("_total"))
    shares = [F.floor(F.col("_total") * F.lit(r)) for r in ratios[:-1]]
    rest = F.col("_total")
    for s in shares:
        rest = rest - s
    return total.select("class_id", *[c.cast("long").alias(f"q{k}") for k, c in enumerate([*shares, rest])])


def _round(rows: DataFrame, splits: int) -> DataFrame:
    """rows, a row an image and class, after one round: what was admitted before added to b0.., and stage and taken decided.

    Rows with `taken` were admitted by the round before and leave here. The others have
    it set if they are admitted now; a stage of `splits` fits nowhere. One row of each image has `lead`.
    """
    own = lambda prefix: F.element_at(F.array(*[F.col(f"{prefix}{s}") for s in range(splits)]), F.col("stage") + 1)
    amounts: dict[str, Column] = {f"a{s}": F.when(F.col("taken") & (F.col("stage") == s), F.col("n")).otherwise(0) for s in range(splits)}
    amounts |= {f"u{s}": F.when(~F.col("taken") & (F.col("stage") <= s), F.col("n")).otherwise(0) for s in range(splits)}
    summed = running_sums(rows, amounts, ["_h", "image_id"], "_bucket", ["class_id"]).where(~F.col("taken"))
    summed = summed.withColumns({f"b{s}": F.col(f"b{s}") + F.col(f"a{s}") for s in range(splits)})
    low, high, quota = own("b") + F.col("n"), own("b") + own("u"), own("q")
    kept = ["class_id", "n", *[f"{c}{s}" for s in range(splits) for c in "qb"]]
    image = summed.groupBy("image_id", "_h", "_bucket", "stage").agg(
        F.bool_and(high <= quota).alias("taken"), F.bool_or(low > quota).alias("_never"), F.collect_list(F.struct(*kept)).alias("_rows"),
    )
    image = image.withColumn("stage", F.col("stage") + F.col("_never").cast("int"))
    return image.select("image_id", "_h", "_bucket", "stage", "taken", F.inline(F.transform("_rows", lambda x, i: x.withField("lead", i == 0))))


def greedy_split(counts: DataFrame, names: tuple[str, ...], ratios: tuple[float, ...], seed: int) -> DataFrame:
    """(image_id, split, fits) for counts of image_id, class_id, n > 0, by the sequential rule on the whole table.

    Images that fit nowhere have fits = false and the first split. A null image is
    one image, a null class one class; a row an image and class is expected. Equal
    hashes go by image. An empty table gives an empty result. A round is one exchange
    by class and range of hashes and one by image; what is decided leaves, so rounds
    get small soon. Their number follows how often a class with little room left
    waits for another, not the rows.
    """
    splits = len(names)
    hashed = counts.withColumn("_h", hash_order(seed, F.col("image_id"))).withColumn("_bucket", F.substring("_h", 1, 3))
    targets = quotas(counts, ratios)
    same = F.col("class_id").eqNullSafe(F.col("_class"))
    rows = hashed.join(targets.withColumnRenamed("class_id", "_class"), same).drop("_class")
    rows = rows.withColumns({"stage": F.lit(0), "taken": F.lit(False), **{f"b{s}": F.lit(0).cast("long") for s in range(splits)}})
    of = F.element_at(F.lit(list(names)), F.col("stage") + 1)
    done = None
    rounds = 0
    while True:
        rows = cut(_round(rows, splits), "admission")
        rounds += 1
        settled = rows.where(F.col("lead") & (F.col("taken") | (F.col("stage") == splits)))
        settled = settled.select("image_id", F.when(F.col("taken"), of).otherwise(names[0]).alias("split"), F.col("taken").alias("fits"))
        done = settled if done is None else done.unionByName(settled)
        rows = rows.where(F.col("stage") < splits)
        if rows.where(~F.col("taken")).isEmpty():
            break
    log.info("greedy split: %d rounds", rounds)
    return done
