"""Yes/no probing: question sets, answer metrics, comparisons.

Answers are rows: question_id, model, tier, image_id, cls, label, response,
inference_s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TIMEOUT, predicted, question, strict_answer, trimmed
from .labels import absent_classes, class_frequency, cooccurrence
from .lineage import cut
from .ordering import first_by_hash, hash_rank_once

TIERS = ("random", "popular", "adversarial")


def negatives(images: DataFrame, gold: DataFrame, class_ids: list[int], *, seed: int = 42, without_gold: int = 3) -> DataFrame:
    """(tier, image_id, class_id): for each tier as many absent classes an image as it has gold ones, else without_gold.

    random: hash order; popular: classes of the most images first; adversarial:
    classes that occur most often with the image's gold ones. Ties keep the
    order of the class table.
    """
    # dealt by image once: what follows is asked of images, and their classes are few enough to be sorted in one row
    gold = gold.select("image_id", "class_id").repartition("image_id").distinct()
    absent = absent_classes(images, gold, class_ids)
    n = gold.groupBy("image_id").agg(F.count("*").alias("n"))
    often = class_frequency(gold)
    both = F.broadcast(cooccurrence(gold))
    near = gold.join(both, gold["class_id"] == both["class_a"]).groupBy("image_id", F.col("class_b").alias("class_id")).agg(F.sum("n").alias("together"))
    c = absent.join(n, "image_id", "left").join(F.broadcast(often), "class_id", "left").join(near, ["image_id", "class_id"], "left")
    c = c.withColumns({"want": F.coalesce("n", F.lit(without_gold)), "popular": F.coalesce("n_images", F.lit(0)), "adversarial": F.coalesce("together", F.lit(0))})
    c = c.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("image_id").cast("string"), F.col("class_id").cast("string")).cast("binary")))
    c = c.groupBy("image_id").agg(F.any_value("want").cast("int").alias("want"), F.collect_list(F.struct("popular", "adversarial", "h", "class_id")).alias("c"))

    def first(tier: str) -> Column:
        score = lambda x: -x[tier] if tier != "random" else F.lit(0)
        tie = lambda x: x["h"] if tier == "random" else F.lit("")
        in_order = F.sort_array(F.transform("c", lambda x: F.struct(score(x).cast("long").alias("score"), tie(x).alias("tie"), x["class_id"].alias("class_id"))))
        return F.transform(F.slice(in_order, F.lit(1), F.col("want")), lambda x: F.struct(F.lit(tier).alias("tier"), x["class_id"].alias("class_id")))

    return c.select("image_id", F.explode(F.concat(*[first(t) for t in TIERS])).alias("r")).select("r.tier", "image_id", "r.class_id")


def balanced(questions: DataFrame, seed: int = 42) -> DataFrame:
    """As many yes as no questions in each tier: the larger label is cut in hash order."""
    ranked = hash_rank_once(questions, seed, ["image_id", "class_id"], "_k", ["tier", "label"])
    least = questions.groupBy("tier").agg(F.least(F.count_if(F.col("label") == "yes"), F.count_if(F.col("label") == "no")).alias("_least"))
    return ranked.join(least, "tier").where("_k <= _least").drop("_k", "_least")


def build_questions(images: DataFrame, gold: DataFrame, classes: DataFrame, class_ids: list[int], *, prompts: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(tier, question_id, image_id, cls, text, label) for all tiers; ids from 1 in a second hash order."""
    gold = cut(gold.select("image_id", "class_id").distinct(), "gold")
    yes = gold.select("image_id", "class_id", F.explode(F.lit(list(TIERS))).alias("tier")).withColumn("label", F.lit("yes"))
    rows = cut(yes.unionByName(negatives(images, gold, class_ids, seed=seed).withColumn("label", F.lit("no"))), "questions")
    rows = hash_rank_once(balanced(rows, seed), seed + 1, ["image_id", "class_id"], "question_id", ["tier"])
    rows = rows.join(classes.select("class_id", F.col("name").alias("cls")), "class_id")
    prompt = F.lit(None).cast("string")
    if prompts is not None:
        rows, prompt = rows.join(prompts.select("class_id", "prompt"), "class_id", "left"), F.col("prompt")
    return rows.select("tier", "question_id", "image_id", "cls", question(prompt, F.col("cls")).alias("text"), "label")


def confusion(answers: DataFrame) -> DataFrame:
    """Per model and tier, and per class in it (cls null: all): counts, timeouts and metrics in percent; null for 0/0.

    Timeouts are counted and left out of the rest; any other answer than yes is a no.
    """
    a = answers.withColumns({"label": F.lower(trimmed(F.col("label"))), "pred": predicted(F.col("response"))})
    on, yes, said = F.col("pred") != "timeout", F.col("label") == "yes", F.col("pred") == "yes"
    cells = a.groupingSets([["model", "tier"], ["model", "tier", "cls"]], "model", "tier", "cls").agg(
        F.count_if(on & said & yes).alias("tp"), F.count_if(on & said & ~yes).alias("fp"), F.count_if(on & ~said & yes).alias("fn"), F.count_if(on & ~said & ~yes).alias("tn"), F.count_if(~on).alias("timeouts"),
    )
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")

    def percent(a_, b_):  # noqa: ANN001, ANN202
        return F.try_divide(a_ * 100.0, b_)

    return cells.where("cls is null or tp + fp + fn + tn > 0").withColumns({
        "precision": percent(tp, tp + fp), "recall": percent(tp, tp + fn), "f1": percent(2 * tp, 2 * tp + fp + fn),
        "accuracy": percent(tp + F.col("tn"), n), "yes_ratio": percent(tp + fp, n),
    })


def tier_mean(cells: DataFrame) -> DataFrame:
    """Per model: the mean of the overall metrics over tiers, nulls left out."""
    return cells.where("cls is null").groupBy("model").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "accuracy", "yes_ratio")])


def model_cards(answers: DataFrame) -> DataFrame:
    """Per model over all tiers, strict yes/no answers only: metrics as fractions, 0 for 0/0; the median time is over all rows."""
    a = answers.withColumns({"said": strict_answer(F.col("response")), "is": F.regexp_replace(F.lower(trimmed(F.col("label"))), r"\.+$", "")})
    out = a.groupBy("model").agg(
        F.count_if((F.col("said") == "yes") & (F.col("is") == "yes")).alias("tp"), F.count_if((F.col("said") == "yes") & (F.col("is") == "no")).alias("fp"),
        F.count_if((F.col("said") == "no") & (F.col("is") == "yes")).alias("fn"), F.count_if(F.col("said").isNotNull()).alias("valid"), F.count_if(F.col("said") == "yes").alias("said_yes"),
        F.count("*").alias("n_total"), F.median("inference_s").alias("median_s"),
    ).where("valid > 0")
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero)
    out = out.withColumns({"precision": p, "recall": r})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    return out.select("model", f1.alias("f1"), "precision", "recall", (F.col("said_yes") / F.col("valid")).alias("yes_ratio"), (F.col("valid") / F.col("n_total")).alias("valid_rate"), "median_s", "n_total")


#: Size of a quantile sketch; a quantile's rank is off by about 0.3 % of the rows.
SKETCH, RANK_ERROR = 1024, 0.01


def latency_sketches(answers: DataFrame, keys: list[str], k: int = SKETCH) -> DataFrame:
    """Per group a mergeable sketch of its seconds, of bounded size at any number of rows; nulls are left out."""
    return answers.groupBy(*keys).agg(F.count("inference_s").alias("n"), F.kll_sketch_agg_double("inference_s", F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups, of other days or of other tables, as one each group."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, **ranks: float) -> DataFrame:
    """Columns of quantiles by name, as p50=0.5; their ranks are within RANK_ERROR at the default size."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(rank)) for name, rank in ranks.items()})


def calibration(cards: DataFrame) -> DataFrame:
    return cards.withColumn("deviation", F.abs(F.col("yes_ratio") - 0.5))


def latency(answers: DataFrame) -> DataFrame:
    """Per model and tier: answers, timeouts, total and mean seconds, timeouts included."""
    return answers.groupBy("model", "tier").agg(F.count("*").alias("n"), F.count_if(trimmed(F.col("response")) == TIMEOUT).alias("timeouts"), F.sum("inference_s").alias("total_s"), F.avg("inference_s").alias("mean_s"))


def unanswered(questions: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """Questions without an answer yet."""
    return questions.join(answers.select(*key).distinct(), key, "left_anti")


def first_seen(rows: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """One row per image and class, from the first tier that has it; optionally a reproducible sample of n."""
    rank = F.array_position(F.lit(list(TIERS)), F.col("tier"))
    w = Window.partitionBy("image_id", "cls").orderBy(rank, "question_id")
    out = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return out if n is None else first_by_hash(out, n, seed, ["image_id", "cls"])


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both stages' F1 per model, tier and class, with the change; rows of before decide."""
    b, a = before.select("model", "tier", "cls", F.col("f1").alias("f1_before")), after.select("model", "tier", "cls", F.col("f1").alias("f1_after"))
    same = b["model"].eqNullSafe(a["model"]) & b["tier"].eqNullSafe(a["tier"]) & b["cls"].eqNullSafe(a["cls"])
    return b.join(a, same, "left").select(b["model"], b["tier"], b["cls"], "f1_before", "f1_after", (F.col("f1_after") - F.col("f1_before")).alias("delta"))


def pareto(cards: DataFrame, time: str = "median_s", quality: str = "f1") -> DataFrame:
    """Models that no other beats: no one is at least as fast and as good, and better in one.

    Cards are one row a model. Only the best of each time can be on the frontier,
    and it must beat all faster ones, so a running maximum over times decides.
    """
    best = cards.withColumn("_best", F.max(quality).over(Window.partitionBy(time))).where(F.col(quality) == F.col("_best"))
    by_time = best.groupBy(time).agg(F.max(quality).alias("_q"))
    faster = F.max("_q").over(Window.orderBy(time).rowsBetween(Window.unboundedPreceding, -1))
    front = by_time.withColumn("_faster", faster).where(F.col("_faster").isNull() | (F.col("_q") > F.col("_faster"))).select(time)
    return best.join(front, time, "left_semi").drop("_best")


def excluding(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    return rows.where(~F.col(column).isin(names)) if names else rows


def resolved_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (name) with the path of the first folder that has the name, else the same stem with another extension.

    files: name, dir_rank, ext_rank, path. Names that are nowhere go.
    """
    from ..functions.text import stem

    w, f = wanted.withColumn("_stem", stem(F.col("name"))), files.withColumn("_stem", stem(F.col("name"))).withColumnRenamed("name", "_file")
    rank = F.struct((F.col("name") != F.col("_file")).alias("other"), "dir_rank", "ext_rank", "path")
    return w.join(f, "_stem").groupBy("name").agg(F.min_by("path", rank).alias("path"))
