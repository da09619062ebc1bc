"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxmill.llm.decontam import drop_contaminated
from boxmill.llm.dedup import drop_near_duplicates
from boxmill.llm.mixing import mixed
from boxmill.llm.quality import drop_rejected
from boxmill.llm.sharding import shard
from boxmill.operators.lineage import deleted, scratch, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that are over the limit.

    Documents with null or empty text fail the base rules and go. Rows alike in
    source and text share their verdict, so repeated rows stay or go together. A
    null source is one of its own. An empty table stays empty.
    """
    return drop_rejected(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows with a null id stay. Texts without words are linked with nothing and
    stay. Of rows alike in id and text one stays. An empty table stays empty.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null text holds none, and null or wordless items have none; without any item
    all stay. Repeated rows stay or go together. An empty table stays empty.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands there as often as the mix takes it, at most three times.

    A null source comes last in the order of sources. A null text has size 0.
    Rows alike in id and text are taken equally often. An empty table stays empty.
    """
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their place: shard and slot, and size and checksum of the text.

    A null text counts as empty. Equal rows lie side by side in the order of
    their key. Columns named like a new one are replaced. An empty table stays empty.
    """
    placed = shard(docs, to="_shard")
    new = placed.select("_shard.*").columns
    return placed.select(*[c for c in docs.columns if c.lower() not in new], "_shard.*")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The stages hash, count and search iteratively, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again as the next one's docs.

    What a stage wrote for itself is deleted when its result is written, and a
    stage's result when the next one's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name.replace(" ", "-")}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            deleted(spark, before)
        before = path
    return docs
