"""All registered queries over the given tables and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import evaluation, fusion, labels, probing, regions, streams  # noqa: F401, I001  they register their queries
from . import artefacts, dense, files  # noqa: F401  with the SQL of others, or files
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept boxes and mean score per class after class-wise suppression."""
    return QUERIES["nms_class_summary"](spark, sf_dir)
