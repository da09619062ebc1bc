from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_rows import SCHEMA, make_benchmark, make_docs


@pytest.fixture(scope="session")
def doc_rows() -> list[tuple]:
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns whose names the operators use inside or return."""
    from pyspark.sql import functions as F

    names = ["size", "kept", "quality", "host", "draw", "shard", "slot", "mix", "leak", "licence", "k1", "_k1", "_base", "_size", "count", "part", "key", "component_id", "copies", "_quality"]
    return docs.withColumns({n: F.lit(7) for n in names})


@pytest.fixture(scope="session")
def benchmark(spark, doc_rows):
    return spark.createDataFrame(make_benchmark(doc_rows), "item_id long, text string")
