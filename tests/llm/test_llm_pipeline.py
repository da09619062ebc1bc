"""The pipeline against its stages in plain Python, and the guard of the entry module."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from boxmill.llm import mixing
from llm_rows import SCHEMA
from pyspark.sql import functions as F
from test_llm_documents import dedup_brute, leak_brute, quality_brute


def test_pipeline(spark, tmp_path, doc_rows, benchmark):
    rows = [d for d in doc_rows if d[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    line = "subscribe to our letter now"
    kept = {r[0] for r in quality_brute(rows, 20) if r[7]}
    docs = [(i, "\n".join(x for x in t.split("\n") if " ".join(x.lower().split(" ")) != line) if s == "src1" else t, g, s, n) for i, t, g, s, n in rows if i in kept]
    first = {r[0] for r in dedup_brute(docs) if r[3]}
    docs = list({d[0]: d for d in docs if d[0] in first}.values())
    clean = {r[0] for r in leak_brute(docs, [tuple(r) for r in benchmark.collect()]) if not r[5]}
    docs = [d for d in docs if d[0] in clean]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(docs, SCHEMA)).select("doc_id", "mix.copies").collect()}
    assert Counter(r["doc_id"] for r in out) == Counter({k: n for k, n in copies.items() if n})
    assert {(r["doc_id"], r["text"]) for r in out} == {(d[0], d[1]) for d in docs if copies[d[0]]}
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_stages(spark, docs, benchmark, tmp_path):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "mixing", "sharding"]
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    last = corpus_pipeline.STAGES[-1][1](spark, docs.withColumn("slot", F.lit(1)), str(tmp_path))
    assert len(last.columns) == len(set(last.columns))


def test_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert sorted(n.split("_")[0] for n in names if n.startswith("op")) == sorted(f"op{k}" for k in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline_on_odd_tables(spark, tmp_path, docs, no_docs, benchmark):
    """Empty documents, an empty benchmark, and rows with nulls and repeats."""
    for k, (rows, items) in enumerate([(no_docs, benchmark), (no_docs, benchmark.limit(0)), (docs, benchmark.limit(0))]):
        at = tmp_path / str(k)
        rows.write.parquet(str(at / "documents.parquet"))
        items.write.parquet(str(at / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(at))
        assert {"doc_id", "text", "shard", "slot"} <= set(out.columns)
        assert (out.count() == 0) == (k < 2)
