"""Incremental answering and monitoring with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

KEY = ["model", "tier", "question_id"]


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, a few new files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_each(questions: DataFrame, key: list[str] = KEY, *, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """A stream without repeated keys. The state is bounded by the delay after the event time, which is the arrival if not given."""
    if event_time is None:
        arrived = questions.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
        return arrived.dropDuplicatesWithinWatermark(key).drop("_arrived")
    return questions.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: list[str] = KEY) -> StreamingQuery:
    """Answers the questions that path has no answer to, batch by batch, and appends them; ends when all is read.

    A batch that runs again after a failure finds its own rows in path and adds
    none twice. Each batch reads the keys of all answers, so the batches of a long
    stream should grow with it.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        new = df.dropDuplicates(key)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            new = new.join(spark.read.parquet(path).select(*key), key, "left_anti")
        answer(new).write.mode("append").parquet(path)

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows appended to a Parquet table as they come."""
    return rows.writeStream.outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EPOCH_OUT = "run long, epoch int, best double, improved boolean, since int"


def epoch_monitor(epochs: DataFrame, metric: str = "map5095", run: str = "run", epoch: str = "epoch") -> DataFrame:
    """A stream of epochs with the best metric so far, improvement and epochs since, one state a run.

    Epochs of a run are taken in the order of a batch's epoch numbers; epochs
    without metric are skipped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        best, since = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).dropna(subset=[metric]).sort_values(epoch)
        out = []
        for e, m in zip(rows[epoch], rows[metric], strict=True):
            improved = m > best
            best, since = (m, 0) if improved else (best, since + 1)
            out.append((key[0], int(e), float(best), bool(improved), int(since)))
        state.update((float(best), int(since)))
        yield pd.DataFrame(out, columns=["run", "epoch", "best", "improved", "since"])

    rows = epochs.select(F.col(run).cast("long").alias(run), epoch, metric)
    return rows.groupBy(run).applyInPandasWithState(step, EPOCH_OUT, "best double, since int", "append", "NoTimeout")
