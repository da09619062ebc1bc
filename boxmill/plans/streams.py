"""Streaming queries, run to the end of the given rows, beside their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir
from ..streaming.answers import KEY, answer_stream, append_stream, epoch_monitor, once_each, stream
from ..streaming.monitor import keyed_state, run_monitor
from .base import Views, query


def staged(df: DataFrame) -> tuple[str, str]:
    """A folder with df's rows for a stream to read, and its schema."""
    path = f"{shared_dir(df.sparkSession)}/stream-in-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, ", ".join(f"{n} {k}" for n, k in df.dtypes)


#: Batches in which a table is replayed, however many files it has.
REPLAYED = 4


def replayed(v: Views, path: str, schema: str, batches: int = REPLAYED) -> DataFrame:
    """The folder as a stream of at most that many batches.

    Each batch of once-each looks at the whole state for keys whose delay is over, and
    each batch of answers at the keys of all that are there, so the work of batches of
    a fixed number of files would grow with the square of the table.
    """
    files = len(v.spark.read.schema(schema).parquet(path).inputFiles())
    return stream(v.spark, path, schema, max(2, -(-files // batches)))


def written(v: Views, rows: DataFrame) -> DataFrame:
    """What a stream appended, after its end."""
    out = f"{shared_dir(v.spark)}/stream-out-{uuid.uuid4().hex}"
    append_stream(rows, f"{out}/rows", f"{out}/log").awaitTermination()
    return v.spark.read.schema(rows.schema).parquet(f"{out}/rows")


@query("""+r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i, greatest(0, max(map5095) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)) AS best FROM fx_epoch WHERE map5095 IS NOT NULL),
m AS (SELECT *, best > coalesce(lag(best) OVER (PARTITION BY run ORDER BY epoch), 0) AS improved FROM r)
SELECT run, epoch, best, improved, i - coalesce(last_value(CASE WHEN improved THEN i END IGNORE NULLS) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS since FROM m""", "fx_epoch")  # fmt: skip
def stream_epoch_monitor(v: Views) -> DataFrame:
    path, schema = staged(v.fx_epoch)
    return written(v, epoch_monitor(stream(v.spark, path, schema, 10_000)))


@query("""+o AS (SELECT run, epoch, map5095 AS m, epoch_us(seen) AS at_us, (epoch_us(max(seen) OVER ()) // 1000) - 3600000 AS mark FROM fx_epoch_time),
e AS (SELECT *, at_us - lag(at_us) OVER w >= 86400000000 AS fresh FROM o WHERE m IS NOT NULL AND ceil(at_us / 1000) < mark WINDOW w AS (PARTITION BY run ORDER BY at_us, epoch, m)),
s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY at_us, epoch, m ROWS UNBOUNDED PRECEDING) AS part FROM e),
r AS (SELECT *, row_number() OVER w AS i, greatest(0, max(m) OVER (w ROWS UNBOUNDED PRECEDING)) AS best FROM s WINDOW w AS (PARTITION BY run, part ORDER BY at_us, epoch, m)),
j AS (SELECT *, best > coalesce(lag(best) OVER (PARTITION BY run, part ORDER BY i), 0) AS improved, max(i) OVER (PARTITION BY run, part) AS n FROM r),
k AS (SELECT *, (i - coalesce(max(CASE WHEN improved THEN i END) OVER (PARTITION BY run, part ORDER BY i ROWS UNBOUNDED PRECEDING), 0))::INT AS since FROM j)
SELECT run, at_us, epoch, best, improved, since, CASE since WHEN 3 THEN 'stop' ELSE 'epoch' END AS status FROM k
UNION ALL SELECT run, at_us, epoch, best, false, since, 'idle' FROM k AS last WHERE i = n AND (ceil((at_us + 86400000000) / 1000) < mark OR EXISTS (SELECT 1 FROM k WHERE k.run = last.run AND k.part > last.part))""", "fx_epoch_time")  # fmt: skip
def stream_run_monitor(v: Views) -> DataFrame:
    """Epochs by their times, an hour of disorder allowed; runs end after a day of silence and stop after three epochs without improvement."""
    path, schema = staged(v.fx_epoch_time.withColumn("seen", F.col("seen").cast("timestamp")))
    with keyed_state(v.spark):
        out = written(v, run_monitor(stream(v.spark, path, schema, 10_000), "seen", patience=3))
    return out.withColumn("at", F.unix_micros("at")).withColumnRenamed("at", "at_us")


@query("SELECT DISTINCT question_id, model, tier FROM fx_answer", "fx_answer")
def stream_once_each(v: Views) -> DataFrame:
    a = v.fx_answer.select("question_id", "model", "tier")
    path, schema = staged(a.unionByName(a))
    with keyed_state(v.spark):  # the keys of a large table do not fit in the memory of executors
        return written(v, once_each(replayed(v, path, schema)))


@query("SELECT question_id, model, tier, upper(cls) AS response FROM fx_answer", "fx_answer")
def stream_resumed_answers(v: Views) -> DataFrame:
    """Answers from two runs over the same stream; the second one finds all answered.

    An image of over 16 questions shares their ids with the next image, so both are the key.
    Two batches a run, as each reads the keys of all answers: two and a half times the table in all.
    """
    path, schema = staged(v.fx_answer.select("image_id", "question_id", "model", "tier", "cls"))
    out = f"{shared_dir(v.spark)}/stream-out-{uuid.uuid4().hex}"
    key = ["image_id", *KEY]
    for run in ("first", "second"):
        q = answer_stream(replayed(v, path, schema, 2), lambda df: df.select(*key, F.upper("cls").alias("response")), f"{out}/rows", f"{out}/{run}", key)
        q.awaitTermination()
    return v.spark.read.parquet(f"{out}/rows").select("question_id", "model", "tier", "response")
