"""Monitoring of training runs by event time: typed state, timers, and an end for runs that fall silent."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "run long, at timestamp, epoch int, best double, improved boolean, since int, status string"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers and typed state need; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class RunMonitor(StatefulProcessor):
    """Epochs of a run wait until the watermark has passed them, and are then judged in the order of their times."""

    def __init__(self, idle_us: int, patience: int) -> None:
        self.idle_us, self.patience = idle_us, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, epoch int, metric double")
        self.progress = handle.getValueState("progress", "best double, since int, epoch int, at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        """The epochs wait in one list, with a timer for the first of them: calls to the state are few a run and batch."""
        new = [(r["at"], r["epoch"], r["metric"]) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(self._ms(min(new)[0]))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get())
        due = [place for place in waiting if self._ms(place[0]) < now]
        before = state = self.progress.get()
        for at, epoch, metric in due:
            if state and at - state[3] >= self.idle_us:
                yield self._ended(key[0], state)
                state = None
            best, since = (state[0], state[1]) if state else (0.0, 0)
            improved = metric > best
            best, since = (metric, 0) if improved else (best, since + 1)
            state = (best, since, epoch, at)
            yield self._row(key[0], at, epoch, best, improved, since, "stop" if since == self.patience else "epoch")
        if state and self._ms(state[3] + self.idle_us) < now:
            yield self._ended(key[0], state)
            state = None
        if due:
            self._left(waiting[len(due) :])
        if state and due:
            self.progress.update(state)
            self.handle.registerTimer(self._ms(state[3] + self.idle_us))
        elif before and not state:
            self.progress.clear()

    def _left(self, waiting: list[tuple]) -> None:
        """The epochs that wait on, with a timer for the first of them."""
        if waiting:
            self.waiting.put(waiting)
            self.handle.registerTimer(self._ms(waiting[0][0]))
        else:
            self.waiting.clear()

    @staticmethod
    def _ms(us: int) -> int:
        """The first whole millisecond at or after a time in microseconds."""
        return -(-us // 1000)

    def _ended(self, run: int | None, state: tuple) -> Row:
        best, since, epoch, at = state
        return self._row(run, at, epoch, best, False, since, "idle")

    @staticmethod
    def _row(run: int | None, at: int, epoch: int, best: float, improved: bool, since: int, status: str) -> Row:
        return Row(run=run, at=at, epoch=epoch, best=best, improved=improved, since=since, status=status)


def run_monitor(epochs: DataFrame, at: str, *, metric: str = "map5095", run: str = "run", epoch: str = "epoch", delay_s: int = 3600, idle_s: int = 86_400, patience: int = 50) -> DataFrame:
    """A stream of epochs as rows (run, at, epoch, best, improved, since, status), whatever the batches they came in.

    Epochs come out once the watermark, delay_s behind the latest time seen, has
    passed them, in the order of time, epoch and metric; what comes later than
    that is late and dropped. status is `epoch`, `stop` for the epoch that
    makes `patience` of them without improvement, and `idle` for a row at the end
    of a run without epochs for idle_s: its state is deleted then, and a later
    epoch of the run begins anew from 0. Repeated rows are epochs of their own.
    Epochs without number, time or metric are left out; a null run is a run. State is
    the epochs of the last delay_s and one row for each run of the last idle_s.
    """
    ok = epochs.where(F.col(at).isNotNull() & F.col(epoch).isNotNull() & F.col(metric).isNotNull() & ~F.isnan(metric))
    rows = ok.select(F.col(run).cast("long").alias("run"), F.col(epoch).cast("int").alias("epoch"), F.col(metric).cast("double").alias("metric"), F.col(at).cast("timestamp").alias("_time"))
    rows = rows.withWatermark("_time", f"{delay_s} seconds").withColumn("at", F.unix_micros("_time"))
    out = rows.groupBy("run").transformWithState(RunMonitor(idle_s * 1_000_000, patience), OUT.replace("at timestamp", "at long"), "Append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("at"))
