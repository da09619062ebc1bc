"""User models over rows: answerers and detectors that load once a Python worker."""

from __future__ import annotations

import multiprocessing
import pickle
import select
import time
from collections.abc import Callable, Iterator
from multiprocessing.connection import Connection

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.text import TIMEOUT

ANSWER = "question_id long, response string, inference_s double"
DETECTIONS = "image_id long, tile int, det_id long, class_id int, x1 double, y1 double, x2 double, y2 double, score double"
_loaded: dict[str, object] = {}


def _model(name: str, load: Callable[[], object]) -> object:
    """The model of that name, loaded at its first use in this worker."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def _serve(load: Callable[[], Callable], pipe: Connection, others: list[Connection], stop: object) -> None:
    for end in others:
        end.close()  # so that the end of the worker is the end of this pipe
    try:
        ask = load()
        pipe.send_bytes(pickle.dumps((None, True, None, 0.0)))
        while True:
            for at, args in enumerate(pickle.loads(pipe.recv_bytes())):
                if stop.value:
                    break
                began = time.monotonic()
                try:
                    fine, value = True, ask(*args)
                except Exception as e:  # noqa: BLE001  the worker raises it
                    fine, value = False, repr(e)
                pipe.send_bytes(pickle.dumps((at, fine, value, time.monotonic() - began)))
            stop.value = 0
            pipe.send_bytes(pickle.dumps((None, True, None, 0.0)))
    except EOFError:
        pass


#: Seconds without an answer after which another child goes on with the questions behind.
PATIENCE = 0.25


class _Child:
    """A process with a model of its own that answers lists of questions in their order, one message an answer."""

    def __init__(self, load: Callable[[], Callable], others: list[Connection], load_s: float) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, end = context.Pipe()
        self.stop, self.ready, self.key = context.RawValue("b", 0), select.poll(), None
        self.process = context.Process(target=_serve, args=(load, end, [self.pipe, *others], self.stop), daemon=True)
        self.process.start()
        end.close()
        self.ready.register(self.pipe, select.POLLIN)
        if not self.has_said(load_s):
            self.close()
            raise TimeoutError(f"not loaded in {load_s} s")
        self.said()

    def has_said(self, seconds: float) -> bool:
        return bool(self.ready.poll(max(0.0, seconds) * 1000))

    def said(self) -> tuple:
        """(at, answer, seconds) of the next answer; at is None behind the last one."""
        at, fine, value, seconds = pickle.loads(self.pipe.recv_bytes())
        if not fine:
            raise RuntimeError(value)
        return at, value, seconds

    def close(self) -> None:
        self.process.kill()
        self.process.join()
        self.pipe.close()


class Deadline:
    """Children of the worker that answer questions; one that is not back in time is ended.

    One child answers. While it is late, and up to `waiting` others wait already,
    another one goes on with the questions behind, so the time of answers that never
    come is spent together. Each child holds a model.
    """

    def __init__(self, load: Callable[[], Callable], limit_s: float, waiting: int = 0, load_s: float = 600.0) -> None:
        self.load, self.limit_s, self.waiting, self.load_s = load, limit_s, waiting, load_s
        self.idle, self.late, self.busy = [], [], None

    def _child(self) -> _Child:
        return self.idle.pop() if self.idle else _Child(self.load, [c.pipe for c in self.late], self.load_s)

    def _back(self) -> list[tuple]:
        """Answers of late children that came, or that are given up."""
        out, late = [], []
        for c in self.late:
            while True:
                if c.has_said(0):
                    at, value, seconds = c.said()
                    if at is None:
                        self.idle.append(c)
                        break
                    if c.key is not None:  # else it had begun with the next question, which another child has too
                        out.append((c.key, value, seconds))
                    c.key, c.since = None, time.monotonic()
                elif time.monotonic() - c.since >= self.limit_s:
                    c.close()
                    out += [] if c.key is None else [(c.key, None, time.monotonic() - c.since)]
                    break
                else:
                    late.append(c)
                    break
        self.late = late
        return out

    def _some(self, todo: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """The answers up to a late question, and the questions that no child has."""
        out, at, self.busy = [], 0, self._child()
        child, since = self.busy, time.monotonic()
        child.pipe.send_bytes(pickle.dumps([args for _, args in todo]))
        while True:
            if child.has_said(min(PATIENCE, since + self.limit_s - time.monotonic())):
                k, value, seconds = child.said()
                if k is None:
                    self.idle.append(child)
                    self.busy = None
                    return out, []
                out.append((todo[k][0], value, seconds))
                at, since = k + 1, time.monotonic()
                continue
            passed = time.monotonic() - since
            out += self._back()
            if at == len(todo):
                continue
            if passed >= self.limit_s:
                child.close()
                out.append((todo[at][0], None, passed))
            elif len(self.late) < self.waiting:
                child.stop.value, child.key, child.since = 1, todo[at][0], since
                self.late.append(child)
            else:
                continue
            self.busy = None
            return out, todo[at + 1 :]

    def ask(self, lists: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        """(key, answer, seconds) for lists of (key, arguments), as they come; the answer is None if there is none in limit_s."""
        for c in [*self.late, *([self.busy] if self.busy else [])]:  # of a task that ended early
            c.close()
        self.late, self.busy = [], None
        for todo in lists:
            out = []
            while todo:
                found, todo = self._some(todo)
                out += found
            yield self._in_time(out + self._back())
        while self.late:
            time.sleep(PATIENCE / 10)
            yield self._in_time(self._back())

    def _in_time(self, found: list[tuple]) -> list[tuple]:
        return [(key, value if seconds <= self.limit_s else None, seconds) for key, value, seconds in found]


def answered(questions: DataFrame, name: str, load: Callable[[], Callable[[str, str], str]] | None = None, *, limit_s: float = 20.0, rows: int = 500, waiting: int = 0) -> DataFrame:
    """(question_id, response, inference_s) for questions (question_id, image, text).

    load gives a callable (image, text) -> answer; without it the answerer
    registered by that name is taken. Each Python worker asks a child process of
    its own. Where an answer takes longer than limit_s the child is ended, the
    timeout mark is the answer, and the next question starts a child. With
    `waiting`, that many late children of a worker wait out the limit beside the one
    that goes on, each with a model. Questions go out in lists of up to `rows`.
    """
    if load is None and name not in REGISTRY:
        raise KeyError(f"{name}: not one of {', '.join(sorted(REGISTRY))}")
    load = load or REGISTRY[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(f"{name} in {limit_s} s, {waiting} waiting", lambda: Deadline(load, limit_s, waiting))

        def lists() -> Iterator[list[tuple]]:
            for pdf in batches:
                asked = list(zip(pdf["question_id"].tolist(), zip(pdf["image"].tolist(), pdf["text"].tolist(), strict=True), strict=True))
                yield from (asked[at : at + rows] for at in range(0, len(asked), rows))

        for found in model.ask(lists()):
            if found:
                yield pd.DataFrame([(q, TIMEOUT if a is None else str(a).strip()[:300], t) for q, a, t in found], columns=["question_id", "response", "inference_s"])

    return questions.select("question_id", "image", "text").mapInPandas(run, ANSWER)


def detected_in_batches(tiles: DataFrame, load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], *, batch_size: int = 256) -> DataFrame:
    """Detections of tiles (image_id, tile) by a model that takes arrays.

    load gives a callable that takes the image_ids and tiles of up to batch_size
    rows and returns an array (rows, boxes, 6) of class_id, x1, y1, x2, y2, score,
    padded with NaN where a tile has fewer boxes. It is called once a worker.
    """

    def make() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        predict = load()
        return lambda image_id, tile: predict(image_id, tile).reshape(len(image_id), -1)

    boxes = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    found = tiles.select("image_id", "tile", boxes("image_id", "tile").alias("flat"))
    places = F.sequence(F.lit(0), (F.size("flat") / 6).cast("int") - 1)
    each = found.where("size(flat) > 0").select("image_id", "tile", "flat", F.explode(places).alias("det_id"))
    value = [F.col("flat")[F.col("det_id") * 6 + k] for k in range(6)]
    return each.where(value[0].isNotNull() & ~F.isnan(value[0])).select("image_id", "tile", F.col("det_id").cast("long").alias("det_id"), value[0].cast("int").alias("class_id"), *[v.alias(c) for v, c in zip(value[1:], ("x1", "y1", "x2", "y2", "score"), strict=True)])


def detected(tiles: DataFrame, name: str, load: Callable[[], Callable[[int, int], list[tuple]]]) -> DataFrame:
    """Detections of tiles (image_id, tile); load gives a callable (image_id, tile) -> [(class_id, x1, y1, x2, y2, score)]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = _model(name, load)
        for pdf in batches:
            rows = [(i, t, k, *d) for i, t in zip(pdf["image_id"], pdf["tile"], strict=True) for k, d in enumerate(detect(i, t))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTIONS.split(", ")])

    return tiles.select("image_id", "tile").mapInPandas(run, DETECTIONS)


#: Registered answerers by name: a loader each.
REGISTRY: dict[str, Callable[[], Callable[[str, str], str]]] = {}


def register(name: str, load: Callable[[], Callable[[str, str], str]]) -> None:
    REGISTRY[name] = load
