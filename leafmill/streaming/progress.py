"""Progress events: of each task only those that moved far enough since the last one told."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

POINTS = 3.0


def throttled(events: DataFrame, task: str, order: list[str], percent: str, points: float = POINTS) -> DataFrame:
    """events (task, order columns, percent) that are told: at least points above the last told one,
    or at the end. What is told depends on what was, so it is a scan in order; rows of a task are
    a sorted run of a partition and pass through one at a time, never gathered."""
    rows = events.repartition(task).sortWithinPartitions(task, *order)
    place = rows.columns.index(task), rows.columns.index(percent)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, 0.0
        for f in frames:
            told = []
            for t, p in zip(f.iloc[:, place[0]], f.iloc[:, place[1]]):
                if t != now:
                    now, last = t, 0.0
                told.append(p - last >= points or p >= 100.0)
                if told[-1]:
                    last = p
            yield f[told]

    return rows.mapInPandas(run, rows.schema)


def throttled_stream(events: DataFrame, task: str, percent: str, points: float = POINTS) -> DataFrame:
    """The same for a stream: task, percent of the events told. State: the last told percentage."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0.0
        for f in frames:
            out = []
            for p in f[percent]:
                if p - last >= points or p >= 100.0:
                    last = p
                    out.append(p)
            yield pd.DataFrame({task: [key[0]] * len(out), percent: out})
        state.update((last,))

    kind = dict(events.dtypes)[task]
    rows = events.select(task, F.col(percent).cast("double").alias(percent))
    return rows.groupBy(task).applyInPandasWithState(run, f"{task} {kind}, {percent} double", "last double", "append", GroupStateTimeout.NoTimeout)


class Progress:
    """Tells a callback of the driver how many rows of a run are through, as tasks end.

    counted() is what the run's rows pass through; start() begins to tell, and what tells is ended by
    stop(), which tells the end. The callback changes nothing, and if it fails the run goes on.
    """

    def __init__(self, spark: SparkSession, total: int, told: Callable[[str, float], None], points: float = POINTS, every: float = 0.2):
        self.total, self.told, self.points, self.every = max(total, 1), told, points, every
        self.rows = spark.sparkContext.accumulator(0)
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None
        self._last = 0.0

    def counted(self, df: DataFrame) -> DataFrame:
        rows = self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    def _tell(self, phase: str, percent: float) -> None:
        self._last = percent
        try:
            self.told(phase, percent)
        except Exception:  # noqa: BLE001
            logging.getLogger(__name__).warning("a progress callback failed", exc_info=True)

    def start(self) -> Progress:
        def watch() -> None:
            while not self._stop.wait(self.every):
                percent = min(100.0 * self.rows.value / self.total, 99.0)
                if percent - self._last >= self.points:
                    self._tell("compressing", percent)

        self._tell("loading", 0.0)
        self._thread = threading.Thread(target=watch, daemon=True)
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
        self._tell("done", 100.0)

    def __enter__(self) -> Progress:
        return self.start()

    def __exit__(self, *_: object) -> None:
        self.stop()
