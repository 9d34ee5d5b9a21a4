"""Progress of jobs, counted in passing: observed metrics of batch stages and of streams fill one board, without another pass.

A stage is a data frame that is watched: its rows are counted while whatever action uses it runs. A stream that is watched
reports with each micro-batch through a listener. `rows` and `table` tell (job, stage, done, total) at any time; of a stage
that has not run yet, `done` is 0.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "job string, stage string, done long, total long, failed long"
_PREFIX = "progress:"


@dataclass
class _Stage:
    job: str
    stage: str
    total: int | None
    observation: Observation | None = None
    done: int = 0
    failed: int = 0
    seen: set[tuple[str, int]] = field(default_factory=set)


class Board(StreamingQueryListener):
    """What jobs have done. Add it to a session (`spark.streams.addListener`) for streams to report to it."""

    def __init__(self):
        self._stages: dict[str, _Stage] = {}
        self._lock = threading.Lock()

    def watch(self, rows: DataFrame, job: str, stage: str, total: int | None = None, failed: Column | None = None) -> DataFrame:
        """`rows`, counted as they pass; `failed` holds for those that are failures. For a stream, each micro-batch adds to what it has done.

        A batch stage is counted by the first action that runs it.
        """
        name = f"{_PREFIX}{job}\x1f{stage}"
        counts = [F.count(F.lit(1)).alias("done"), F.count(F.when(F.lit(False) if failed is None else failed, 1)).alias("failed")]
        with self._lock:
            known = self._stages[name] = _Stage(job, stage, total)
        if rows.isStreaming:
            return rows.observe(name, *counts)
        known.observation = Observation(name)
        return rows.observe(known.observation, *counts)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self._lock:
            for name, row in progress.observedMetrics.items():
                known = self._stages.get(name)
                mark = (str(progress.runId), progress.batchId)
                if known is not None and mark not in known.seen:
                    known.seen.add(mark)
                    known.done += row["done"]
                    known.failed += row["failed"]

    def rows(self) -> list[tuple[str, str, int, int | None, int]]:
        """(job, stage, done, total, failed) by job and stage."""
        out, spark = [], SparkSession.getActiveSession()
        if spark is not None:  # what actions have observed comes by way of Spark's listeners, a moment later
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        with self._lock:
            for s in self._stages.values():
                if s.observation is not None and s.observation._jo is not None and s.observation._jo.future().isCompleted():
                    said = s.observation.get
                    s.done, s.failed = said["done"], said["failed"]
                out.append((s.job, s.stage, s.done, s.total, s.failed))
        return sorted(out, key=lambda r: r[:2])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), SCHEMA)

    def percent(self, job: str) -> float | None:
        """How far a job is, over all its stages whose total is known."""
        own = [(done, total) for j, _, done, total, _ in self.rows() if j == job and total]
        return 100.0 * sum(min(d, t) for d, t in own) / sum(t for _, t in own) if own else None
