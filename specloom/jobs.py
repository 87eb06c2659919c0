"""Work in the background of a session: submitted, watched and waited for."""

from __future__ import annotations

import threading
import time
import traceback
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import SparkSession

Progress = Callable[[int, int, str], None]
QUEUED, RUNNING, COMPLETED, FAILED = "queued", "running", "completed", "failed"


@dataclass
class State:
    id: str
    status: str = QUEUED
    current: int = 0
    total: int = 0
    message: str = ""
    result: Any = None
    error: str | None = None
    trace: str | None = None
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())


class Jobs:
    """A queue of functions, in order, ``workers`` at a time; the Spark jobs of each form a group of their own, so that they can be seen and cancelled."""

    def __init__(self, spark: SparkSession, workers: int = 1) -> None:
        self.spark, self.pool = spark, ThreadPoolExecutor(workers)
        self.states: dict[str, State] = {}
        self.changed = threading.Condition()

    def _set(self, state: State, **values: Any) -> None:
        with self.changed:
            for k, v in values.items():
                setattr(state, k, v)
            self.changed.notify_all()

    def submit(self, work: Callable[[Progress], Any], message: str = "") -> str:
        """Queues a function, which is given a function to report (current, total, message) by; returns the id of the job."""
        state = State(uuid.uuid4().hex, message=message)
        with self.changed:
            self.states[state.id] = state

        def run() -> None:
            self._set(state, status=RUNNING)
            self.spark.sparkContext.setJobGroup(state.id, message or state.id, interruptOnCancel=True)
            try:
                result = work(lambda current, total, text: self._set(state, current=current, total=total, message=text))
                self._set(state, status=COMPLETED, result=result)
            except Exception as problem:  # noqa: BLE001 - it is the job's own and is told by its state
                self._set(state, status=FAILED, error=f"{type(problem).__name__}: {problem}", trace=traceback.format_exc())

        self.pool.submit(run)
        return state.id

    def state(self, job: str) -> dict[str, Any]:
        """What is known of a job, with the numbers of its Spark jobs and of their tasks; KeyError for an unknown id."""
        with self.changed:
            known = asdict(self.states[job])
        tracker = self.spark.sparkContext.statusTracker()
        ids = tracker.getJobIdsForGroup(job)
        stages = [s for j in ids if (info := tracker.getJobInfo(j)) for i in info.stageIds if (s := tracker.getStageInfo(i))]
        return known | {"spark_jobs": len(ids), "tasks": sum(s.numTasks for s in stages), "tasks_done": sum(s.numCompletedTasks for s in stages)}

    def wait(self, job: str, timeout: float | None = None) -> dict[str, Any]:
        """The state of a job once it is completed or failed; TimeoutError after ``timeout`` seconds."""
        until = None if timeout is None else time.monotonic() + timeout
        with self.changed:
            state = self.states[job]
            while state.status not in (COMPLETED, FAILED):
                left = None if until is None else until - time.monotonic()
                if left is not None and left <= 0:
                    raise TimeoutError(job)
                self.changed.wait(left)
        return self.state(job)

    def cancel(self, job: str) -> None:
        """Ends the Spark jobs of a job; its function then fails."""
        self.spark.sparkContext.cancelJobGroup(job)

    def close(self) -> None:
        self.pool.shutdown(wait=False, cancel_futures=True)
