"""Jobs in the background of a session: Spark's scheduler queues, retries and spreads their tasks.

A job is a function without arguments. It runs in a thread of its own under a job group, by which
its progress is read and by which it is cancelled.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class JobState(str, Enum):
    PENDING = "pending"
    RUNNING = "running"
    DONE = "done"
    FAILED = "failed"
    CANCELLED = "cancelled"


FINAL = (JobState.DONE, JobState.FAILED, JobState.CANCELLED)


@dataclass
class Job:
    number: str
    name: str
    state: JobState = JobState.PENDING
    result: Any = None
    error: str = ""
    attempts: int = 0
    ended: threading.Event = field(default_factory=threading.Event, repr=False)


class JobRunner:
    """Runs at most ``slots`` jobs at once, in the order in which they came."""

    def __init__(self, spark: SparkSession, slots: int = 4, attempts: int = 3):
        self.spark, self.attempts = spark, attempts
        self._jobs: dict[str, Job] = {}
        self._queue: list[tuple[Job, Callable[[], Any]]] = []
        self._free, self._lock = slots, threading.Lock()

    def submit(self, work: Callable[[], Any], name: str = "") -> str:
        job = Job(uuid.uuid4().hex, name)
        with self._lock:
            self._jobs[job.number] = job
            self._queue.append((job, work))
        self._next()
        return job.number

    def _next(self) -> None:
        with self._lock:
            if not self._free or not self._queue:
                return
            job, work = self._queue.pop(0)
            self._free -= 1
            job.state = JobState.RUNNING
        InheritableThread(target=self._run, args=(job, work), daemon=True).start()

    def _run(self, job: Job, work: Callable[[], Any]) -> None:
        context = self.spark.sparkContext
        context.setJobGroup(job.number, job.name, interruptOnCancel=True)
        state = JobState.FAILED
        while state is JobState.FAILED and job.attempts < self.attempts and job.state is JobState.RUNNING:
            job.attempts += 1
            try:
                job.result, state = work(), JobState.DONE
            except Exception as error:  # a job's failure is its result
                job.error = str(error)
        with self._lock:
            if job.state is JobState.RUNNING:
                job.state = state
            self._free += 1
        job.ended.set()
        self._next()

    def status(self, number: str) -> dict[str, Any]:
        """name, state, attempts, error and progress: the share of the known tasks that are done."""
        job = self._jobs[number]
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for j in tracker.getJobIdsForGroup(number):
            info = tracker.getJobInfo(j)
            for s in info.stageIds if info else ():
                stage = tracker.getStageInfo(s)
                if stage:
                    done, total = done + stage.numCompletedTasks, total + stage.numTasks
        progress = 1.0 if job.state is JobState.DONE else done / total if total else 0.0
        return {"job": number, "name": job.name, "state": job.state.value, "attempts": job.attempts, "error": job.error, "progress": progress}

    def list(self) -> list[dict[str, Any]]:
        return [self.status(n) for n in list(self._jobs)]

    def wait(self, number: str, timeout: float | None = None) -> Any:
        """The job's result; raises if it failed, was cancelled or takes longer than ``timeout`` seconds."""
        job = self._jobs[number]
        if not job.ended.wait(timeout):
            raise TimeoutError(f"job {number} is still {job.state.value}")
        if job.state is not JobState.DONE:
            raise RuntimeError(f"job {number} {job.state.value}: {job.error}")
        return job.result

    def cancel(self, number: str) -> bool:
        """Take a waiting job from the queue, or stop a running one's Spark jobs; False if it has ended."""
        job = self._jobs[number]
        with self._lock:
            if job.state in FINAL:
                return False
            waiting = job.state is JobState.PENDING
            self._queue = [q for q in self._queue if q[0] is not job]
            job.state = JobState.CANCELLED
        if waiting:
            job.ended.set()
        while not job.ended.wait(0.2):  # a job between two Spark jobs starts the next one
            self.spark.sparkContext.cancelJobGroup(number)
            time.sleep(0.1)
        return True
