"""A queue that runs one job after another on a session, each in a job group that can be cancelled."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql import SparkSession


class JobQueue:
    """`submit` runs jobs in order of arrival; queued ones can be taken back, the active one's Spark jobs are cancelled."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.states: dict[str, str] = {}
        self._waiting: deque[tuple[str, Callable[[], None]]] = deque()
        self._active: str | None = None
        self._changed = threading.Condition()
        threading.Thread(target=self._run, daemon=True).start()

    def submit(self, job: str, work: Callable[[], None]) -> None:
        with self._changed:
            self._waiting.append((job, work))
            self.states[job] = "queued"
            self._changed.notify_all()

    def messages(self) -> dict[str, str]:
        with self._changed:
            ahead = int(self._active is not None)
            return {
                job: f"Queued. Waiting for {k + ahead} job(s) ahead." if k + ahead else "Queued. Waiting for processing to start."
                for k, (job, _) in enumerate(self._waiting)
            }

    def cancel(self, job: str) -> bool:
        with self._changed:
            for item in self._waiting:
                if item[0] == job:
                    self._waiting.remove(item)
                    self.states[job] = "cancelled"
                    return True
            if self._active == job:
                self.states[job] = "cancelled"
                self.spark.sparkContext.cancelJobGroup(job)
                return True
        return False

    def stop_all(self) -> dict[str, int]:
        with self._changed:
            queued, active = [job for job, _ in self._waiting], self._active
        counts = {"queued_cancelled": sum(self.cancel(j) for j in queued), "active_cancelled": 0}
        counts["active_cancelled"] = int(active is not None and self.cancel(active))
        return counts

    def wait(self, timeout: float = 60.0) -> bool:
        """Until nothing is queued or active."""
        with self._changed:
            return self._changed.wait_for(lambda: not self._waiting and self._active is None, timeout)

    def _run(self) -> None:
        while True:
            with self._changed:
                self._changed.wait_for(lambda: bool(self._waiting))
                job, work = self._waiting.popleft()
                self._active = job
                self.states[job] = "active"
            try:
                self.spark.sparkContext.setJobGroup(job, job, interruptOnCancel=True)
                work()
                outcome = "complete"
            except Exception:  # the job's state tells; the queue goes on
                outcome = "failed"
            with self._changed:
                if self.states[job] != "cancelled":
                    self.states[job] = outcome
                self._active = None
                self._changed.notify_all()
