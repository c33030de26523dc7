"""Running jobs: status, counters, retries of whole jobs, abort, chaining, call-backs. Spark retries tasks itself."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.counters import observed
from .settings import Settings
from .spec import JobSpec


class Status(Enum):
    RUNNING = "running"
    SUCCESS = "success"
    FAILED = "failed"
    ABORTED = "aborted"


class FailJob(Exception):
    """Raised by a job's own code on the driver: it fails at once, without another attempt."""


def overall(statuses: list[Status]) -> Status:
    """A job's status from its shards': a failed one counts before an aborted one, that before one that still runs."""
    for s in (Status.FAILED, Status.ABORTED, Status.RUNNING):
        if s in statuses:
            return s
    return Status.SUCCESS


def overall_stages(statuses: list[Status]) -> Status:
    """A pipeline's status from its stages': here an aborted one counts first."""
    return Status.ABORTED if Status.ABORTED in statuses else overall(statuses)


@dataclass
class Job:
    """A job that was started."""

    id: str
    name: str
    spark: SparkSession
    status: Status = Status.RUNNING
    result: Any = None
    counters: dict[str, int] = field(default_factory=dict)
    error: BaseException | None = None
    started: float = field(default_factory=time.time)
    _thread: threading.Thread | None = None
    _stop: threading.Event = field(default_factory=threading.Event)

    _held: DataFrame | None = None

    def wait(self, seconds: float | None = None) -> Job:
        if self._thread:
            self._thread.join(seconds)
        return self

    def abort(self) -> None:
        """Cancels the job's Spark jobs; it ends as aborted."""
        self._stop.set()
        self.spark.sparkContext.cancelJobGroup(self.id)


class Hooks:
    """What a user wants to be told of jobs, on the driver. An error in a hook before an attempt fails the job."""

    def started(self, job: Job) -> None: ...

    def attempt(self, job: Job, number: int) -> None: ...

    def ended(self, job: Job) -> None: ...


class Engine:
    """Starts jobs and remembers them."""

    def __init__(self, spark: SparkSession, hooks: Hooks | None = None, settings: Settings | None = None) -> None:
        self.settings, self.hooks = settings or Settings(), hooks or Hooks()
        self.spark, self.jobs = self.settings.session(spark) if self.settings.conf() else spark, {}

    def start(self, spec: JobSpec, attempts: int | None = None, done: Callable[[Job], None] | None = None, **counts: Column) -> Job:
        """Runs in a thread of its own. ``counts`` are summed over the result's rows while they are made.

        A spec without a sink leaves its rows as the result, held by Spark until the job is cleaned up, so they are
        made once.
        """
        attempts = attempts or self.settings.attempts
        job = Job(f"job-{uuid.uuid4().hex[:12]}", spec.name, self.spark)
        self.jobs[job.id] = job

        def run() -> None:
            self.spark.sparkContext.setJobGroup(job.id, spec.name, interruptOnCancel=True)  # of this thread alone
            try:
                self.hooks.started(job)
                for attempt in range(attempts):
                    try:
                        self.hooks.attempt(job, attempt)
                        rows, seen = observed(spec.build(self.spark), **counts)
                        if spec.sink:
                            job.result = spec.sink(rows)
                        else:
                            job.result = job._held = rows.persist()
                            job.result.write.format("noop").mode("overwrite").save()
                        job.counters = {k: v or 0 for k, v in seen.get.items()}
                        job.status = Status.SUCCESS
                        return
                    except Exception as error:
                        job.error = error
                        if job._stop.is_set() or isinstance(error, FailJob) or attempt + 1 == attempts:
                            raise
            except Exception:
                job.status = Status.ABORTED if job._stop.is_set() else Status.FAILED
            finally:
                self.hooks.ended(job)
                if done:
                    done(job)

        job._thread = threading.Thread(target=run, name=job.id, daemon=True)
        job._thread.start()
        return job

    def run(self, spec: JobSpec, **kwargs: Any) -> Job:
        return self.start(spec, **kwargs).wait()

    def chain(self, *specs: Callable[[Job | None], JobSpec]) -> list[Job]:
        """One job after another, each made from the one before; what fails ends the chain."""
        out: list[Job] = []
        for make in specs:
            out.append(self.run(make(out[-1] if out else None)))
            if out[-1].status is not Status.SUCCESS:
                break
        return out

    def listed(self, first: int = 0, n: int = 50) -> list[dict[str, Any]]:
        """A page of jobs, latest first."""
        by_time = sorted(self.jobs.values(), key=lambda j: -j.started)
        return [{"id": j.id, "name": j.name, "status": j.status.value, "started": j.started} for j in by_time[first : first + n]]

    def clean_up(self, job: Job, *files: str) -> None:
        """Forgets a job that has ended, frees the rows it holds and deletes ``files`` and folders it has left."""
        if job.status is Status.RUNNING:
            raise ValueError(f"{job.id} is still running")
        if job._held is not None:
            job._held.unpersist()
        conf, path = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for f in files:
            at = path(f)
            at.getFileSystem(conf).delete(at, True)
        self.jobs.pop(job.id, None)


def as_table(engine: Engine) -> DataFrame:
    rows = [(j["id"], j["name"], j["status"]) for j in engine.listed(0, len(engine.jobs))]
    return engine.spark.createDataFrame(rows, "id string, name string, status string")
