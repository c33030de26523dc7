"""Settings of jobs, and what they are in Spark's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import SparkSession

from .spec import MOST_REDUCERS, BadSpec


@dataclass(frozen=True)
class Settings:
    """How a job runs. None leaves Spark's own setting as it is.

    ``shards`` are the tasks after a shuffle, ``split_bytes`` the most of a file that a map task reads, ``batch_rows`` the
    rows of a slice that Python code gets at a time, ``attempts`` those of a whole job (Spark retries tasks itself, by
    ``spark.task.maxFailures`` of the cluster), ``folder`` where its files are put.
    """

    shards: int | None = None
    split_bytes: int | None = None
    batch_rows: int | None = None
    attempts: int = 1
    folder: str | None = None

    def __post_init__(self) -> None:
        for name in ("shards", "split_bytes", "batch_rows", "attempts"):
            value = getattr(self, name)
            if value is not None and (not isinstance(value, int) or isinstance(value, bool) or value < 1):
                raise BadSpec(f"{name} must be a positive number, not {value!r}")
        if self.shards is not None and self.shards > MOST_REDUCERS:
            raise BadSpec(f"shards must be at most {MOST_REDUCERS}")

    @classmethod
    def of(cls, values: dict[str, Any]) -> Settings:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise BadSpec(f"no such settings: {', '.join(sorted(unknown))}")
        return cls(**values)

    def conf(self) -> dict[str, str]:
        both = {"spark.sql.shuffle.partitions": self.shards, "spark.sql.files.maxPartitionBytes": self.split_bytes, "spark.sql.execution.arrow.maxRecordsPerBatch": self.batch_rows}
        return {k: str(v) for k, v in both.items() if v is not None}

    def session(self, spark: SparkSession) -> SparkSession:
        """A session of the same application with these settings; the one given keeps its own."""
        own = spark.newSession()
        for k, v in self.conf().items():
            own.conf.set(k, v)
        return own
