"""Readers and writers of users' own: split, validate, resume, through Spark's Python data sources.

A reader splits its parameters into shards; each shard is one task. Its state is JSON, so a shard can be taken up again
where another run left it. A writer gets one shard's rows; what it names as its output counts once the job has ended.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


class BadReader(ValueError):
    """Parameters that a reader or writer refuses."""


class InputReader(ABC):
    """One shard of an input. ``schema`` is that of its rows; ``state`` must make the same reader again, also midway."""

    schema: str

    @classmethod
    def validate(cls, params: dict[str, Any]) -> None:  # noqa: B027
        """Raises BadReader for parameters it can't read."""

    @classmethod
    @abstractmethod
    def split(cls, params: dict[str, Any], shards: int) -> list[InputReader]:
        """At most ``shards`` readers that together give every row once."""

    @abstractmethod
    def __iter__(self) -> Iterator[tuple]: ...

    @abstractmethod
    def state(self) -> dict[str, Any]: ...

    @classmethod
    @abstractmethod
    def resumed(cls, state: dict[str, Any]) -> InputReader: ...


class OutputWriter(ABC):
    """One attempt at one shard of an output. Only what ``finish`` names and ``commit`` gets is part of the output."""

    @classmethod
    def validate(cls, params: dict[str, Any]) -> None:  # noqa: B027
        """Raises BadReader for parameters it can't write by."""

    @abstractmethod
    def begin(self, params: dict[str, Any], shard: int, attempt: int) -> None: ...

    @abstractmethod
    def write(self, row: tuple) -> None: ...

    @abstractmethod
    def finish(self) -> Any:
        """Closes the shard and names what it wrote, as JSON can hold it."""

    @classmethod
    def commit(cls, params: dict[str, Any], written: list[Any]) -> None:  # noqa: B027
        """On the driver, once all shards have finished."""

    @classmethod
    def abort(cls, params: dict[str, Any], written: list[Any]) -> None:  # noqa: B027
        """On the driver, if the job failed; removes what finished shards have left."""


@dataclass
class _Shard(InputPartition):
    state: str


def _packed(kind: type) -> str:
    return cloudpickle.dumps(kind).hex()


def _kind(options: dict) -> type:
    return cloudpickle.loads(bytes.fromhex(options["kind"]))


class _Read(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.kind, self.states = _kind(options), json.loads(options["states"])

    def partitions(self) -> list[InputPartition]:
        return [_Shard(json.dumps(s)) for s in self.states]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        yield from self.kind.resumed(json.loads(partition.state))


@dataclass
class _Done(WriterCommitMessage):
    what: Any


class _Write(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.kind, self.params = _kind(options), json.loads(options["params"])

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        own, task = self.kind(), TaskContext.get()
        own.begin(self.params, task.partitionId(), task.attemptNumber())
        for row in rows:
            own.write(tuple(row))
        return _Done(own.finish())

    def commit(self, messages: list) -> None:
        self.kind.commit(self.params, [m.what for m in messages if m is not None])

    def abort(self, messages: list) -> None:
        self.kind.abort(self.params, [m.what for m in messages if m is not None])


class _Users(DataSource):
    @classmethod
    def name(cls) -> str:
        return "users"

    def schema(self) -> str:
        return _kind(self.options).schema

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Read(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Write(self.options)


def read(spark: SparkSession, reader: type[InputReader], params: dict[str, Any], shards: int = 8, states: list[dict] | None = None) -> DataFrame:
    """The rows of a user's reader; of the shards in ``states`` instead, where a run is taken up again."""
    reader.validate(params)
    if states is None:
        if shards < 1:
            raise BadReader("shards must be positive")
        states = [r.state() for r in reader.split(params, shards)]
        if len(states) > shards:
            raise BadReader(f"{reader.__name__} made {len(states)} readers for {shards} shards")
    if not states:
        return spark.createDataFrame([], reader.schema)
    spark.dataSource.register(_Users)
    return spark.read.format("users").options(kind=_packed(reader), states=json.dumps(states)).load()


def write(rows: DataFrame, writer: type[OutputWriter], params: dict[str, Any]) -> None:
    """Hands each partition's rows to a writer of the user's."""
    writer.validate(params)
    rows.sparkSession.dataSource.register(_Users)
    rows.write.format("users").mode("append").options(kind=_packed(writer), params=json.dumps(params)).save()
