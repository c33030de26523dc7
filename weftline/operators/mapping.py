"""Mappers: expressions where they can say it, users' Python over Arrow batches with life-cycle hooks otherwise."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def identity(pairs: DataFrame) -> DataFrame:
    return pairs.select("key", "value")


def keyed(rows: DataFrame, key: Column) -> DataFrame:
    """(key, value): the key with a null value."""
    return rows.select(key.alias("key"), F.lit(None).cast("string").alias("value"))


def flat(rows: DataFrame, *items: Column) -> DataFrame:
    """One output row for each item that isn't null."""
    return rows.select(F.explode(F.array_compact(F.array(*items))).alias("item"))


class Mapper:
    """A user's mapper. A task is a shard; its batches are its slices."""

    def begin_shard(self, context: Context) -> None: ...

    def end_shard(self, context: Context) -> None: ...

    def begin_slice(self, context: Context) -> None: ...

    def end_slice(self, context: Context) -> None: ...

    def __call__(self, context: Context, row: dict) -> None:
        raise NotImplementedError


class Context:
    """What a mapper sees of its task: its shard's number and attempt, counters, and where to put results."""

    def __init__(self, counters: Any = None) -> None:
        from pyspark import TaskContext

        task = TaskContext.get()
        self.shard, self.attempt = (task.partitionId(), task.attemptNumber()) if task else (0, 0)
        self.rows: list[tuple] = []
        self._counters = counters

    def emit(self, *row: Any) -> None:
        self.rows.append(row)

    def count(self, name: str, by: int = 1) -> None:
        if self._counters is not None:
            self._counters.add({name: by})


def arrow_batches(rows: Iterable[tuple], schema: T.StructType, at_once: int = 5000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a Spark schema: values keep their type, where pandas would make doubles of nullable integers."""
    kind, rows = to_arrow_schema(schema), iter(rows)
    while some := list(islice(rows, at_once)):
        columns = list(zip(*some, strict=True))
        if len(columns) != len(kind):
            raise ValueError(f"a row of {len(columns)} values for {len(kind)} columns")
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)


def _run(batches: Iterator[pa.RecordBatch], handler: Any, hooks: bool, context: Context) -> Iterator[tuple]:
    """What a handler emits for the rows of a task, slice by slice. Whether it has hooks is seen on the driver: here its class may be a copy."""
    own = handler if hooks else None
    if own:
        own.begin_shard(context)
    for batch in batches:
        if own:
            own.begin_slice(context)
        for row in batch.to_pylist():
            if own:
                own(context, row)
            else:
                context.rows.extend(handler(row) or ())
        if own:
            own.end_slice(context)
        yield from context.rows
        context.rows = []
    if own:
        own.end_shard(context)
        yield from context.rows


def mapped(rows: DataFrame, mapper: Mapper | Callable[[dict], Iterator[tuple]] | str, schema: str, counters: Any = None) -> DataFrame:
    """Runs a mapper over all rows. A function yields tuples of the schema; a name like ``package.module.thing`` is looked up.

    A row is a dictionary of what the table has, integers of 64 bits and nulls included.
    """
    handler, kind = named(mapper) if isinstance(mapper, str) else mapper, T.StructType.fromDDL(schema)
    hooks = isinstance(handler, Mapper)
    return rows.mapInArrow(lambda batches: arrow_batches(_run(batches, handler, hooks, Context(counters)), kind), kind)


def mapped_to(rows: DataFrame, mapper: Mapper | Callable[[dict], Iterator[tuple]], outputs: dict[str, str], counters: Any = None) -> DataFrame:
    """A mapper with side outputs: each row it yields begins with the name of its output, the rest is that output's row.

    ``outputs`` gives each output's schema. The result has ``output`` and a struct for each; write it once, partitioned
    by ``output``, and take the parts with ``output_of``, so that the mapper runs once for all of them.
    """
    kinds = {name: T.StructType.fromDDL(schema) for name, schema in outputs.items()}
    whole = T.StructType([T.StructField("output", T.StringType()), *(T.StructField(n, k) for n, k in kinds.items())])
    place = {name: i for i, name in enumerate(kinds)}

    def spread(found: Iterator[tuple]) -> Iterator[tuple]:
        for name, *row in found:
            if name not in place:
                raise ValueError(f"no output is called {name!r}")
            yield (name, *(dict(zip(kinds[n].names, row, strict=True)) if n == name else None for n in kinds))

    hooks = isinstance(mapper, Mapper)
    return rows.mapInArrow(lambda batches: arrow_batches(spread(_run(batches, mapper, hooks, Context(counters))), whole), whole)


def output_of(both: DataFrame, name: str) -> DataFrame:
    """One output's rows of ``mapped_to``."""
    return both.where(F.col("output") == name).select(f"{name}.*")


def named(path: str) -> Any:
    """The function, or an instance of the class, of a dotted name."""
    module, _, name = path.rpartition(".")
    try:
        found = getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as error:
        raise ValueError(f"nothing is called {path!r}") from error
    return found() if isinstance(found, type) else found
