"""Table scans: filters given as triples, checked and pushed into the scan; keys only; namespaces; time ranges."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import pair_column, pair_columns
from ..operators import splits

OPS = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
Filter = tuple[str, str, Any]


class BadScanParams(ValueError):
    """A scan that can't be run as it is described."""


@dataclass(frozen=True)
class ScanSpec:
    """What to read of a table: filters joined by AND, one namespace or all, all columns or only the key."""

    key: str
    filters: Sequence[Filter] = field(default_factory=tuple)
    namespace: str | None = None
    namespace_column: str | None = None
    keys_only: bool = False
    equality_only: bool = False

    @classmethod
    def of(cls, params: dict[str, Any]) -> ScanSpec:
        """From a mapping; names that a scan doesn't know are refused."""
        unknown = set(params) - set(cls.__dataclass_fields__)
        if unknown:
            raise BadScanParams(f"unknown parameters: {', '.join(sorted(unknown))}")
        return cls(**params)


def check_filters(schema: T.StructType, filters: Sequence[Filter], equality_only: bool = False) -> None:
    """Each filter names a column of the table, an operator among OPS and a value that the column's type can hold."""
    for f in filters:
        if not (isinstance(f, (tuple, list)) and len(f) == 3):
            raise BadScanParams(f"a filter is (column, operator, value), not {f!r}")
        name, op, value = f
        if op not in OPS:
            raise BadScanParams(f"operator {op!r} is none of {' '.join(OPS)}")
        if equality_only and op != "=":
            raise BadScanParams(f"only equality filters are allowed here, not {op}")
        if name not in schema.names:
            raise BadScanParams(f"no column {name!r}")
        kind = schema[name].dataType
        good = {T.StringType: str, T.BooleanType: bool, T.IntegralType: int, T.FractionalType: (int, float), T.TimestampType: datetime, T.TimestampNTZType: datetime, T.DateType: date, T.BinaryType: (bytes, bytearray)}
        allowed = next((v for k, v in good.items() if isinstance(kind, k)), None)
        if allowed is not None and (not isinstance(value, allowed) or (isinstance(value, bool) and allowed is not bool)):
            raise BadScanParams(f"{value!r} is no value of column {name!r}")


def predicate(filters: Sequence[Filter]) -> Column:
    return reduce(operator.and_, (OPS[op](F.col(name), F.lit(value)) for name, op, value in filters), F.lit(True))


def scan(table: DataFrame, spec: ScanSpec) -> DataFrame:
    """The rows that pass the filters. Filters and columns reach the file scan; nothing is evaluated in Python."""
    check_filters(table.schema, spec.filters, spec.equality_only)
    if (spec.namespace is not None) and spec.namespace_column is None:
        raise BadScanParams("a namespace needs its column")
    out = table
    if spec.namespace is not None:
        out = out.where(F.col(spec.namespace_column) == spec.namespace)
    if spec.filters:
        out = out.where(predicate(spec.filters))
    return out.select(spec.key) if spec.keys_only else out


@dataclass(frozen=True)
class PropertyRange:
    """The one closed range among a scan's filters, and the equality filters beside it."""

    column: str
    low: Any
    low_open: bool
    high: Any
    high_open: bool
    equalities: tuple[Filter, ...]

    @classmethod
    def from_filters(cls, schema: T.StructType, filters: Sequence[Filter]) -> PropertyRange | None:
        """None without inequalities; an error unless they bound exactly one column, once on each side, low under high."""
        check_filters(schema, filters)
        bounds = [f for f in filters if f[1] != "="]
        if not bounds:
            return None
        if len({f[0] for f in bounds}) > 1:
            raise BadScanParams("inequalities on more than one column")
        low, high = [f for f in bounds if f[1] in (">", ">=")], [f for f in bounds if f[1] in ("<", "<=")]
        if len(low) != 1 or len(high) != 1:
            raise BadScanParams("a range needs one lower and one upper bound")
        if not low[0][2] < high[0][2]:
            raise BadScanParams("the range's lower bound isn't under its upper one")
        return cls(bounds[0][0], low[0][2], low[0][1] == ">", high[0][2], high[0][1] == "<", tuple(f for f in filters if f[1] == "="))

    def filters(self) -> list[Filter]:
        return [(self.column, ">" if self.low_open else ">=", self.low), (self.column, "<" if self.high_open else "<=", self.high), *self.equalities]

    def split(self, n: int) -> list[list[Filter]]:
        """The filters of at most n sub-ranges that together hold the same rows, each once."""
        if isinstance(self.low, float) or isinstance(self.high, float):
            inner = splits.split_floats(self.low, self.high, n)
            ops = [(">" if self.low_open else ">=", self.low), *((">=", p) for p in inner)]
            ends = [*(("<", p) for p in inner), ("<" if self.high_open else "<=", self.high)]
            return [[(self.column, *a), (self.column, *b), *self.equalities] for a, b in zip(ops, ends, strict=True)]
        points = splitter(self.low)(self.low, self.high, n, not self.low_open, not self.high_open)
        return [[(self.column, ">=", a), (self.column, "<", b), *self.equalities] for a, b in zip(points, points[1:], strict=False)]

    def shard_of(self, n: int) -> Column:
        """The number of the sub-range a row falls in, as an expression."""
        out = F.lit(None).cast("int")
        for i, filters in enumerate(self.split(n)):
            out = F.when(predicate(filters[:2]), i).otherwise(out)
        return out


def splitter(value: Any):  # noqa: ANN201
    if isinstance(value, bool) or not isinstance(value, (int, str, datetime)):
        raise BadScanParams(f"ranges of {type(value).__name__} can't be split")
    return splits.split_ints if isinstance(value, int) else splits.split_strings if isinstance(value, str) else splits.split_datetimes


def completed_range(table: DataFrame, column: str, filters: Sequence[Filter]) -> DataFrame:
    """(low, high): a range's bounds, those that the filters leave open taken from the rows that pass."""
    return table.where(predicate(filters)).agg(F.min(column).alias("low"), F.max(column).alias("high"))


def range_sharded(table: DataFrame, filters: Sequence[Filter], shards: int, oversplit: int = 1) -> DataFrame:
    """The rows of a closed range with the shard that reads them: sub-ranges go to shards in turn when oversplit."""
    found = PropertyRange.from_filters(table.schema, filters)
    if found is None:
        raise BadScanParams("no range among the filters")
    return table.where(predicate(found.filters())).withColumn("shard", found.shard_of(shards * oversplit) % shards)


def namespaces(table: DataFrame, column: str) -> DataFrame:
    """The distinct namespaces, in order."""
    return table.select(F.col(column).alias("namespace")).distinct().orderBy("namespace")


def log_range(logs: DataFrame, time: str, start: datetime, end: datetime, equals: dict[str, Sequence[Any]] | None = None) -> DataFrame:
    """Log rows of [start, end), and of the given values in other columns; both bounds are needed, start first."""
    if not start < end:
        raise BadScanParams("a log range starts before it ends")
    out = logs.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))
    for column, values in (equals or {}).items():
        out = out.where(F.col(column).isin(list(values)))
    return out


#: Levels of log lines, least first.
LEVELS = ("debug", "info", "warning", "error", "critical")


def log_scan(logs: DataFrame, start: datetime, end: datetime, least_level: str | None = None, with_incomplete: bool = False, versions: Sequence[str] | None = None, module_versions: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Logs of [start, end) by columns ``time``, ``level``, ``finished``, ``version`` and ``module``.

    Lines of ``least_level`` or above; records that haven't finished only ``with_incomplete``; of the given versions of
    the default module or of the given (module, version) pairs, not both. Nulls of level or finished don't pass.
    """
    if (versions is not None) and (module_versions is not None):
        raise BadScanParams("give versions or pairs of module and version, not both")
    out = log_range(logs, "time", start, end)
    if least_level is not None:
        if least_level not in LEVELS:
            raise BadScanParams(f"level {least_level!r} is none of {' '.join(LEVELS)}")
        out = out.where(F.col("level").isin(list(LEVELS[LEVELS.index(least_level) :])))
    if not with_incomplete:
        out = out.where("finished")
    if versions is not None:
        out = out.where((F.col("module") == "default") & F.col("version").isin(list(versions)))
    if module_versions is not None:
        out = out.where(reduce(operator.or_, ((F.col("module") == m) & (F.col("version") == v) for m, v in module_versions), F.lit(False)))
    return out


def in_ranges(table: DataFrame, key: str, ranges: Sequence[tuple[Any, Any]]) -> DataFrame:
    """The rows whose key lies in one of the half-open ranges, once each, with the number of the first; None leaves a side open."""
    shard = F.lit(None).cast("int")
    for i in range(len(ranges) - 1, -1, -1):
        low, high = ranges[i]
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col(key) >= F.lit(low))
        if high is not None:
            inside = inside & (F.col(key) < F.lit(high))
        shard = F.when(inside, i).otherwise(shard)
    return table.withColumn("range", shard).where(F.col(key).isNotNull() & F.col("range").isNotNull())


def as_messages(table: DataFrame, key: str) -> DataFrame:
    """(message): each row in a binary form of its own, its key and all of it as JSON; ``of_messages`` reads it back."""
    return table.select(pair_column(F.col(key).cast("string"), F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"})).alias("message"))


def of_messages(messages: DataFrame, schema: T.StructType) -> DataFrame:
    value = pair_columns(F.col("message"))["value"].cast("string")
    return messages.select(F.from_json(value, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def scatter_points(table: DataFrame, key: str, n: int, oversample: int = 32) -> list:
    """At most n - 1 keys that cut a table into near-equal parts, from a bounded sample in hashed order."""
    picked = sorted(r[0] for r in table.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(oversample * n).collect())
    if len(picked) < n:
        return picked
    return sorted({picked[round(len(picked) * i / n)] for i in range(1, n)})


def concatenated(*tables: DataFrame) -> DataFrame:
    """Everything of every input, one after another; what is listed twice is read twice."""
    return reduce(DataFrame.unionByName, tables)
