"""Counters: named sums, observed beside a job's rows or added to by user code."""

from __future__ import annotations

from pyspark import AccumulatorParam, SparkContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class _Sums(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:  # noqa: N802
        for k, v in b.items():
            a[k] = a.get(k, 0) + v
        return a


def user_counters(sc: SparkContext):  # noqa: ANN201
    """Counters of any name for user code; a task that runs twice counts twice, so prefer ``observed``."""
    return sc.accumulator({}, _Sums())


def observed(rows: DataFrame, **sums: Column) -> tuple[DataFrame, Observation]:
    """The rows, and counts taken while they are made: exact, at no further pass. ``rows`` is always counted."""
    seen = Observation()
    found = [F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in sums.items()]]
    return rows.observe(seen, *found), seen


def summary(rows: DataFrame, **sums: Column) -> DataFrame:
    """(name, value): the same counts as a table, in one pass."""
    one = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in sums.items()])
    names = ["rows", *sums]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("value")) for n in names])).alias("c")).select("c.*")


def merged(*counts: dict[str, int]) -> dict[str, int]:
    out: dict[str, int] = {}
    for c in counts:
        for k, v in c.items():
            out[k] = out.get(k, 0) + v
    return out
