"""Grouping by key: whole groups, bounded groups, projections, folds, and the reducers that SQL aggregates express."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mapping import arrow_batches

#: Hashes are counted by their first 44 bits: 12 name one of 4,096 parts, 32 a slot of it.
SLOT_BITS, PART_BITS = 44, 12
#: Hashes that a task sorts and counts at a time, and the words of the largest filter (32 MB).
BLOCK, MOST_WORDS = 1 << 21, 1 << 22


def grouped(pairs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, values): each key once with its values in order. For keys whose values fit a task; else ``bounded_groups``."""
    return pairs.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def bounded_groups(pairs: DataFrame, most: int, key: str = "key", value: str = "value") -> DataFrame:
    """(key, chunk, values, partial): a key's values in order, at most so many a row; partial marks all but the last.

    Chunk numbers come from a running count, so no task ever holds a whole group as one array.
    """
    by_value = Window.partitionBy(key).orderBy(value)
    chunk = F.expr(f"cast((n - 1) div {most} as bigint)")
    numbered = pairs.withColumn("n", F.row_number().over(by_value)).withColumn("of", F.count("*").over(Window.partitionBy(key)))
    last = F.expr(f"cast((of - 1) div {most} as bigint)")
    rows = numbered.select(key, value, chunk.alias("chunk"), last.alias("last"))
    return rows.groupBy(key, "chunk", "last").agg(F.sort_array(F.collect_list(value)).alias("values")).select(key, "chunk", "values", (F.col("chunk") < F.col("last")).alias("partial"))


def size_bounded_groups(pairs: DataFrame, most_bytes: int, most: int = 100_000, key: str = "key", value: str = "value") -> DataFrame:
    """As ``bounded_groups``, a chunk also ending once its values but the first add up to ``most_bytes``.

    The count starts again with each chunk, which no window frame expresses; a task streams a sorted group through.
    A null value has no bytes and comes first; a null key is a key.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, now, chunk, size = [], None, 0, 0
        for batch in batches:
            for k, v in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if held and k != now:
                    yield now, chunk, held, False
                    held, chunk, size = [], 0, 0
                elif held and (len(held) >= most or size >= most_bytes):
                    yield now, chunk, held, True
                    held, chunk, size = [], chunk + 1, 0
                now = k
                size += len(v.encode()) if held and v is not None else 0
                held.append(v)
        if held:
            yield now, chunk, held, False

    rows = pairs.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    schema = T.StructType.fromDDL("key string, chunk long, values array<string>, partial boolean")
    return rows.repartition("key").sortWithinPartitions("key", "value").mapInArrow(lambda batches: arrow_batches(cut(batches), schema, 200), schema)


def keys_once(pairs: DataFrame, key: str = "key") -> DataFrame:
    return pairs.select(key).distinct()


def values_only(pairs: DataFrame, value: str = "value") -> DataFrame:
    return pairs.select(value)


def folded(pairs: DataFrame, zero: Column, merge: Callable[[Column, Column], Column], key: str = "key", value: str = "value") -> DataFrame:
    """(key, value): a fold given as expressions; for sums, counts, least and largest use SQL's own aggregates."""
    return pairs.groupBy(key).agg(F.aggregate(F.collect_list(value), zero, merge).alias(value))


def combined(pairs: DataFrame, combiner: Callable[[Any, list, list], Iterator], batch: int = 1000, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value): a user's fold ``combiner(key, new_values, combined_so_far)``, which yields what replaces both.

    Each task folds the values it reads, at most ``batch`` new ones at a time, before anything is shuffled; then what the
    tasks have of a key is folded as combined so far, without new values. So a hot key, of equal values or not, is
    folded by all tasks, and no task holds a group. Nulls are values and keys like any other.
    """

    def fold(rows: Iterator[tuple], new: bool) -> Iterator[tuple]:
        for k, own in groupby(rows, key=lambda r: r[0]):
            so_far: list = []
            values = (v for _, v in own)
            while some := list(islice(values, batch)):
                out = combiner(k, some, so_far) if new else combiner(k, [], so_far + some)
                if not hasattr(out, "__next__"):
                    raise TypeError("a combiner yields its values")
                so_far = list(out)
            yield from ((k, v) for v in so_far)

    schema = pairs.select(F.col(key).alias("key"), F.col(value).alias("value")).schema
    for f in schema:
        f.nullable = True
    rows = pairs.select(F.col(key).alias("key"), F.col(value).alias("value")).sortWithinPartitions("key")
    parts = rows.mapInArrow(lambda batches: arrow_batches(fold(_pairs_of(batches), True), schema), schema)
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: arrow_batches(fold(_pairs_of(batches), False), schema), schema)


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True)


def reduced(pairs: DataFrame, reducer: Callable[[Any, Iterator], Iterator[tuple]], schema: str, key: str = "key", value: str = "value") -> DataFrame:
    """A user's reducer ``reducer(key, values) -> rows``, for what no expression says. Values come in order, nulls first.

    Rows are sorted within tasks and streamed, so a group need not fit in memory. Keys and values are what they are in
    the table, integers of 64 bits and nulls included; a null key is a key.
    """
    kind = T.StructType.fromDDL(schema)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for k, own in groupby(_pairs_of(batches), key=lambda r: r[0]):
            yield from reducer(k, (v for _, v in own))

    rows = pairs.select(F.col(key).alias("key"), F.col(value).alias("value"))
    return rows.repartition("key").sortWithinPartitions("key", "value").mapInArrow(lambda batches: arrow_batches(rows_of(batches), kind), kind)


def nothing(df: DataFrame) -> DataFrame:
    """For jobs that must produce no row: any row fails the job when it runs."""
    first = df.columns[0]
    return df.where(F.assert_true(F.lit(False), F.lit("a row was written to an output that takes none")).isNotNull()).select(first)


def majority(pairs: DataFrame, least: int = 10, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value, n): the value that makes up more than half of a key's values, keys of ``least`` values or more.

    Only ``frequent`` keys are shuffled as they are; so ``pairs`` is evaluated twice and must give the same rows again.
    """
    counts = frequent(pairs, least, key).groupBy(key, value).agg(F.count("*").alias("n"))
    totals = counts.withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    return totals.where((F.col("total") >= least) & (F.col("n") > F.expr("total div 2"))).select(key, value, "n")


def frequent(rows: DataFrame, least: int, key: str = "key") -> DataFrame:
    """All rows whose key occurs ``least`` times or more, and few others: those whose key's hash falls in with another's.

    Most keys may be rare and long. So first only hashes are counted: each task sends its own in sorted blocks, some 4
    bytes a row, and the frequent ones make a filter of 2 to 4 bytes each that is broadcast. Over a table of more than
    16 million frequent keys it lets more of the others pass, but never misses one. A null key is a key. Hashes know no
    collation, so rows with a collated key all pass.
    """
    if least < 2 or " collate " in rows.schema[key].dataType.simpleString():
        return rows
    hashed = rows.withColumn("_slot", F.shiftrightunsigned(F.xxhash64(key), 64 - SLOT_BITS))
    blocks = hashed.select("_slot").mapInArrow(_slot_blocks, "part int, slots binary, counts binary")
    slots = blocks.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: _frequent_slots(batches, least), "slot long")
    words = slots.repartition(1).mapInArrow(_filter_words, "_words array<long>")
    bits = " | ".join(f"shiftleft(1L, cast(shiftright(_slot, {b}) & 63 as int))" for b in _FILTER_SHIFTS)
    word = F.expr("get(_words, cast(_slot & (size(_words) - 1) as int))")
    # an inner join with the one row: a semi join would be pushed below the hash and evaluate it again for each use
    return hashed.withColumn("_bits", F.expr(bits)).join(F.broadcast(words), word.bitwiseAND(F.col("_bits")) == F.col("_bits")).drop("_slot", "_bits", "_words")


#: A slot's word in the filter is its last bits; its three bits there are numbered by six bits each from these on.
_FILTER_SHIFTS = (24, 30, 36)


def _slot_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, slots, counts) of every block of a task's hashes: a part's slots in order, four bytes each, and their counts."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(batch.column(0).to_numpy())
        if sum(map(len, held)) >= BLOCK:
            yield _slot_block(np.concatenate(held))
            held = []
    if held:
        yield _slot_block(np.concatenate(held))


def _slot_block(slots: np.ndarray) -> pa.RecordBatch:
    slots, counts = np.unique(slots, return_counts=True)
    parts, starts = np.unique(slots >> (SLOT_BITS - PART_BITS), return_index=True)
    cut = lambda x: pa.array([own.tobytes() for own in np.split(x.astype("<u4"), starts[1:])][: len(parts)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), cut(slots), cut(counts)], ["part", "slots", "counts"])


def _frequent_slots(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The slots that were counted ``least`` times or more, of blocks in the order of their parts."""
    blocks = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for part, own in groupby(blocks, key=lambda r: r[0]):
        _, slots, counts = zip(*own, strict=True)
        slots, counts = (np.frombuffer(b"".join(x), "<u4") for x in (slots, counts))
        order = np.argsort(slots)
        slots = slots[order]
        starts = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
        found = slots[starts[np.add.reduceat(counts[order].astype(np.int64), starts) >= least]]
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64) | part << (SLOT_BITS - PART_BITS))], ["slot"])


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the words of a Bloom filter of all slots, each slot's bits in one word, 2 to 4 slots a word."""
    slots = np.concatenate([np.empty(0, np.int64), *(batch.column(0).to_numpy() for batch in batches)])
    words = np.zeros(min(MOST_WORDS, 1 << (len(slots) // 4).bit_length()), np.int64)
    for shift in _FILTER_SHIFTS:
        np.bitwise_or.at(words, slots & (len(words) - 1), np.left_shift(np.int64(1), slots >> shift & 63))
    yield pa.RecordBatch.from_arrays([pa.array([words], pa.list_(pa.int64()))], ["_words"])


def collisions(pairs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, values) of keys with more than one value."""
    repeated = pairs.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"), F.count("*").alias("n"))
    return repeated.where("n > 1").select(key, "values")
