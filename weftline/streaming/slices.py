"""Resumable runs: a growing folder read in bounded slices with checkpoints, and folds whose state outlives them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType


def sliced(spark: SparkSession, path: str, schema: StructType, files_a_slice: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream of at most so many files a slice."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_slice).parquet(path)


def run_available(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Takes all that is there, slice by slice, and stops; run again, it goes on after the last finished slice.

    ``each(slice, number)`` must be idempotent by number: a slice that was cut off is given again.
    """
    query = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def running_counts(rows: DataFrame, key: str, checkpoint: str, name: str) -> None:
    """Counts by key kept across slices and runs in the stream's state; the table ``name`` has the last ones."""
    query = rows.groupBy(key).agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def running_fold(rows: DataFrame, fold: Callable[[Any, list, list], Iterator], value_type: str, checkpoint: str, each: Callable[[DataFrame, int], None], key: str = "key", value: str = "value") -> int:
    """A user's fold ``fold(key, new_values, combined_so_far)`` whose state outlives slices and runs.

    ``each(rows, number)`` gets (key, value) of the keys that a slice changed: all that is combined of them so far. The
    state is kept by key in the stream's checkpoint, so a run that was cut off goes on from its last finished slice.
    """
    pairs = rows.select(F.col(key).alias("key"), F.col(value).alias("value"))
    key_type = pairs.schema["key"].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        so_far = list(state.get[0]) if state.exists else []
        for batch in batches:
            so_far = list(fold(k[0], batch["value"].tolist(), so_far))
        state.update((so_far,))
        yield pd.DataFrame({"key": [k[0]] * len(so_far), "value": so_far})

    found = pairs.groupBy("key").applyInPandasWithState(step, f"key {key_type}, value {value_type}", f"v array<{value_type}>", "update", "NoTimeout")
    query = found.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)
