"""Job specifications: a description of source, mapper, key, reducer and sink that builds one DataFrame plan."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.mapping import mapped, named

MOST_REDUCERS = 2048

Step = Callable[[DataFrame], DataFrame]


class BadSpec(ValueError):
    """A job that can't be run as described."""


@dataclass(frozen=True)
class JobSpec:
    """A job: rows from ``source``, mapped, grouped by ``keys`` into ``aggregates`` (or ``reduce``), put into ``sink``.

    Without keys and reduce it is map-only and plans no shuffle. Nothing runs until an action on ``build``'s result.
    """

    name: str
    source: Callable[[SparkSession], DataFrame]
    mapper: Step | None = None
    keys: tuple[str, ...] = ()
    aggregates: tuple[Column, ...] = ()
    reduce: Step | None = None
    reducers: int | None = None
    sink: Callable[[DataFrame], Any] | None = None
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.name:
            raise BadSpec("a job needs a name")
        if self.reducers is not None and not 1 <= self.reducers <= MOST_REDUCERS:
            raise BadSpec(f"reducers must be 1 to {MOST_REDUCERS}")
        if self.aggregates and not self.keys:
            raise BadSpec("aggregates need keys")
        if self.aggregates and self.reduce:
            raise BadSpec("give aggregates or a reduce step, not both")

    def build(self, spark: SparkSession) -> DataFrame:
        rows = self.source(spark)
        if self.mapper:
            rows = self.mapper(rows)
        if self.keys and self.reducers:
            rows = rows.repartition(self.reducers, *self.keys)  # the aggregation below needs no further exchange
        if self.aggregates:
            rows = rows.groupBy(*self.keys).agg(*self.aggregates)
        elif self.keys and not self.reduce:
            rows = rows.groupBy(*self.keys).agg()
        return self.reduce(rows) if self.reduce else rows

    def with_params(self, **params: Any) -> JobSpec:
        return replace(self, params={**self.params, **params})


def registry(configs: list[dict[str, Any]] | str) -> dict[str, dict[str, Any]]:
    """Named job configurations with user parameters: unique names, a mapper each, defaults filled in.

    A list, or a text of YAML (or JSON, where no YAML parser is installed) with the list under its one key.
    """
    if isinstance(configs, str):
        configs = _parsed(configs)
    out: dict[str, dict[str, Any]] = {}
    for c in configs:
        unknown = set(c) - {"name", "mapper", "params", "done", "validator"}
        if unknown or not c.get("name") or not c.get("mapper"):
            raise BadSpec(f"a configuration has name, mapper, params, validator and done; this one: {sorted(c)}")
        if c["name"] in out:
            raise BadSpec(f"{c['name']!r} is there twice")
        params = {}
        for p in c.get("params", []):
            if "name" not in p:
                raise BadSpec(f"a parameter of {c['name']!r} has no name")
            params[p["name"]] = p.get("value", p.get("default"))
        out[c["name"]] = {**c, "params": params}
    return out


def _parsed(text: str) -> list[dict[str, Any]]:
    try:
        import yaml
    except ImportError:
        yaml = None
    try:
        found = yaml.safe_load(text) if yaml else json.loads(text)
    except Exception as error:
        raise BadSpec(f"the configuration can't be read: {error}") from error
    lists = list(found.values()) if isinstance(found, dict) else []
    if len(lists) != 1 or not isinstance(lists[0], list):
        raise BadSpec("a configuration has one key, and under it a list of jobs")
    return lists[0]


def bound(config: dict[str, Any], source: Callable[[SparkSession], DataFrame], schema: str, sink: Callable[[DataFrame], Any] | None = None, **params: Any) -> JobSpec:
    """The map-only job of a registered configuration: its mapper looked up by name, its parameters checked by its validator.

    ``params`` replace configured ones; names that the configuration doesn't have are refused.
    """
    unknown = set(params) - set(config["params"])
    if unknown:
        raise BadSpec(f"{config['name']!r} has no parameters {', '.join(sorted(unknown))}")
    own = {**config["params"], **params}
    missing = sorted(k for k, v in own.items() if v is None)
    if missing:
        raise BadSpec(f"{config['name']!r} needs {', '.join(missing)}")
    if config.get("validator"):
        named(config["validator"])(own)
    handler = named(config["mapper"])
    return JobSpec(config["name"], source=source, mapper=lambda rows: mapped(rows, handler, schema), sink=sink, params=own)
