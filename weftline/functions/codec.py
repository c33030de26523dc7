"""Wire forms of pairs and groups, typed JSON, and ids that sort latest first."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of the length-delimited fields of a message."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(data):
                raise ValueError("the message ends early")
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, _varint(number())
            continue
        if tag & 7 != 2:
            raise ValueError(f"a field of wire type {tag & 7}")
        size = number()
        if at + size > len(data):
            raise ValueError("the message ends early")
        yield tag >> 3, data[at : at + size]
        at += size


def pair_bytes(key: bytes, value: bytes) -> bytes:
    """A message of a key (1) and a value (2)."""
    return b"\x0a" + _varint(len(key)) + key + b"\x12" + _varint(len(value)) + value


def pair_of(data: bytes) -> tuple[bytes, bytes]:
    found = dict(_fields(data))
    return found.get(1, b""), found.get(2, b"")


def group_bytes(key: bytes, values: list[bytes], partial: bool = False) -> bytes:
    """A message of a key (1), its values (2, repeated) and whether more of them follow (3)."""
    return b"\x0a" + _varint(len(key)) + key + b"".join(b"\x12" + _varint(len(v)) + v for v in values) + (b"\x18\x01" if partial else b"")


def group_of(data: bytes) -> tuple[bytes, list[bytes], bool]:
    key, values, partial = b"", [], False
    for n, v in _fields(data):
        if n == 1:
            key = v
        elif n == 2:
            values.append(v)
        elif n == 3:
            partial = v != b"\0"
    return key, values, partial


def pair_column(key: Column, value: Column) -> Column:
    """Pairs as messages, batch by batch."""

    @F.pandas_udf("binary")
    def encode(keys: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([pair_bytes(bytes(k or b""), bytes(v or b"")) for k, v in zip(keys, values, strict=True)])

    return encode(key.cast("binary"), value.cast("binary"))


def pair_columns(message: Column) -> Column:
    """struct<key, value> of messages."""

    @F.pandas_udf("key binary, value binary")
    def decode(messages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pair_of(bytes(m)) for m in messages], columns=["key", "value"])

    return decode(message)


def group_columns(message: Column) -> Column:
    """struct<key, values, partial> of groups' messages."""

    @F.pandas_udf("key binary, values array<binary>, partial boolean")
    def decode(messages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([group_of(bytes(m)) for m in messages], columns=["key", "values", "partial"])

    return decode(message)


class Marshaller:
    """A user's form of values: ``encode`` to bytes and ``decode`` back, applied batch by batch on executors."""

    def encode(self, value: Any) -> bytes:
        raise NotImplementedError

    def decode(self, data: bytes) -> Any:
        raise NotImplementedError


def marshalled(value: Column, marshaller: Marshaller) -> Column:
    """A column in a marshaller's bytes; nulls stay."""

    @F.arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else marshaller.encode(v) for v in values.to_pylist()], pa.binary())

    return encode(value)


def unmarshalled(data: Column, marshaller: Marshaller, kind: str) -> Column:
    own = to_arrow_type(T.DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def decode(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else marshaller.decode(v) for v in values.to_pylist()], own)

    return decode(data)


def dumps(value: Any) -> str:
    """JSON in which datetimes keep their type and microseconds."""
    return json.dumps(value, default=lambda x: {"__datetime__": x.isoformat()} if isinstance(x, datetime) else {"__set__": sorted(x)} if isinstance(x, (set, frozenset)) else _refuse(x))


def _refuse(x: Any) -> None:
    raise TypeError(f"{type(x).__name__} has no JSON form here")


def loads(text: str) -> Any:
    def back(d: dict) -> Any:
        return datetime.fromisoformat(d["__datetime__"]) if "__datetime__" in d else set(d["__set__"]) if "__set__" in d else d

    return json.loads(text, object_hook=back)


def descending_id(now: float | None = None, suffix: str = "") -> str:
    """An id by which later jobs sort first."""
    return f"{(1 << 53) - int((time.time() if now is None else now) * 1_000_000):016d}{suffix}"
