"""Table schemas inferred from dataclasses or Spark types, and rows as the JSON values such tables load."""

from __future__ import annotations

import dataclasses
import enum
import types
import typing
from datetime import date, datetime
from decimal import Decimal
from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCALARS = {str: "string", Decimal: "string", PurePath: "string", bool: "boolean", int: "integer", float: "float", datetime: "timestamp", date: "timestamp"}


class UnsupportedField(TypeError):
    """A field that no table column can hold."""


def table_schema(source: type | T.StructType) -> list[dict]:
    """Columns as {name, type, mode, fields, description}, absent entries left out.

    Of a dataclass, ``metadata`` may give name, description, mode and ignore; scalars that can't be None are
    required, lists are repeated, other dataclasses are records. Maps, bare or nested lists, unions of several
    types, abstract and cyclic classes are refused.
    """
    if isinstance(source, T.StructType):
        return [_of_type(f.name, f.dataType, f.nullable, f.metadata.get("comment")) for f in source.fields]
    return _of_class(source, ())


def spark_schema(fields: list[dict]) -> T.StructType:
    """The Spark schema that a table schema's rows load into, the inverse of ``table_schema`` as far as its types tell."""
    kinds = {"string": T.StringType(), "boolean": T.BooleanType(), "integer": T.LongType(), "float": T.DoubleType(), "timestamp": T.TimestampType()}

    def kind(f: dict) -> T.DataType:
        own = spark_schema(f["fields"]) if f["type"] == "record" else kinds[f["type"]]
        return T.ArrayType(own) if f.get("mode") == "repeated" else own

    return T.StructType([T.StructField(f["name"], kind(f), f.get("mode") != "required") for f in fields])


def _of_type(name: str, kind: T.DataType, nullable: bool, comment: str | None) -> dict:
    out: dict = {"name": name}
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.ArrayType, T.MapType)):
            raise UnsupportedField(f"{name}: nested collections")
        out |= _of_type(name, kind.elementType, True, None) | {"mode": "repeated"}
    elif isinstance(kind, T.StructType):
        out |= {"type": "record", "fields": table_schema(kind)}
    else:
        names = ((T.StringType, "string"), (T.DecimalType, "string"), (T.BooleanType, "boolean"), (T.IntegralType, "integer"), (T.FractionalType, "float"), (T.TimestampType, "timestamp"), (T.TimestampNTZType, "timestamp"), (T.DateType, "timestamp"))
        found = next((n for t, n in names if isinstance(kind, t)), None)
        if found is None:
            raise UnsupportedField(f"{name}: {kind.simpleString()}")
        out["type"] = found
    if not nullable and "mode" not in out:
        out["mode"] = "required"
    return out | ({"description": comment} if comment else {})


def _of_class(cls: type, above: tuple[type, ...]) -> list[dict]:
    if not dataclasses.is_dataclass(cls) or getattr(cls, "__abstractmethods__", None):
        raise UnsupportedField(f"{cls!r} is no concrete dataclass")
    if cls in above:
        raise UnsupportedField(f"{cls.__name__} contains itself")
    hints, out = typing.get_type_hints(cls), []
    for f in dataclasses.fields(cls):
        if not f.metadata.get("ignore"):
            column = _of_hint(f.metadata.get("name", f.name), hints[f.name], (*above, cls))
            column |= {k: f.metadata[k] for k in ("mode", "description") if k in f.metadata}
            out.append(column)
    return out


def _of_hint(name: str, hint: object, above: tuple[type, ...]) -> dict:
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) != 1:
            raise UnsupportedField(f"{name}: several types")
        return {k: v for k, v in _of_hint(name, rest[0], above).items() if (k, v) != ("mode", "required")}
    if origin in (list, tuple, set):
        element = args[0] if args else None
        if element is None or typing.get_origin(element) is not None:
            raise UnsupportedField(f"{name}: a collection of {element}")
        return _of_hint(name, element, above) | {"mode": "repeated"}
    if isinstance(hint, type) and dataclasses.is_dataclass(hint):
        return {"name": name, "type": "record", "fields": _of_class(hint, above)}
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        return {"name": name, "type": "string"}
    kind = next((n for t, n in _SCALARS.items() if isinstance(hint, type) and issubclass(hint, t)), None) if hint not in (bool,) else "boolean"
    if kind is None:
        raise UnsupportedField(f"{name}: {hint}")
    return {"name": name, "type": kind, **({"mode": "required"} if hint in (int, float, bool) else {})}


def json_value(column: Column, kind: T.DataType) -> Column:
    """A column as its JSON value has it: times as seconds with fractions, decimals as text, records and lists inside."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_millis(column.cast("timestamp")) / F.lit(1000.0)
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[json_value(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: json_value(x, kind.elementType))
    return column


def json_rows(rows: DataFrame) -> DataFrame:
    """(value): each row as one line of JSON, nulls left out; types that tables can't hold are refused first."""
    table_schema(rows.schema)
    return rows.select(F.to_json(F.struct(*[json_value(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields])).alias("value"))


def required(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows; a null in one of the columns fails the job when it runs."""
    for c in columns:
        rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"null in required column {c}")).cast(rows.schema[c].dataType)))
    return rows
