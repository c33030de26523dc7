"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    """White space collapsed, then cut at ``.``, ``?``, ``!`` and backslashes; empty pieces stay."""
    return F.split(F.regexp_replace(text, r"\s+", " "), r"[\\.?!]", -1)


def words(text: Column) -> Column:
    """Lower-case words: runs of ASCII letters; anything else separates."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def spaced(phrase: Column, joint: str = ":") -> Column:
    """A phrase with spaces where its words were joined."""
    return F.replace(phrase, F.lit(joint), F.lit(" "))


def phrases(parts: Column, n: int = 4, joint: str = ":") -> Column:
    """n-grams of an array of words. The last n-gram is left out; fewer than n words give one phrase of them all."""
    return F.transform(phrase_starts(parts, n), lambda i: phrase_at(parts, i, n, joint))


def phrase_starts(parts: Column, n: int = 4) -> Column:
    """Where the ``phrases`` of an array of words start. Exploded, they are far cheaper to join than in the array."""
    none = F.array().cast("array<int>")
    return F.when(F.size(parts) < n, F.array(F.lit(0))).when(F.size(parts) > n, F.sequence(F.lit(0), F.size(parts) - n - 1)).otherwise(none)


def phrase_at(parts: Column, start: Column, n: int = 4, joint: str = ":") -> Column:
    return F.concat_ws(joint, *[F.get(parts, start + k) for k in range(n)])


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def strip_prefix(items: Column, prefix: str) -> Column:
    """Each item without the prefix; items that lack it stay."""
    return F.transform(items, lambda x: F.when(F.startswith(x, F.lit(prefix)), F.substring(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(x))


def abbreviated(value: Column, n: int = 100) -> Column:
    return F.left(value.cast("string"), F.lit(n))


def ordered_long(value: Column) -> Column:
    """Eight bytes whose unsigned order is the order of the numbers."""
    return F.unhex(F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def ordered_int(value: Column) -> Column:
    """Four bytes whose unsigned order is the order of the numbers."""
    return F.unhex(F.lpad(F.hex((value.cast("long") + F.lit(1 << 31)).bitwiseAND(F.lit((1 << 32) - 1))), 8, "0"))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as a double, to the millisecond; of a timestamp without zone, as UTC sees it."""
    return F.unix_millis(ts.cast("timestamp")) / F.lit(1000.0)


def shard_file_name(pattern: str, shard: Column) -> Column:
    """The file name of a shard by a printf pattern like ``part-%04d``."""
    return F.format_string(pattern, shard)


def templated(template: str, **values: object) -> str:
    """``$name/$id/output-$num`` with its values; an unknown or missing name is an error."""
    from string import Template

    try:
        return Template(template).substitute({k: str(v) for k, v in values.items()})
    except (KeyError, ValueError) as error:
        raise ValueError(f"bad naming template {template!r}: {error}") from error


def to_bool(value: object) -> bool:
    """``true`` / ``yes`` / ``on`` / ``1`` in any case, numbers by whether they are zero."""
    if isinstance(value, str):
        return value.strip().lower() in ("true", "t", "yes", "y", "on", "1")
    return bool(value)
