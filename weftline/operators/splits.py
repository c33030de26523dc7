"""Splitting ranges of ordered values: the points are computed on the driver, rows find their range by expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timedelta
from random import Random

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS, _PLACES = 128, 4


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def _even_points(start: int, end: int, n: int) -> list[int]:
    """At most n + 1 rising points from start to end, at rounded equal steps."""
    if end <= start:
        raise ValueError(f"nothing between {start} and {end} to split")
    inner = {start + _half_up((end - start) / n * i) for i in range(1, n)}
    return sorted({start, end} | {p for p in inner if p <= end})


def split_ints(start: int, end: int, n: int, include_start: bool = True, include_end: bool = False) -> list[int]:
    """Points of at most n half-open ranges over the integers between the bounds."""
    return _even_points(start + (not include_start), end + include_end, n)


def split_floats(start: float, end: float, n: int) -> list[float]:
    """The n - 1 points inside; the outer bounds keep their kind."""
    if end <= start:
        raise ValueError(f"nothing between {start} and {end} to split")
    return [start + i * (end - start) / n for i in range(1, n)]


def split_datetimes(start: datetime, end: datetime, n: int, include_start: bool = True, include_end: bool = False) -> list[datetime]:
    """Points at whole microseconds, steps rounded down; the last range takes the rest."""
    tick = timedelta(microseconds=1)
    start, end = start + tick * (not include_start), end + tick * include_end
    ticks = (end - start) // tick
    if ticks <= 0:
        raise ValueError(f"nothing between {start} and {end} to split")
    step = max(1, ticks // n)
    return [start + tick * (step * i) for i in range(min(n, ticks))] + [end]


def _weights(places: int = _PLACES, letters: int = _LETTERS) -> list[int]:
    """How many strings of at most so many places begin with one given letter, place by place."""
    out = [1]
    for _ in range(places - 1):
        out.insert(0, out[0] * letters + 1)
    return out


def ordinal_of(text: str, weights: Sequence[int]) -> int:
    """A string's place in lexicographic order among those of as many places as there are weights."""
    return sum(w * ord(c) + 1 for c, w in zip(text, weights, strict=False))


def string_at(ordinal: int, weights: Sequence[int]) -> str:
    """The inverse of ``ordinal_of``."""
    text = ""
    for w in weights:
        if ordinal == 0:
            break
        letter, ordinal = divmod(ordinal - 1, w)
        text += chr(letter)
    return text


def split_strings(start: str, end: str, n: int, include_start: bool = True, include_end: bool = False) -> list[str]:
    """Points between ASCII strings: past their common beginning, four characters count as an ordinal."""
    if not (start.isascii() and end.isascii()):
        raise ValueError("only ASCII strings can be split")
    same = next((i for i, (a, b) in enumerate(zip(start, end, strict=False)) if a != b), max(0, min(len(start), len(end)) - 1))
    weights, cut = _weights(), same + _PLACES
    low = ordinal_of(start[same:cut], weights) + (not include_start)
    high = ordinal_of(end[same:cut], weights) + include_end
    if high <= low:
        raise ValueError(f"nothing between {start!r} and {end!r} to split")
    points = [string_at(p, weights) for p in _even_points(low, high, n)]
    points[0] += start[cut:]
    points[-1] += end[cut:]
    return [start[:same] + p for p in points]


def split_namespaces(start: str, end: str, n: int, alphabet: str = "-.0123456789abcdefghijklmnopqrstuvwxyz", length: int = 3) -> list[tuple[str, str]]:
    """At most n contiguous, closed ranges of names between two names of at most ``length`` letters."""
    weights = _weights(length, len(alphabet))
    code = {c: i for i, c in enumerate(alphabet)}
    place = lambda s: sum(w * code[c] + 1 for c, w in zip(s, weights, strict=False))

    def name(ordinal: int) -> str:
        return "".join(alphabet[ord(c)] for c in string_at(ordinal, weights))

    low, high = place(start), place(end)
    if low > high:
        raise ValueError(f"{start!r} comes after {end!r}")
    points = _even_points(low, high + 1, n)
    return [(name(a), name(b - 1)) for a, b in zip(points, points[1:], strict=False)]


def split_list(items: Sequence, n: int, seed: int | None = None) -> list[list]:
    """At most n lists of near-equal length, in order or shuffled by a seed; the first take what is left over."""
    pool = list(items)
    if seed is not None:
        Random(seed).shuffle(pool)
    least, more = divmod(len(pool), n)
    out, at = [], 0
    for i in range(n):
        size = least + (i < more)
        if size:
            out.append(pool[at : at + size])
            at += size
    return out


def chained(n_ranges: int, shards: int) -> list[list[int]]:
    """Which of many sub-ranges each shard takes, in turns: i, i + shards, ..."""
    return [list(range(i, n_ranges, shards)) for i in range(min(shards, n_ranges))]


def range_of(value: Column, points: Sequence, last_closed: bool = False) -> Column:
    """The number of the half-open range between consecutive points that holds the value; null outside and for null.

    A binary search written out as nested conditions, so it stays one generated expression.
    """
    limits = [F.lit(p) for p in points]

    def search(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < limits[mid], search(low, mid)).otherwise(search(mid, high))

    top = value <= limits[-1] if last_closed else value < limits[-1]
    return F.when((value >= limits[0]) & top, search(0, len(points) - 1))


def time_shard(ts_micros: Column, start: int, end: int, n: int) -> Column:
    """The number of the n equal time slices of [start, end) that holds a time in microseconds."""
    step = max(1, (end - start) // n)
    return F.when((ts_micros >= start) & (ts_micros < end), F.least(F.lit(n - 1).cast("long"), F.floor((ts_micros - start) / step).cast("long")))


def size_balanced(sizes: Sequence[int], n: int) -> list[list[int]]:
    """Consecutive runs of items of about equal total size: a run ends once it holds its share."""
    share, runs, held = sum(sizes) / max(1, n), [[]], 0
    for i, size in enumerate(sizes):
        runs[-1].append(i)
        held += size
        if held >= share and i + 1 < len(sizes) and len(runs) < n:
            runs.append([])
            held = 0
    return [r for r in runs if r]


def byte_ranges(size: int, n: int, least: int = 1) -> list[tuple[int, int]]:
    """At most n equal byte ranges of a file, each of ``least`` bytes or more."""
    n = max(1, min(n, size // max(1, least)))
    return [(size * i // n, size * (i + 1) // n) for i in range(n)]
