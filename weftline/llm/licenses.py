"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line, or a paragraph (lines up to a blank one). A template matches a block that holds at least
``threshold`` of the template's distinct words. Words are ordered by their frequency over all documents, rarest
first. A match needs o = ceil(threshold * |template|) common words, so by that order a matching block shares one of
the template's first |template| - o + 1 words (prefix filter), has o words of the vocabulary (length filter), and
at the first common word enough words must follow on both sides (positional filter). What passes is counted out.
Templates are constants of this module or a parameter, so their table is small by construction.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import send, slices

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
THRESHOLD = 0.8
#: Short notices by which files name their license; the label on the left is what a match adds.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2",
    "cc-by-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License CC BY 4.0",
    "cc-by-sa-4.0": "This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License CC BY SA 4.0",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "copyright": "Copyright all rights reserved no part may be reproduced without permission",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
_word = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_blank = re.compile(rb"\n[ \t\r\x0b\x0c]*\n")


def words_of(text: str | None) -> list[bytes]:
    return _word.findall((text or "").encode().lower())


def phrase_places(words: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if tuple(words[at : at + len(phrase)]) == phrase:
                    found.append((at, label))
        except ValueError:
            pass
    return found


class Join:
    """Templates prepared for the join, given how many documents hold each of their words."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float) -> None:
        sets = {label: set(words_of(text)) for label, text in templates.items()}
        sets = {label: s for label, s in sets.items() if s}
        order = sorted(set().union(*sets.values()), key=lambda w: (frequency.get(w, 0), w)) if sets else []
        self.rank = {w: r for r, w in enumerate(order)}
        self.templates = {label: sorted(self.rank[w] for w in s) for label, s in sets.items()}
        self.need = {label: math.ceil(threshold * len(t) - 1e-9) for label, t in self.templates.items()}
        #: word's rank -> (template, the word's position in it), for the words of prefixes
        self.prefix: dict[int, list[tuple[str, int]]] = {}
        for label, t in self.templates.items():
            for i, r in enumerate(t[: len(t) - self.need[label] + 1]):
                self.prefix.setdefault(r, []).append((label, i))
        self.starts = {w for w, r in self.rank.items() if r in self.prefix}
        self.least = min(self.need.values(), default=1)

    def matches(self, block: Iterable[bytes]) -> Iterator[tuple[str, float]]:
        """(label, containment) of every template that the block matches."""
        ranks = sorted({self.rank[w] for w in block if w in self.rank})
        if len(ranks) < self.least:
            return
        tried: dict[str, bool] = {}
        for j, r in enumerate(ranks):
            for label, i in self.prefix.get(r, ()):
                if label in tried:
                    continue
                t, need = self.templates[label], self.need[label]
                # the first common word: all common ones stand from here on, in both
                tried[label] = len(ranks) >= need and min(len(t) - i, len(ranks) - j) >= need
                if tried[label] and (common := len(set(t) & set(ranks))) >= need:
                    yield label, common / len(t)


def blocks_of(data: bytes) -> Iterator[bytes]:
    """Each paragraph, and each line of a paragraph that has several."""
    for paragraph in _blank.split(data):
        lines = [x for x in paragraph.split(b"\n") if x.strip()]
        if lines:
            yield paragraph
        if len(lines) > 1:
            yield from lines


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary stands, over all documents; one row for each word and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    for w in vocabulary.intersection(words_of(text)):
                        seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row, from whole texts.

    n_base counts the places of base phrases, first_word and last_word are their smallest and largest start, null
    without any. ``labels`` adds the labels of matching templates to the base ones. ``score`` is the best containment
    of a matching template, and 1 where a base phrase stands; 0 without either. Null and empty texts have no words.
    Repeated rows give equal rows; a null doc_id is returned; ties between templates all count. An empty table gives
    no rows; other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    split = {tuple(words_of(p)): label for p, label in phrases.items()}
    vocabulary = set().union(*(words_of(t) for t in templates.values())) if templates else set()
    sent = send(docs.sparkSession, (Join(templates, word_frequencies(docs, vocabulary) if vocabulary else {}, threshold), split))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join, split = sent()
        hints = join.starts
        for batch in batches:
            for part in slices(batch):
                out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
                for text in part.column("text").to_pylist():
                    data = (text or "").encode().lower()
                    words = _word.findall(data)
                    base = phrase_places(words, split)
                    best: dict[str, float] = {}
                    if not hints.isdisjoint(words):
                        for block in blocks_of(data):
                            for label, share in join.matches(_word.findall(block)):
                                best[label] = max(share, best.get(label, 0))
                    names = {label for _, label in base}
                    places = [at for at, _ in base]
                    out["n_words"].append(len(words))
                    out["n_base"].append(len(base))
                    out["first_word"].append(min(places, default=None))
                    out["last_word"].append(max(places, default=None))
                    out["base_labels"].append(",".join(sorted(names)))
                    out["labels"].append(",".join(sorted(names | set(best))))
                    out["score"].append(1.0 if base else max(best.values(), default=0.0))
                kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], ["doc_id", *out])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def brute_force_sql(templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan_licenses`` over documents: every block with every template, no filters."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    sets = {label: sorted({w.decode() for w in words_of(t)}) for label, t in (TEMPLATES if templates is None else templates).items()}
    rows = ", ".join(f"('{label}', {words!r}, {math.ceil(threshold * len(words) - 1e-9)})" for label, words in sets.items() if words)
    places = []
    for phrase, label in (PHRASES if phrases is None else phrases).items():
        same = " AND ".join(f"w[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
        places.append(f"SELECT r, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: {same})) AS place FROM w")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH t(label, words, need) AS (VALUES {rows}),
x AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '{pattern}') AS w FROM x),
places AS ({' UNION ALL '.join(places)}),
base AS (SELECT r, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY r),
paragraphs AS (SELECT r, unnest(string_split_regex(x, '\n[ \t\r\x0B\x0C]*\n')) AS b FROM w),
blocks AS (SELECT r, list_distinct(regexp_extract_all(b, '{pattern}')) AS w FROM (SELECT r, b FROM paragraphs UNION ALL SELECT r, unnest(string_split(b, chr(10))) FROM paragraphs)),
hits AS (SELECT r, label, CAST(len(list_intersect(blocks.w, words)) AS DOUBLE) / len(words) AS s FROM blocks, t WHERE len(list_intersect(blocks.w, words)) >= need),
best AS (SELECT r, max(s) AS s, list(DISTINCT label) AS labels FROM hits GROUP BY r)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ','), '') AS labels,
  CASE WHEN n IS NOT NULL THEN 1.0 ELSE coalesce(s, 0.0) END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN best USING (r)
"""
