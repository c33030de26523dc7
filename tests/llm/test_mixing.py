"""Mixing against the contract's own words: targets by repeated resharing, bounds, agreement of reruns."""

import re

import pytest

from weftline.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, source string, size long"


def targets(sizes):
    """Resharing by hand: sources above three times their size stop there, the rest is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


@pytest.fixture(scope="module")
def rows():
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    hot = [(i, text(i % 90), "hot", 1) for i in range(700)]
    return [*hot, (1000, text(5000), "b", 1), (1001, text(7), "tiny", 1), (1002, None, "tiny", 1), (1003, "", "empty", 1), (1004, text(40), None, 1), (None, "a\x0bb c  d", "é", 1), (1006, text(12), "Z", 1), (1006, text(12), "Z", 1)]


def test_targets_and_takes(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(docs, block_words=64).documents.collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-9
    again = mix_sources(docs.repartition(5), block_words=64).documents.collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_is_even(spark, rows):
    mix = mix_sources(spark.createDataFrame(rows, SCHEMA), block_words=64)
    slots = mix.schedule.orderBy("slot").collect()
    assert [s.slot for s in slots] == list(range(len(slots)))
    quota = {s.source_no: s.slots for s in mix.sources.collect()}
    seen = dict.fromkeys(quota, 0)
    for i, s in enumerate(slots, 1):
        seen[s.source_no] += 1
        assert all(abs(seen[q] - i * quota[q] / len(slots)) < 12 for q in quota)
    assert seen == quota


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).documents.collect() == []
    only = mix_sources(spark.createDataFrame([(1, None, None, 1)], SCHEMA)).documents.collect()
    assert [(r.doc_id, r["size"], r.target, r.taken) for r in only] == [(1, 0, 0.0, 0)]


def test_taken_from_the_schedule(spark, rows):
    """What is taken of each document, again from the schedule's blocks and the order of documents by hash."""
    from pyspark.sql import functions as F

    block, docs = 64, spark.createDataFrame(rows, SCHEMA)
    mix = mix_sources(docs, block_words=block)
    number = {s.source: s.source_no for s in mix.sources.collect()}
    held = {}
    for r in docs.select("doc_id", "source", "text", F.xxhash64("doc_id", F.lit(42)).alias("h")).collect():
        held.setdefault(number[r.source], []).append(((r.h % 2**64) >> 32, r.h, -1 if r.doc_id is None else r.doc_id, len(re.findall("[^\x20\x09-\x0d]+", r.text or "")), r.doc_id, r.source))
    uses = {}
    for s in mix.schedule.collect():
        words = uses.setdefault(s.source_no, {})
        for w in range(s.block * block, s.block * block + s.length):
            words[w] = words.get(w, 0) + 1
    # one bucket here, as there are fewer rows than a window holds: documents lie in the order of the signed hash
    want, at = [], 0
    for no, own in held.items():
        at = 0
        for _, _, _, size, doc_id, source in sorted(own, key=lambda x: (x[1], x[2], x[3])):
            want.append((doc_id, source, size, sum(uses.get(no, {}).get(w, 0) for w in range(at, at + size))))
            at += size
    got = [(r.doc_id, r.source, r["size"], r.taken) for r in mix.documents.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_many_sources(spark):
    """As many sources as documents: no step grows with rows times sources."""
    from pyspark.sql import functions as F

    n = 30_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.format_string("s%06d", "id").alias("source"))
    docs = docs.unionByName(spark.range(n, n + 3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.lit(50)).alias("text"), F.lit("hot").alias("source")))
    got = mix_sources(docs).documents
    assert got.count() == n + 3000
    off = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).where("abs(t - w) > 0.5 + 1e-6")
    assert off.count() == 0


def test_clashing_names(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS target", "2 AS taken", "3 AS source_no", "4 AS block", "5 AS h", "6 AS bucket", "'x' AS _source")
    assert mix_sources(docs).documents.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and mix_sources(docs).documents.count() == len(rows)
