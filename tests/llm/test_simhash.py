import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from weftline.llm import simhash
from weftline.llm.common import connected_components


def slow(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3):
            parent[find(i + 1 + int(j))] = find(i)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_and_spark_hash(spark):
    for text in (None, "", " \t", "One", "one two", "A b C", "é É ß x y", "w " * 2000, "x y z\x0bq"):
        assert simhash.fingerprint(text) == slow(text)
    row = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()
    assert row[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_groups_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(40)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(2, 200))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [None, "", "  "] + texts[:1] * 30
    docs = spark.createDataFrame([(1000 - i, t, "x") for i, t in enumerate(texts)] + [(None, "alone one two", "x")], "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 1
    rows = sorted((r for r in got if r.doc_id is not None), key=lambda r: -r.doc_id)
    fps = np.array([slow(t) for t in texts], np.uint64)
    assert [r.fingerprint for r in rows] == ["%016x" % f for f in fps.tolist()]
    of = groups(fps)
    least = {g: min(1000 - i for i, x in enumerate(of) if x == g) for g in of}
    assert [r.component_id for r in rows] == [least[g] for g in of]
    kept = simhash.keep_one(docs).collect()
    assert {r.doc_id for r in kept} == set(least.values()) | {None} and len(kept) == len(set(least.values())) + 1


def test_large_buckets(spark):
    rng = random.Random(1)
    base, fps = rng.getrandbits(64), set()
    for _ in range(400):
        v = base
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
            v ^= 1 << b
        fps.add(v)
    fps |= {(base & ~0xFFFF) | rng.getrandbits(16) for _ in range(300)}
    fps |= {((base & ~0xFFFF) ^ (1 << rng.randrange(16, 64))) | rng.getrandbits(16) for _ in range(300)}
    fps |= {rng.getrandbits(64) for _ in range(200)}
    a = np.array(sorted(fps), np.uint64)
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long"))
    found = {r.node: r.component for r in connected_components(links).collect()}
    got = {}
    for x in a.view(np.int64).tolist():
        got.setdefault(found.get(x, x), []).append(x)
    of, want = groups(a), {}
    for x, g in zip(a.view(np.int64).tolist(), of, strict=True):
        want.setdefault(g, []).append(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_and_empty(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 200: 100}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keep_one_keeps_each_group(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(60))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    # several texts without id, or with one id, are several documents; c, d and f are copies of rows with an id
    rows = [(None, a), (None, a), (None, b), (None, c), (5, c), (7, d), (7, e), (7, e), (6, d), (7, f), (None, f), (None, None), (None, ""), (None, g)]
    docs = spark.createDataFrame([(*r, 0) for r in rows] + [(None, g, 1)], "doc_id long, text string, n int")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text or "") for r in out.collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (5, c), (6, d), (7, e), (7, f), (None, ""), (None, g)], key=str)
    with_map = docs.withColumn("m", F.create_map(F.lit("k"), F.col("n")))
    assert sorted(((r.doc_id, r.text or "") for r in simhash.keep_one(with_map).collect()), key=str) == sorted(got, key=str)
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_hot_groups_are_split(spark):
    """A fingerprint that most rows have, a component that most fingerprints are in: the same groups with either join."""
    rng = random.Random(11)
    rows = [(i, None) for i in range(3000)] + [(3000 + i, " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(40))) for i in range(50)]
    docs = spark.createDataFrame(rows + rows[3000:3010], "doc_id long, text string")
    plain = sorted(map(repr, simhash.near_duplicates(docs).collect()))
    assert plain == sorted(map(repr, simhash.near_duplicates(docs, hot=5).collect())) and len(plain) == 3060


def test_component_of_a_hub(spark):
    n = 100_000
    edges = spark.range(1, n).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(spark.range(n, n + 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    got = connected_components(edges, hot=1000)
    assert got.where("component = 0").count() == n and got.where(f"component = {n}").count() == 201 and got.count() == n + 201


def test_many_parts(spark):
    """More parts than tasks: small parts give the same links."""
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(50)]
    fps = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    assert sorted(simhash.near_links(df, 3_000).collect()) == sorted(simhash.near_links(df).collect())


def test_long_text_ties_and_clashing_names(spark):
    text = " ".join(f"w{i % 977}" for i in range(150_000))
    docs = spark.createDataFrame([(2, text), (1, text), (3, "a b c"), (3, "a b c")], "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS n", "3 AS component", "4 AS node", "5 AS row", "6 AS h1", "7 AS id")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
