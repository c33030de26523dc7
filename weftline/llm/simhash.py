"""SimHash near-duplicates: fingerprints, exact links within a Hamming radius of 3, groups.

Links come from meet-in-the-middle ball hashing. Half of radius 3 is no whole number, and balls of radius 2 over
64 bits hold 2,081 keys, so the fourth part that differs is taken out first: of four 16-bit blocks, one holds a
differing bit whenever the fingerprints differ at all. Without that block they differ in 2 bits at most, hence
their balls of radius 1 over the 48 bits left share a key. Every distinct fingerprint emits 4 x 49 keys, no link
is missed, and a key's 48 bits stay selective for billions of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, connected_components, joined, slices, written

RADIUS, SEED = 3, 42
#: Members of a key's bucket up to which its pairs are compared directly.
SMALL_BUCKET = 48
#: Keys that a task sorts, on average: 36 MB. The number of parts follows from it, and parts are even, as keys are
#: of distinct fingerprints.
PART_KEYS = 4_000_000

_one = np.uint64(1)
#: For each byte, its bits in eight byte-wide lanes.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
_FLIPS = np.concatenate([[0], _one << np.arange(48, dtype=np.uint64)]).astype(np.uint64)
#: All changes to a 16-bit block of at most one and of at most two bits.
_bits = [1 << i for i in range(16)]
_NEAR1 = [0, *_bits]
_NEAR2 = [*_NEAR1, *(a | b for i, a in enumerate(_bits) for b in _bits[:i])]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included, as 64 unsigned bits; no words: zero."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = ends - np.fromiter(map(len, words), np.int64, len(words))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[:n].tolist(), last.tolist(), strict=True)], dtype="<u8")
    lanes = _LANES[h.view(np.uint8).reshape(n, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)  # a lane counts to 255
    counts = np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, *more: str) -> DataFrame:
    """(doc_id, fp) and the columns ``more``, which are longs: a row per input row; fp holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.fromiter((fingerprint(t, shingle) for t in part.column("text").to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64)), *(part.column(c) for c in more)], ["doc_id", "fp", *more])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


def _rotated(fp: np.ndarray, by: int) -> np.ndarray:
    return fp if by == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(64 - by))


def _packed_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every key of some fingerprints: its 50 bits, and in 22 bits more what the fingerprint has besides.

    Of the 72 bits, 64 are in a word that sorts by key, the others in a byte.
    """
    words, tails, keys = [], [], []
    for block in range(4):
        turned = _rotated(fp, 16 * block)
        kept = (turned & np.uint64((1 << 48) - 1)) | np.uint64(block << 48)
        key = (kept[:, None] ^ _FLIPS[None, :]).ravel()
        rest = ((turned >> np.uint64(48) << np.uint64(6))[:, None] | np.arange(len(_FLIPS), dtype=np.uint64)[None, :]).ravel()
        keys.append(key)
        words.append(key << np.uint64(14) | rest >> np.uint64(8))
        tails.append(rest.astype(np.uint8))
    return np.concatenate(keys), np.concatenate(words), np.concatenate(tails)


def _unpacked(words: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) of each packed row."""
    key, rest = words >> np.uint64(14), (words & np.uint64((1 << 14) - 1)) << np.uint64(8) | tails
    turned = (rest >> np.uint64(6) << np.uint64(48)) | ((key & np.uint64((1 << 48) - 1)) ^ _FLIPS[(rest & np.uint64(63)).astype(np.intp)])
    block, fp = key >> np.uint64(48), np.empty_like(turned)
    for n in range(4):
        at = block == n
        fp[at] = _rotated(turned[at], (64 - 16 * n) % 64)
    return key, fp


def _near_in_runs(key: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
    """Pairs at most RADIUS apart among rows of equal, sorted keys."""
    found = []
    a = np.arange(len(key) - 1) if len(key) else np.arange(0)
    for step in range(1, len(key)):
        a = a[a + step < len(key)]
        a = a[key[a] == key[a + step]]  # a run that has ended stays ended
        if not len(a):
            break
        close = np.bitwise_count(fp[a] ^ fp[a + step]) <= RADIUS
        found.append(np.stack([fp[a[close]], fp[a[close] + step]], axis=1))
    return found


def _bucket_links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: the verified pairs of small buckets (big false), the members of large ones (big true)."""

    def out(a: np.ndarray, b: np.ndarray, big: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), big))], ["a", "b", "big"])

    if not len(key):
        return
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    per_row = np.repeat(sizes, sizes)
    small, big = (per_row > 1) & (per_row <= SMALL_BUCKET), per_row > SMALL_BUCKET
    if small.any():
        pairs = _near_in_runs(key[small], fp[small])
        if pairs and len(p := np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)):
            yield out(np.ascontiguousarray(p[:, 1]), np.ascontiguousarray(p[:, 0]), False)
    if big.any():
        yield out(key[big], fp[big], True)


def _large_bucket_links(members: DataFrame) -> DataFrame:
    """Links that join up large buckets as all their close pairs would, from few rows for each member.

    Members of a key agree on 48 bits but for one flip at most, so where the block taken out is the same, all of
    them are within 2: one row ties each to the smallest. Between blocks that differ, one member without a flip and
    one with a flip stand for their kind: unflipped ones link within 3 bits of the block, unflipped and flipped
    within 2, flipped ones within 1. Balls of radius 2 and 1 over 16 bits find these; a bucket then has 154 rows at most.
    """
    block = F.shiftrightunsigned("key", 48)
    turned = F.expr("CASE shiftrightunsigned(key, 48) WHEN 0 THEN fp WHEN 1 THEN shiftleft(fp, 16) | shiftrightunsigned(fp, 48) WHEN 2 THEN shiftleft(fp, 32) | shiftrightunsigned(fp, 32) ELSE shiftleft(fp, 48) | shiftrightunsigned(fp, 16) END")
    low = F.lit((1 << 48) - 1)
    rows = members.select(F.col("a").alias("key"), F.col("b").alias("fp")).distinct()
    rows = rows.withColumn("x", F.shiftrightunsigned(turned, 48)).withColumn("flipped", turned.bitwiseAND(low) != F.col("key").bitwiseAND(low))
    rows = written(rows.where(block < 4), "large-buckets")
    least = rows.groupBy("key", "x").agg(F.min("fp").alias("m"))
    ties = rows.join(least, ["key", "x"]).select(F.col("fp").alias("a"), F.col("m").alias("b"))
    stand = rows.groupBy("key", "x", "flipped").agg(F.min("fp").alias("fp"))
    ball = F.when(F.col("flipped"), F.array(*[F.lit(v) for v in _NEAR1])).otherwise(F.array(*[F.lit(v) for v in _NEAR2]))
    spread = stand.withColumn("change", F.explode(ball)).select("key", F.col("x").bitwiseXOR(F.col("change").cast("long")).alias("near"), "fp")
    groups = spread.groupBy("key", "near").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    pairs = groups.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b"))
    return ties.unionByName(pairs.where("a > b and bit_count(a ^ b) <= 3")).where("a <> b").distinct()


def near_links(fps: DataFrame, part_keys: int = PART_KEYS) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) that join the same groups as all pairs within RADIUS.

    Every pair in a bucket of at most SMALL_BUCKET rows is compared; larger buckets are tied up as
    ``_large_bucket_links`` tells, which leaves out links only between fingerprints that others connect.
    """
    n = fps.count() * 4 * len(_FLIPS)
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // part_keys))
    # as many fingerprints at once as leave some 16 keys for each part, so that rows stay worth their overhead
    at_once = min(max(8192, 16 * parts // (4 * len(_FLIPS))), 1 << 16)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for batch in batches:
            for piece in slices(batch, 8192):
                held.append(piece.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
                size += len(held[-1])
                if size >= at_once:
                    yield np.concatenate(held)
                    held, size = [], 0
        if held:
            yield np.concatenate(held)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nine bytes a key, those of one part together in a row: no row or field overhead goes through the shuffle."""
        for piece in pieces(batches):
            key, words, tails = _packed_keys(piece)
            part = ((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, words, tails = part[order], words[order], tails[order]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[starts[1:], len(part)]
            rows = [words[a:b].tobytes() + tails[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(rows, pa.binary())], ["part", "rows"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.column("rows").to_pylist()]
        words = np.concatenate([np.frombuffer(r, "<u8", len(r) // 9) for r in rows] or [np.zeros(0, np.uint64)])
        tails = np.concatenate([np.frombuffer(r, np.uint8, len(r) // 9, len(r) // 9 * 8) for r in rows] or [np.zeros(0, np.uint8)])
        order = np.argsort(words)
        yield from _bucket_links(*_unpacked(words[order], tails[order]))

    placed = fps.select("fp").mapInArrow(spread, "part int, rows binary").repartitionById(parts, F.col("part"))
    found = written(placed.mapInArrow(gather, "a long, b long, big boolean"), "links")
    return found.where("not big").select("a", "b").unionByName(_large_bucket_links(found.where("big"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, hot: int = HOT_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of documents (doc_id, text).

    Fingerprints differing in at most 3 bits are linked; component_id is the smallest doc_id of those reachable.
    Fingerprints are made distinct first, so copies meet once, whatever their number. Null and empty texts have
    the fingerprint zero and are linked like any other; very long texts are taken whole; repeated rows keep their rows;
    a bit of just half the shingles is not set. A null doc_id is returned as null; a component of such rows only has a
    null component_id. Other columns are not read. Rows of a fingerprint, and fingerprints of a component, of which
    there are over ``hot`` are named where they are, see ``joined``.
    """
    all_fps = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(all_fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    groups = written(connected_components(near_links(classes), hot=hot).withColumnRenamed("node", "fp"), "groups")
    tied = classes.join(groups, "fp").groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    tied = joined(groups, tied, "component", "members", groups.count(), hot).select("fp", "component_id")
    named = classes.join(tied, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n")
    found = joined(all_fps, written(named, "named"), "fp", "n", all_fps.count(), hot)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Documents with exactly one row for each group of near-duplicates, that of its smallest doc_id.

    A row whose doc_id is null stays only if no row of its group has one; of rows that tie, the first by the hashes of
    text and row stays. A doc_id stands for nothing beyond its group: rows that share one, or have none, stay each for
    their own group if their texts differ by more than a group does. Fully repeated rows are brought to one before the
    rest is joined, so that no task holds all of them.
    """
    # the row travels as one struct, so that no column of it can clash with those added here
    hashed = [F.col(f"`{c.name}`") for c in docs.schema if not any(x in c.dataType.simpleString() for x in ("map<", "variant"))]
    of_text = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2")]  # 128 bits tell texts of one doc_id apart
    key = ["none", "id", "h1", "h2", "h3"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *of_text, F.xxhash64(*hashed).alias("h3"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    id_ = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")]
    found = fingerprints(rows, shingle, "h1", "h2", "h3").select("fp", F.struct(*id_, "h1", "h2", "h3").alias("best"))
    classes = written(found.groupBy("fp").agg(F.min("best").alias("best")), "classes")
    groups = connected_components(near_links(classes))
    tied = classes.join(groups, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min("best").alias("best"))
    first = written(tied.select("best.*"), "first")
    unique = rows.select(*id_, "h1", "h2", "h3", "row").groupBy(*key).agg(F.first("row").alias("row"))
    kept = unique.join(first, key, "left_semi")  # grouped and joined by one key: texts are shuffled once
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
