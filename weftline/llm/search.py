"""Exact top-k search over 64-bit binary codes by incremental multi-index hashing.

Codes are cut into segments of about log2(n) bits, and each segment has buckets of its values. Round r probes the
buckets whose value differs in r bits from the query's. A code within m * r + i bits, m segments in all, differs in
at most r bits in one of segments 0 to i or in at most r - 1 in another: so once segments 0 to i were probed at r and
the rest at r - 1, every code that near is verified. A query probes no segment beyond what its k-th verified distance
asks for, and is done when that distance is covered.

Buckets are kept in shards by the first bits of a segment's value, large ones split further by salt. A query goes to
the shards within its radius, and each shard probes its own buckets: by flipping bits, or, where there are fewer
bucket values than flips, by going through these values. Every radius up to the whole segment is thus affordable,
so all queries end in the same way, at any number of codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import at, remove, written

K, BITS = 10, 64
#: Codes of a shard, on average: 32 MB in Python. Probes that are looked up together.
SHARD_CODES, PROBES = 1 << 21, 1 << 20


def sign_codes(table: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, code) of every row with an embedding, its signs as 64 bits.

    Bit i is set if the elements i, i + 64, ... add up to more than zero; null elements and NaN count as zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            flat = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            sums = np.bincount(row * BITS + place % BITS, flat, len(lengths) * BITS).reshape(-1, BITS)
            codes = np.packbits(sums > 0, axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes)], ["id", "code"])

    rows = table.where(F.col(embedding).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("e"))
    return rows.mapInArrow(run, "id long, code long")


def segments_for(n_codes: int) -> int:
    """As many segments as leave about one code a bucket."""
    return min(16, max(2, round(BITS / log2(max(4, n_codes)))))


def borders(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; the first ones are wider by a bit where 64 doesn't divide."""
    widths = [BITS // segments + (i < BITS % segments) for i in range(segments)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _prefix(code: Column, first: int, width: int, bits: int) -> Column:
    """The first ``bits`` bits of a segment's value."""
    return F.shiftrightunsigned(code, first + width - bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


class Shard:
    """The codes of one shard, by the rest of their segment's value."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, counts: np.ndarray, first: int, width: int) -> None:
        self.first, self.width = np.uint64(first), width
        value = self.value_of(codes)
        order = np.argsort(value, kind="stable")
        self.codes, self.ids, self.counts = codes[order], ids[order], counts[order]
        self.values, self.starts = np.unique(value[order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(codes)]
        self.flips: dict[int, np.ndarray] = {}

    def value_of(self, codes: np.ndarray) -> np.ndarray:
        return codes >> self.first & np.uint64((1 << self.width) - 1)

    def probe(self, own: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query's place, bucket's place) of each bucket that differs in ``radius`` bits from a query's value."""
        if radius > self.width or not len(self.values):
            return
        flips = comb(self.width, radius)
        if flips > len(self.values):
            step = max(1, PROBES // len(self.values))
            for b in range(0, len(own), step):
                q, v = np.nonzero(np.bitwise_count(own[b : b + step, None] ^ self.values[None, :]) == radius)
                yield q + b, v
            return
        if radius not in self.flips:
            self.flips[radius] = np.array([sum(1 << x for x in bits) for bits in combinations(range(self.width), radius)], np.uint64)
        step = max(1, PROBES // flips)
        for b in range(0, len(own), step):
            wanted = (own[b : b + step, None] ^ self.flips[radius][None, :]).ravel()
            found = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
            hit = np.flatnonzero(self.values[found] == wanted)
            yield hit // flips + b, found[hit]

    def near(self, queries: np.ndarray, radius: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query's place, code's place, distance): of each query's probed codes within its bound the first k by distance and id."""
        for r in np.unique(radius):
            at_ = np.flatnonzero(radius == r)
            for q, v in self.probe(self.value_of(queries[at_]), int(r)):
                counts = self.ends[v] - self.starts[v]
                ends = np.cumsum(counts)
                # a bucket may hold a third of all codes: its codes are taken in pieces
                for begin in range(0, int(ends[-1]) if len(ends) else 0, 4 * PROBES):
                    n = np.arange(begin, min(begin + 4 * PROBES, int(ends[-1])))
                    bucket = np.searchsorted(ends, n, side="right")
                    code = self.starts[v[bucket]] + n - (ends[bucket] - counts[bucket])
                    query = at_[q[bucket]]
                    d = np.bitwise_count(queries[query] ^ self.codes[code]).astype(np.int32)
                    ok = d <= bound[query]
                    query, code, d = query[ok], code[ok], d[ok]
                    order = np.lexsort((self.ids[code], d, query))
                    query, code, d = query[order], code[order], d[order]
                    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
                    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
                    yield query[rank < k], code[rank < k], d[rank < k]


def _probed(rows: DataFrame, places: list[tuple[int, int]], bits: int, radius: int, k: int) -> DataFrame:
    """(query_id, query, code, distance, ids, first_id) found in the shards.

    ``rows`` are partitioned by shard, a shard's codes before its queries: (segment, prefix, near, a, b, c), near null
    and a, b, c a code, its first id and its ids for codes; for queries, near is how many bits of the prefix differ
    and a, b, c the query's code, id and bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        shard = None
        for batch in batches:
            near = batch.column("near")
            asks = np.array(near.is_valid())
            a, b, c = (batch.column(n).to_numpy(zero_copy_only=False) for n in "abc")
            if not asks.all():
                held.append([x[~asks] for x in (a, b, c)])
            if not asks.any():
                continue
            if shard is None:
                codes, ids, counts = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
                first, width = places[batch.column("segment")[int(np.flatnonzero(asks)[0])].as_py()]
                shard = Shard(codes.view(np.uint64), ids, counts, first, width - bits)
            a, b, c = a[asks], b[asks], c[asks]
            left = radius - near.fill_null(0).to_numpy(zero_copy_only=False)[asks]
            for q, code, d in shard.near(np.ascontiguousarray(a).view(np.uint64), left, c, k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b[q]), pa.array(a[q]), pa.array(shard.codes[code].view(np.int64)), pa.array(d), pa.array(shard.counts[code]), pa.array(shard.ids[code])],
                    ["query_id", "query", "code", "distance", "ids", "first_id"],
                )

    return rows.mapInArrow(run, BEST)


BEST = "query_id long, query long, code long, distance int, ids long, first_id long"


def _sharded(spark: SparkSession, index: DataFrame, n_codes: int, m: int, shard_codes: int) -> tuple[DataFrame, DataFrame, int, int]:
    """(code rows with their shard, shards, number of shards, prefix bits); see ``_probed`` for the rows.

    A shard is a segment's codes of one prefix, and, of a prefix with more than twice ``shard_codes``, one salt of
    them. There are some n * m / shard_codes shards, at least about one for each shuffle partition.
    """
    places = borders(m)
    least = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // m)
    bits = min(max(0, (max(-(-n_codes // shard_codes), least) - 1).bit_length()), min(w for _, w in places))
    each = F.array(*[F.struct(F.lit(i).alias("segment"), _prefix(F.col("code"), first, width, bits).alias("prefix")) for i, (first, width) in enumerate(places)])
    rows = index.select(F.explode(each).alias("s"), "code", "first_id", F.size("ids").cast("long").alias("n")).select("s.*", "code", "first_id", "n")
    sizes = sorted(map(tuple, rows.groupBy("segment", "prefix").count().collect()))  # of shards, not of codes
    listed, n = [], 0
    for segment, prefix, count in sizes:
        salts = -(-count // shard_codes) if count > 2 * shard_codes else 1
        listed.append((segment, prefix, n, salts))
        n += salts
    shards = spark.createDataFrame(listed, "segment int, prefix int, shard int, salts int")
    placed = rows.join(F.broadcast(shards), ["segment", "prefix"])
    placed = placed.select((F.col("shard") + F.pmod(F.xxhash64("code"), F.col("salts")).cast("int")).alias("shard"), "segment", "prefix", F.lit(None).cast("int").alias("near"), F.col("code").alias("a"), F.col("first_id").alias("b"), F.col("n").alias("c"))
    return placed, shards, max(1, n), bits


def _routes(open_queries: DataFrame, shards: DataFrame, places: list[tuple[int, int]], bits: int, radius: int) -> DataFrame:
    """A row for each open query and each shard that may hold a bucket at ``radius`` which its bound asks for."""
    m = len(places)
    flips = [(sum(1 << x for x in c), r) for r in range(min(radius, bits) + 1) for c in combinations(range(bits), r)]
    each = F.array(*[F.struct(F.lit(i).alias("segment"), _prefix(F.col("query"), first, width, bits).alias("own"), F.lit(m * radius + i).alias("covers"), F.lit(width).alias("width")) for i, (first, width) in enumerate(places)])
    rows = open_queries.select("query_id", "query", "bound", F.explode(each).alias("s")).where(f"s.covers <= bound and s.width >= {radius}")
    near = F.array(*[F.struct(F.lit(f).alias("flip"), F.lit(r).alias("near")) for f, r in flips])
    rows = rows.select("query_id", "query", "bound", "s.segment", "s.own", F.explode(near).alias("f"))
    rows = rows.select("query_id", "query", "bound", "segment", F.col("own").bitwiseXOR(F.col("f.flip")).alias("prefix"), "f.near").join(F.broadcast(shards), ["segment", "prefix"])
    rows = rows.withColumn("shard", F.explode(F.sequence(F.col("shard"), F.col("shard") + F.col("salts") - 1)))
    return rows.select("shard", "segment", "prefix", "near", F.col("query").alias("a"), F.col("query_id").alias("b"), F.col("bound").cast("long").alias("c"))


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, segments: int | None = None, shard_codes: int = SHARD_CODES) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k rows nearest to each query by Hamming distance, ties by id.

    Both tables have (id, code); rows of null code or id are in neither, other columns are not read. A row is a
    neighbour of itself where it is on both sides. Rows that share a code are kept as one code with its k smallest
    ids, which are all that ties can take. Repeated rows with one id count once. Fewer than k rows give fewer
    neighbours; no rows give none.
    """
    spark = rows.sparkSession
    codes = rows.select("id", "code").where("code IS NOT NULL AND id IS NOT NULL").distinct()
    # a code that a third of the rows share is thinned to k ids within 64 salts, then over them
    codes = codes.withColumn("salt", F.pmod(F.hash("id"), F.lit(64)))
    for part in (["code", "salt"], ["code"]):
        codes = codes.withColumn("n", F.row_number().over(Window.partitionBy(*part).orderBy("id"))).where(F.col("n") <= k)
    index = written(codes.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("first_id", F.col("ids")[0]), "codes")
    n_codes, n_ids = index.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    m = segments or segments_for(n_codes)
    places = borders(m)
    coded, shards, n_shards, bits = _sharded(spark, index, n_codes, m, shard_codes)
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).where("query IS NOT NULL AND query_id IS NOT NULL").distinct()
    open_queries, path = at(asked.withColumn("bound", F.lit(BITS)), "open")
    best, done, spent = spark.createDataFrame([], BEST), [], [path]
    for radius in range(max(w for _, w in places) + 1):
        if not n_codes or open_queries.isEmpty():
            break
        both = coded.unionByName(_routes(open_queries, shards, places, bits, radius)).repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "near")  # nulls, the codes, first
        found = _probed(both, places, bits, radius, k).unionByName(best).dropDuplicates(["query_id", "query", "code"])
        order = Window.partitionBy("query_id", "query").orderBy("distance", "first_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
        best, best_path = at(found, "best")
        up_to = order.rowsBetween(Window.unboundedPreceding, 0)
        reached = best.withColumn("so_far", F.sum("ids").over(up_to)).groupBy("query_id", "query").agg(F.min(F.when(F.col("so_far") >= k, F.col("distance"))).alias("kth"), F.sum("ids").alias("held"))
        state = open_queries.join(reached, ["query_id", "query"], "left").withColumn("bound", F.coalesce("kth", "bound"))
        covered = m * radius + m - 1
        ended = (F.col("bound") <= covered) | (F.coalesce("held", F.lit(0)) >= n_ids)
        state, state_path = at(state.select("query_id", "query", "bound", F.coalesce(ended, F.lit(False)).alias("ended")), "open")
        done.append(best.join(state.where("ended").select("query_id", "query"), ["query_id", "query"], "left_semi"))
        spent += [best_path, state_path]
        open_queries = state.where("not ended").drop("ended")
        best = best.join(open_queries.select("query_id", "query"), ["query_id", "query"], "left_semi")
    all_best = spark.createDataFrame([], BEST)
    for part in done:
        all_best = all_best.unionByName(part)
    all_best = written(all_best, "nearest")
    for old in spent:
        remove(spark, old)
    named = all_best.select("query_id", "query", "code", "distance").join(index, "code").select("query_id", "query", "distance", F.explode("ids").alias("neighbor_id"))
    order = Window.partitionBy("query_id", "query").orderBy("distance", "neighbor_id")
    return named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", F.col("distance").cast("long").alias("distance"))


def neighbours(embeddings: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """top_k of the sign codes of a table (vec_id, embedding), asked for every vec_id divisible by ``every``."""
    codes = written(sign_codes(embeddings, "vec_id", "embedding"), "sign-codes")
    return top_k(codes.where(F.col("id") % every == 0), codes, k)


ORACLE = """
WITH bits AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, list_sum(list_transform(list_zip(q.b, r.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS distance
  FROM bits q, bits r WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS BIGINT) AS rank, neighbor_id, CAST(distance AS BIGINT) AS distance
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) <= 10
"""
