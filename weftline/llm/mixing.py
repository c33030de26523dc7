"""Mixing sources to target weights, by a low-discrepancy schedule over shuffled equal-token blocks.

Only DataFrame functions. The text is read once, for its word counts; everything after that moves numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits_broadcast, written

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block, and slots or documents that one window orders.
BLOCK_WORDS, WINDOW_ROWS = 512, 4096
#: The unit interval of the schedule in integers, and the golden ratio's fraction of it.
UNIT, GOLDEN = 1 << 32, 2654435769
#: Least and most bins of the interval, in which slots look for their source.
BINS, MOST_BINS = 4096, 1 << 22


@dataclass
class Mix:
    """documents: a row per input row; sources: a row per source; schedule: a row per slot, in the mix's order."""

    documents: DataFrame
    sources: DataFrame
    schedule: DataFrame


def golden_point(i: Column) -> Column:
    """The i-th point of the golden-ratio sequence, in [0, 2^32); no product leaves 63 bits."""
    high = (F.shiftrightunsigned(i, 16) % 65536) * GOLDEN % UNIT
    return (high * 65536 + (i % 65536) * GOLDEN) % UNIT


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_repeat: int) -> DataFrame:
    """Sources in code-point order with their weight, size, documents and target.

    Targets share all words by weight; those above ``max_repeat`` times their source stop there and the rest is
    shared again. In order of cap over weight, the capped sources come first, so one running sum finds them all.
    """
    all_rows = Window.partitionBy(F.lit(0))
    by_name = all_rows.orderBy(F.asc_nulls_last("source"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    by_cap = all_rows.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    cap = F.col("source_size") * max_repeat
    before = F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a frame that ends with the partition is summed anew for each row; turned round, it grows row by row
    turned = all_rows.orderBy((F.col("source_size") / F.col("weight")).desc(), F.desc_nulls_first("source"))
    weight_left = F.sum("weight").over(turned.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("source_size").over(all_rows)
    s = s.withColumn("capped", cap * weight_left <= (total - before) * F.col("weight"))
    rest = total - F.sum(F.when(F.col("capped"), cap).otherwise(0)).over(all_rows)
    weight_open = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(all_rows)
    return s.withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(rest.cast("double") * F.col("weight") / weight_open))


def with_quotas(sources: DataFrame, block: int) -> DataFrame:
    """Whole passes, then as many blocks as the rest of the target needs, the last one cut to it."""
    s = sources.withColumn("take", F.floor(F.col("target") + 0.5).cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    s = s.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(F.lit(0).cast("long")))
    s = s.withColumn("rest", F.col("take") - F.col("passes") * F.col("source_size"))
    s = s.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    return s.withColumn("source_no", F.row_number().over(by_name).cast("long")).withColumn("slots_before", F.coalesce(F.sum("slots").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def slot_schedule(sources: DataFrame, n_slots: int, n_sources: int, block: int) -> DataFrame:
    """(slot, source_no, rank, block, length): slot i's golden-ratio point picks the source, ranks count its slots.

    The points give every source its share to within a few slots; the surplus of some goes, slot by slot, to
    the shortfall of others, so quotas hold exactly. Ranks come from counts by chunk of slots and a window inside
    each chunk: no window spans a source.
    """
    spark = sources.sparkSession
    low = F.floor(F.col("slots_before") / F.lit(float(max(n_slots, 1))) * UNIT).cast("long")
    high = F.floor((F.col("slots_before") + F.col("slots")) / F.lit(float(max(n_slots, 1))) * UNIT).cast("long")
    # bins grow with the sources, and are no narrower than the least share: a bin has few sources
    bins = BINS
    while bins < MOST_BINS and bins < min(n_slots, 4 * n_sources):
        bins *= 2
    width = UNIT // bins
    spans = sources.where("slots > 0").select("source_no", low.alias("low"), high.alias("high")).where("high > low")
    spans = spans.withColumn("bin", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))))  # a row a bin and one for each source
    points = spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    points = points.withColumn("bin", F.expr(f"point div {width}"))
    chosen = points.join(spans, "bin").where("point >= low and point < high").select("slot", "source_no", F.expr(f"slot div {WINDOW_ROWS}").alias("chunk"))
    counts = chosen.groupBy("source_no", "chunk").count()
    counts = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = chosen.withColumn("inside", inside).join(counts, ["source_no", "chunk"]).select("slot", "source_no", (F.col("before") + F.col("inside")).alias("rank"))
    quota = sources.select("source_no", "slots", "blocks", "passes", "rest", "source_size")
    ranked = ranked.join(quota, "source_no")
    numbered = Window.partitionBy(F.lit(0))
    surplus = ranked.where("rank >= slots").select("slot", F.row_number().over(numbered.orderBy("slot")).alias("n"))
    given = counts.groupBy("source_no").agg(F.sum("count").alias("given"))
    short = quota.join(given, "source_no", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < slots")
    short = short.withColumn("rank", F.explode(F.sequence(F.col("given"), F.col("slots") - 1))).withColumn("n", F.row_number().over(numbered.orderBy("source_no", "rank")))
    moved = surplus.join(short, "n").select(*ranked.columns)
    s = ranked.where("rank < slots").unionByName(moved).withColumn("block", F.col("rank") % F.col("blocks"))
    full = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    cut = F.col("rest") - (F.col("slots") - F.col("passes") * F.col("blocks") - 1) * block
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    return s.select("slot", "source_no", "rank", "block", F.when(last, F.least(full, cut)).otherwise(full).alias("length"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3, block_words: int = BLOCK_WORDS, seed: int = 42) -> Mix:
    """Mixes all documents (doc_id, text, source) so that each source's words come to its target.

    ``documents``: doc_id, source, size, source_size, target, taken, with a row for every input row: ``taken`` are the
    words the mix takes of it, repeats counted. Documents of a source lie in the order of a seeded hash, cut into
    blocks of ``block_words``; slots take blocks in turn, pass after pass, so nothing exceeds ``max_repeat`` times its size.

    Nulls: a null text has size 0; null sources form one source, the last; a null doc_id is kept. Repeated rows
    each count. Ties of the hash are ordered by doc_id and size; rows alike in these too may swap what is taken of
    them, which no one can tell. Very long texts are counted whole and lie in many blocks. Empty texts are kept with
    taken 0; an empty table gives no rows. Other columns are not read. Sources may be as many as rows.
    """
    spark = docs.sparkSession
    sizes = written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    sources = written(with_quotas(source_targets(sizes, weights, max_repeat), block_words), "sources")
    n_slots, n_docs, n_sources = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0)), F.count("*")).first()
    schedule = written(slot_schedule(sources, int(n_slots), n_sources, block_words), "schedule")

    facts = sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    if fits_broadcast(facts):
        placed = sizes.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("_source")))
    else:  # a hot source's documents are spread over 32 copies of its row
        copies = facts.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(31))))
        placed = sizes.join(copies, F.col("source").eqNullSafe(F.col("_source")) & (F.pmod(F.hash("doc_id", "size"), F.lit(32)) == F.col("_copy")))
    buckets = max(1, int(n_docs) // WINDOW_ROWS)
    placed = placed.select("doc_id", "source", "size", "source_no", "source_size", "target", F.xxhash64("doc_id", F.lit(seed)).alias("h"))
    placed = placed.withColumn("bucket", F.expr(f"(shiftrightunsigned(h, 32) * {buckets}L) div {UNIT}L"))
    sums = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bucket_start"))
    order = Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size")
    earlier = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("earlier", earlier).withColumn("line", F.row_number().over(order)).join(sums, ["source_no", "bucket"])
    placed = placed.withColumn("start", F.col("bucket_start") + F.col("earlier"))

    uses = schedule.groupBy("source_no", "block").agg(F.count("*").alias("uses"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")))))
    origin = F.col("block") * block_words
    pieces = pieces.withColumn("from", F.greatest(F.col("start") - origin, F.lit(0))).withColumn("to", F.least(F.col("start") + F.col("size") - origin, F.lit(block_words)))
    pieces = pieces.join(uses, ["source_no", "block"], "left")
    part = lambda length: F.greatest(F.least(F.col("to"), length) - F.col("from"), F.lit(0))
    # one use of a block at most is cut short: the source's last slot
    taken = (F.col("uses") - 1) * part(F.col("longest")) + part(F.col("shortest"))
    out = pieces.groupBy("source_no", "bucket", "line", "doc_id", "source", "size", "source_size", "target").agg(F.coalesce(F.sum(taken), F.lit(0)).cast("long").alias("taken"))
    return Mix(out.select("doc_id", "source", "size", "source_size", "target", "taken"), sources, schedule)

