"""Users' readers and writers, byte ranges of files, log scans, settings, hooks, configurations, folds in streams."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import codec
from weftline.operators import ordering
from weftline.plans import jobs, settings, spec
from weftline.plans.catalog import Lines, Squares
from weftline.sources import contract, files, recordlog, scan
from weftline.streaming import slices


def test_user_reader(spark):
    got = contract.read(spark, Squares, {"start": 3, "end": 40}, 4)
    assert got.rdd.getNumPartitions() <= 4 and sorted(r.n for r in got.collect()) == list(range(3, 40))
    reader = Squares(0, 10)
    some = iter(reader)
    assert [next(some)[0] for _ in range(4)] == [0, 1, 2, 3]
    state = json.loads(json.dumps(reader.state()))  # taken up again where it was left
    assert [n for n, _ in Squares.resumed(state)] == [4, 5, 6, 7, 8, 9]
    assert sorted(r.n for r in contract.read(spark, Squares, {"start": 0, "end": 10}, states=[state]).collect()) == [4, 5, 6, 7, 8, 9]
    assert contract.read(spark, Squares, {"start": 1, "end": 1}).collect() == []
    for bad in ({"start": 2, "end": 1}, {"start": 0, "end": 5}):
        with pytest.raises(contract.BadReader):
            contract.read(spark, Squares, bad, 0)


class Failing(Lines):
    def write(self, row):
        raise RuntimeError("no room")


def test_user_writer(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").cast("string"))
    contract.write(rows.repartition(3), Lines, {"folder": f"{tmp_path}/out"})
    assert sorted(int(r.record) for r in files.records(spark, f"{tmp_path}/out/*.txt").collect()) == list(range(20))
    with pytest.raises(Exception, match="no room"):
        contract.write(rows, Failing, {"folder": f"{tmp_path}/bad"})
    assert list((tmp_path / "bad").glob("*.txt")) == []


@pytest.mark.parametrize("shards", [1, 7, 50])
def test_lines_of_byte_ranges(spark, tmp_path, shards):
    rng = random.Random(shards)
    data = "".join("é" * rng.randrange(12) + "\n" * rng.randrange(3) for _ in range(300)).encode() + b"end without feed\xff"
    (tmp_path / "a.txt").write_bytes(data)
    (tmp_path / "b.txt").write_bytes(b"\n\nx\n")
    (tmp_path / "c.txt").write_bytes(b"")
    want, at = [], 0
    for line in data.split(b"\n"):
        want.append((at, line.decode("utf-8", "replace")))
        at += len(line) + 1
    got = files.lines_at(spark, [f"{tmp_path}/{n}.txt" for n in "abc"], shards, 1).collect()
    assert sorted((r.byte_offset, r.line) for r in got if r.path.endswith("a.txt")) == want
    assert sorted((r.byte_offset, r.line) for r in got if r.path.endswith("b.txt")) == [(0, ""), (1, ""), (2, "x")]
    assert files.lines_at(spark, [f"file://{tmp_path}/c.txt"]).collect() == []


def test_record_log_in_block_ranges(spark, tmp_path):
    rng = random.Random(1)
    records = [rng.randbytes(rng.choice([0, 5, 3000, recordlog.BLOCK - 7, 100_000])) for _ in range(60)]
    data = b"".join(recordlog.encode(records))
    blocks = [data[i : i + recordlog.BLOCK] for i in range(0, len(data), recordlog.BLOCK)]
    for size in (1, 2, 5, len(blocks)):
        got = []
        for first in range(0, len(blocks), size):
            got += recordlog.decode_from(iter(blocks[first:]), size, first == 0)
        assert got == records
    (tmp_path / "x.log").write_bytes(data)
    recordlog.register(spark)
    back = spark.read.format("recordlog").option("blocks", 2).load(f"{tmp_path}/*.log")
    assert back.rdd.getNumPartitions() == -(-len(blocks) // 2)
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(records)
    assert spark.read.format("recordlog").load(f"file://{tmp_path}").count() == len(records)
    with pytest.raises(recordlog.CorruptRecords):
        list(recordlog.decode_from(iter([blocks[0][:-1] + b"x"]), 1, True))


def test_log_scans(spark):
    from datetime import datetime, timedelta

    day = datetime(2024, 1, 1)
    rows = [(day + timedelta(hours=i), scan.LEVELS[i % 5] if i % 7 else None, i % 3 > 0 if i % 11 else None, f"v{i % 2}", "default" if i % 4 else "other", i) for i in range(60)]
    logs = spark.createDataFrame(rows, "time timestamp, level string, finished boolean, version string, module string, n int")
    end = day + timedelta(hours=50)
    ids = lambda df: sorted(r.n for r in df.collect())
    assert ids(scan.log_scan(logs, day, end)) == [r[5] for r in rows if r[5] < 50 and r[2]]
    assert ids(scan.log_scan(logs, day, end, "error", True)) == [r[5] for r in rows if r[5] < 50 and r[1] in ("error", "critical")]
    assert ids(scan.log_scan(logs, day, end, versions=["v1"])) == [r[5] for r in rows if r[5] < 50 and r[2] and r[3] == "v1" and r[4] == "default"]
    assert ids(scan.log_scan(logs, day, end, None, True, module_versions=[("other", "v0")])) == [r[5] for r in rows if r[5] < 50 and (r[4], r[3]) == ("other", "v0")]
    for bad in ({"versions": ["a"], "module_versions": [("m", "a")]}, {"least_level": "loud"}):
        with pytest.raises(scan.BadScanParams):
            scan.log_scan(logs, day, end, **bad)


def test_key_ranges_and_messages(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else "é|x", [i]) for i in range(30)] + [(None, "n", None)], "k long, s string, a array<long>")
    got = {r.k: r.range for r in scan.in_ranges(rows, "k", [(None, 5), (3, 8), (25, None)]).collect()}
    assert got == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(5, 8), 1), **dict.fromkeys(range(25, 30), 2)}
    assert sorted(map(str, scan.of_messages(scan.as_messages(rows, "k"), rows.schema).collect())) == sorted(map(str, rows.collect()))


def test_settings(spark):
    own = settings.Settings.of({"shards": 3, "batch_rows": 7, "attempts": 2})
    engine = jobs.Engine(spark, settings=own)
    assert engine.spark.conf.get("spark.sql.shuffle.partitions") == "3" and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    for bad in ({"shards": 0}, {"attempts": True}, {"colour": 1}, {"shards": 5000}):
        with pytest.raises(spec.BadSpec):
            settings.Settings.of(bad)
    tries = []

    def source(s):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("once")
        return s.range(5)

    job = engine.run(spec.JobSpec("again", source))
    assert job.status is jobs.Status.SUCCESS and len(tries) == 2 and job.result.count() == 5


def test_hooks_and_clean_up(spark, tmp_path):
    told = []

    class Told(jobs.Hooks):
        def started(self, job):
            told.append("started")

        def attempt(self, job, number):
            told.append(number)

        def ended(self, job):
            told.append(job.status)

    engine = jobs.Engine(spark, Told())
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    job = engine.run(spec.JobSpec("j", lambda s: s.range(10).mapInArrow(count, "id long")))
    assert told == ["started", 0, jobs.Status.SUCCESS] and job.counters == {"rows": 10}
    assert job.result.count() == 10 and made.value == 10  # the rows were made once
    spark.range(3).write.parquet(f"{tmp_path}/left")
    engine.clean_up(job, f"{tmp_path}/left")
    assert not (tmp_path / "left").exists() and engine.jobs == {}


def only_even(row):
    if row["id"] % 2 == 0:
        yield (row["id"],)


def positive(params):
    if int(params["n"]) <= 0:
        raise spec.BadSpec("n must be positive")


def test_configurations(spark):
    text = json.dumps({"jobs": [{"name": "even", "mapper": "test_contracts.only_even", "validator": "test_contracts.positive", "params": [{"name": "n", "default": 10}, {"name": "must"}]}]})
    config = spec.registry(text)["even"]
    job = spec.bound(config, lambda s: s.range(10), "x long", must="given")
    assert sorted(r.x for r in job.build(spark).collect()) == [0, 2, 4, 6, 8] and job.params == {"n": 10, "must": "given"}
    for bad in ({"must": 1, "n": 0}, {}, {"must": 1, "other": 2}):
        with pytest.raises(spec.BadSpec):
            spec.bound(config, lambda s: s.range(10), "x long", **bad)
    for bad in ("{", "[]", '{"jobs": 3}', '{"jobs": [{"name": "x"}]}'):
        with pytest.raises(spec.BadSpec):
            spec.registry(bad)


def test_sharder_and_marshaller(spark):
    rows = spark.range(40).select(F.col("id").alias("key"))
    parts = ordering.hash_sharded(rows, 4, sharder=lambda k, n: k % n).withColumn("p", F.spark_partition_id())
    assert all(r.shard == r.key % 4 == r.p for r in parts.collect())
    with pytest.raises(Exception, match="outside"):
        ordering.hash_sharded(rows, 4, sharder=lambda k, n: k).collect()

    class Hex(codec.Marshaller):
        def encode(self, value):
            return b"%x" % value

        def decode(self, data):
            return int(data, 16)

    both = spark.createDataFrame([(10,), (None,)], "n long").select(codec.marshalled(F.col("n").cast("string").cast("long"), Hex()).alias("b"))
    assert [None if r.b is None else bytes(r.b) for r in both.collect()] in ([b"a", None],)
    assert [r.n for r in both.select(codec.unmarshalled(F.col("b"), Hex(), "long").alias("n")).collect()] == [10, None]


def test_fold_in_a_stream(spark, tmp_path):
    seen = {}

    def each(rows, number):
        for r in rows.collect():
            seen[r.key] = r.value

    fold = lambda key, new, so_far: iter([sum(new) + sum(so_far)])
    stream = lambda: slices.sliced(spark, f"{tmp_path}/in", T.StructType().add("key", "string").add("value", "long"))
    for n in range(2):  # a second run goes on from the first one's state
        spark.createDataFrame([("a", 1), ("b", 10 + n)], "key string, value long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        slices.running_fold(stream(), fold, "bigint", f"{tmp_path}/check", each)
    assert seen == {"a": 2, "b": 21}
