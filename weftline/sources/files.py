"""File sources: records by separator, lines with byte offsets, whole files, zip archives, stitched segments."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import byte_ranges


def records(spark: SparkSession, paths: str | Sequence[str], separator: str = "\n") -> DataFrame:
    """(record): what stands between separators; one at the end adds no empty record. Spark splits large files."""
    return spark.read.option("lineSep", separator).text(paths if isinstance(paths, str) else list(paths)).withColumnRenamed("value", "record")


def files(spark: SparkSession, paths: Sequence[str], keep: Column | None = None, strict: bool = False, shallow: bool = True) -> DataFrame:
    """(path, content) of every file; ``prefix*`` is a glob. A path given twice is read twice.

    ``keep`` is a predicate on the column path. Missing files are skipped unless ``strict``.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        matches = at.getFileSystem(conf).globStatus(at)
        if matches is not None and len(matches):
            found.append(path)
        elif strict:
            raise FileNotFoundError(path)
    if not found:
        return spark.createDataFrame([], "path string, content binary")
    each = [spark.read.format("binaryFile").option("recursiveFileLookup", str(not shallow).lower()).load(p).select("path", "content") for p in found]
    out = each[0]
    for more in each[1:]:
        out = out.unionAll(more)
    return out if keep is None else out.where(keep)


def line_offsets(texts: DataFrame, key: str, text: str, separator: str = "\n") -> DataFrame:
    """(key, byte_offset, line) for each line of a text column; offsets count UTF-8 bytes from the text's start."""
    sep = len(separator.encode())
    lines = texts.select(key, F.posexplode(F.split(text, _quoted(separator), -1)).alias("n", "line"), F.size(F.split(text, _quoted(separator), -1)).alias("of"))
    kept = lines.where((F.col("n") + 1 < F.col("of")) | (F.col("line") != ""))
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return kept.select(key, F.coalesce(F.sum(F.octet_length("line") + sep).over(before), F.lit(0)).cast("long").alias("byte_offset"), "line")


def opened(path: str):  # noqa: ANN201
    """(file system, path in it) of a path or URI that executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def lines_at(spark: SparkSession, paths: Sequence[str], shards: int = 8, least_bytes: int = 1 << 20) -> DataFrame:
    """(path, byte_offset, line) of files' lines, read by byte ranges: a line belongs to the range that its first byte is in.

    Each file is cut into at most ``shards`` ranges of ``least_bytes`` or more; no task reads more than its range and the
    end of its last line. Lines end with a line feed; bytes that are no UTF-8 are replaced.
    """
    ranges = []
    for path in paths:
        system, inside = opened(path)
        size = system.get_file_info(inside).size or 0
        ranges += [(path, a, b) for a, b in byte_ranges(size, shards, least_bytes)] if size else []
    schema = "path string, byte_offset long, line string"
    if not ranges:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, inside = opened(r["path"])
                with system.open_input_file(inside) as raw:
                    raw.seek(max(0, r["low"] - 1))
                    with io.BufferedReader(_Raw(raw)) as f:
                        at = max(0, r["low"] - 1)
                        if r["low"]:
                            at += len(f.readline())  # the end of a line that began before, or one line feed
                        offsets, lines = [], []
                        while at < r["high"] and (line := f.readline()):
                            offsets.append(at)
                            lines.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
                            at += len(line)
                            if len(lines) == 10_000 or at >= r["high"]:
                                yield pa.RecordBatch.from_pydict({"path": [r["path"]] * len(lines), "byte_offset": offsets, "line": lines}, _LINES)
                                offsets, lines = [], []
                        if lines:
                            yield pa.RecordBatch.from_pydict({"path": [r["path"]] * len(lines), "byte_offset": offsets, "line": lines}, _LINES)

    return spark.createDataFrame(ranges, "path string, low long, high long").repartition(len(ranges), "path", "low").mapInArrow(run, schema)


_LINES = pa.schema([("path", pa.string()), ("byte_offset", pa.int64()), ("line", pa.string())])


class _Raw(io.RawIOBase):
    """An Arrow file as Python's raw streams, for buffered lines."""

    def __init__(self, file) -> None:  # noqa: ANN001
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:  # noqa: ANN001
        got = self.file.read(len(into))
        into[: len(got)] = got
        return len(got)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name under ``spark.checkpoint.dir``, which all executors reach; local mode may do without the setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _quoted(separator: str) -> str:
    return "".join(rf"\x{ord(c):02x}" for c in separator)


def unzipped(archives: DataFrame) -> DataFrame:
    """(path, file_index, filename, file_size, content): every member of every archive (path, content), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for i, info in enumerate(x for x in archive.infolist() if not x.is_dir()):
                        yield pa.RecordBatch.from_pydict({"path": [path], "file_index": [i], "filename": [info.filename], "file_size": [info.file_size], "content": [archive.read(info)]}, pa.schema([("path", pa.string()), ("file_index", pa.int32()), ("filename", pa.string()), ("file_size", pa.int64()), ("content", pa.binary())]))

    return archives.select("path", "content").mapInArrow(run, "path string, file_index int, filename string, file_size long, content binary")


def zip_lines(archives: DataFrame) -> DataFrame:
    """(path, file_index, byte_offset, line) of the lines of every archive member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, rows = 0, {"path": [], "file_index": [], "byte_offset": [], "line": []}
                for line in io.BytesIO(r["content"]):
                    for k, v in (("path", r["path"]), ("file_index", r["file_index"]), ("byte_offset", at), ("line", line.rstrip(b"\n").decode("utf-8", "replace"))):
                        rows[k].append(v)
                    at += len(line)
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("path", pa.string()), ("file_index", pa.int32()), ("byte_offset", pa.int64()), ("line", pa.string())]))

    return unzipped(archives).select("path", "file_index", "content").mapInArrow(run, "path string, file_index int, byte_offset long, line string")


def stitched(segments: DataFrame) -> DataFrame:
    """(name, content): segments (name, seq, valid_length, content) cut to their valid length and joined in order.

    A name's file is held by one task, as its reader would see it.
    """
    cut = F.struct("seq", F.expr("substring(content, 1, cast(valid_length as int))").alias("c"))
    joined = F.aggregate(F.array_sort(F.collect_list(cut)), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["c"]))
    return segments.groupBy("name").agg(joined.alias("content"))
