"""Record logs: checksummed records framed in 32 KiB blocks, as a Python data source named ``recordlog``.

A block holds fragments of a 7-byte header (masked CRC-32C of kind and data, length, kind) and data; a record that
doesn't fit is spread over fragments of kinds first, middle and last. Fewer than 7 bytes left of a block are zeros.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.hashing import crc32c, masked
from .files import opened

BLOCK, HEADER = 32 * 1024, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


class CorruptRecords(ValueError):
    """Bytes that are no record log."""


def encode(records: Iterable[bytes]) -> Iterator[bytes]:
    """The log's bytes, piece by piece."""
    left = BLOCK
    for record in records:
        at, begun = 0, False
        while True:
            if left < HEADER:
                yield b"\0" * left
                left = BLOCK
            piece = record[at : at + left - HEADER]
            at += len(piece)
            done = at == len(record)
            kind = (LAST if begun else FULL) if done else (MIDDLE if begun else FIRST)
            yield struct.pack("<IHB", masked(crc32c(piece, crc32c(bytes([kind])))), len(piece), kind) + piece
            left -= HEADER + len(piece)
            begun = True
            if done:
                break


def _fragments(block: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + HEADER <= len(block):
        crc, size, kind = struct.unpack_from("<IHB", block, at)
        if kind == 0 and size == 0 and crc == 0:
            return
        piece = block[at + HEADER : at + HEADER + size]
        if kind not in (FULL, FIRST, MIDDLE, LAST) or len(piece) != size or masked(crc32c(piece, crc32c(bytes([kind])))) != crc:
            raise CorruptRecords(f"bad fragment at {at}")
        yield kind, piece
        at += HEADER + size


def decode(data: bytes, permissive: bool = False) -> Iterator[bytes]:
    """The records. A bad fragment is an error, or, if permissive, the rest of its block is passed over."""
    parts: list[bytes] | None = None
    for start in range(0, len(data), BLOCK):
        try:
            for kind, piece in _fragments(data[start : start + BLOCK]):
                if (kind in (FULL, FIRST)) != (parts is None):
                    if not permissive:
                        raise CorruptRecords("fragments out of order")
                    parts = None
                    if kind in (MIDDLE, LAST):
                        continue
                if kind == FULL:
                    yield piece
                    continue
                parts = [*(parts or []), piece]
                if kind == LAST:
                    yield b"".join(parts)
                    parts = None
        except CorruptRecords:
            if not permissive:
                raise
            parts = None
    if parts is not None and not permissive:
        raise CorruptRecords("the last record has no end")


def decode_from(blocks: Iterator[bytes], own: int, first: bool, permissive: bool = False) -> Iterator[bytes]:
    """The records that begin in the first ``own`` of some blocks; where these aren't the file's ``first``, the rest of a record before is passed over."""
    parts: list[bytes] | None = None
    skip = not first
    for n, block in enumerate(blocks):
        try:
            for kind, piece in _fragments(block):
                if skip and kind in (MIDDLE, LAST):
                    continue
                skip = False
                if (kind in (FULL, FIRST)) != (parts is None):
                    if not permissive:
                        raise CorruptRecords("fragments out of order")
                    parts = None
                    if kind in (MIDDLE, LAST):
                        continue
                if kind in (FULL, FIRST) and n >= own:
                    return
                if kind == FULL:
                    yield piece
                    continue
                parts = [*(parts or []), piece]
                if kind == LAST:
                    yield b"".join(parts)
                    parts = None
        except CorruptRecords:
            if not permissive:
                raise
            parts = None
        if n + 1 >= own and parts is None:
            return
    if parts is not None and not permissive:
        raise CorruptRecords("the last record has no end")


#: Blocks of a file that one task reads.
TASK_BLOCKS = 1024


@dataclass
class _Blocks(InputPartition):
    path: str
    first: int
    blocks: int


class _Reader(DataSourceReader):
    """Files of a folder, a file or a glob; a large file is cut at its blocks, so no task holds one."""

    def __init__(self, options: dict) -> None:
        self.path, self.permissive = options["path"], options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.task_blocks = int(options.get("blocks", TASK_BLOCKS))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, size in listed(self.path):
            n = -(-size // BLOCK)
            out += [_Blocks(path, b, min(self.task_blocks, n - b)) for b in range(0, n, self.task_blocks)]
        return out or [_Blocks("", 0, 0)]

    def read(self, partition: _Blocks) -> Iterator[tuple[bytes]]:
        if partition.path:
            system, inside = opened(partition.path)
            with system.open_input_file(inside) as f:
                f.seek(partition.first * BLOCK)
                for record in decode_from(iter(lambda: f.read(BLOCK), b""), partition.blocks, partition.first == 0, self.permissive):
                    yield (record,)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the logs that a folder, a file or a glob names, in order."""
    from pyarrow import fs

    system, inside = opened(path)
    scheme = path[: len(path) - len(path.split("://", 1)[-1])] if "://" in path else ""
    folder = inside if not any(c in inside for c in "*?[") and system.get_file_info(inside).type == fs.FileType.Directory else inside.rpartition("/")[0]
    pattern = f"{inside.rstrip('/')}/*.log" if folder == inside else inside
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    names = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch(f.path, pattern) and not f.base_name.startswith("."))
    return [(f"{scheme}{n}", size) for n, size in names]


@dataclass
class _Written(WriterCommitMessage):
    staged: str
    final: str


class _Writer(DataSourceWriter):
    """Each task writes a file of its own under a hidden name; the driver renames them once all have ended."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, inside = opened(self.path)
        system.create_dir(inside, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.log"
        staged = f"{inside.rstrip('/')}/.{name}"
        with system.open_output_stream(staged) as f:
            for piece in encode(bytes(r[0]) for r in rows):
                f.write(piece)
        return _Written(staged, f"{inside.rstrip('/')}/{name}")

    def commit(self, messages: list) -> None:
        system, _ = opened(self.path)
        if self.overwrite:
            for old, _ in listed(self.path):
                system.delete_file(opened(old)[1])
        for m in messages:
            if m is not None:
                system.move(m.staged, m.final)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, _ = opened(self.path)
        for m in messages:
            if m is not None and system.get_file_info(m.staged).type == fs.FileType.File:
                system.delete_file(m.staged)


class RecordLog(DataSource):
    """Files ``*.log`` of a folder that all executors reach, a path or a URI; options path, mode (FAILFAST or PERMISSIVE) and blocks (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "recordlog"

    def schema(self) -> str:
        return "record binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordLog)
