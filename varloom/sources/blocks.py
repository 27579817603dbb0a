"""Lines of block-compressed text (bgzip): a Python data source that reads and writes blocks in parallel.

A block is a gzip member of 64 KiB at most that tells its own size, so a task can begin at any byte:
it looks for the next block from there. Ranges are planned over compressed bytes, from file sizes
alone. A task owns the lines that begin behind its first block's first byte (the first task of a file:
from it) up to the first byte of the block that the next task begins with, and reads on to the end of
the last one. Files are opened through pyarrow's file systems, by path or address.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Compressed bytes of a task, and bytes that are read, decompressed or given on at once.
SPLIT, CHUNK = 32 << 20, 4 << 20
#: Fixed values of the format: a block's first bytes, its empty last block, and the text bytes of a block.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
TEXT = 0xFF00


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str


def files(path: str) -> list[tuple[str, int]]:
    """(address, bytes) of a file, or of a folder's files in order of name, hidden ones left out."""
    where, base = fs.FileSystem.from_uri(path)
    info = where.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else sorted(where.get_file_info(fs.FileSelector(base)), key=lambda i: i.path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    host = path[len(scheme) :].split("/")[0] if scheme and not base.startswith(path[len(scheme) :].split("/")[0] or "/") else ""
    return [(f"{scheme}{host}{i.path}", i.size) for i in found if i.is_file and not i.base_name.startswith(("_", "."))]


def _open(path: str) -> pa.NativeFile:
    where, base = fs.FileSystem.from_uri(path)
    return where.open_input_file(base)


def block_size(data: bytes, at: int = 0) -> int:
    """Bytes of the block that begins there, 0 where none does."""
    if data[at : at + 4] != MAGIC or len(data) < at + 18:
        return 0
    extra, = struct.unpack_from("<H", data, at + 10)
    x, stop = at + 12, min(at + 12 + extra, len(data))
    while x + 6 <= stop:
        n, = struct.unpack_from("<H", data, x + 2)
        if data[x : x + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", data, x + 4)[0] + 1
        x += 4 + n
    return 0


def first_block(file: pa.NativeFile, start: int, size: int) -> int:
    """Where the first block from start on begins: its bytes lead to another block or to the end."""
    data = file.read_at(min(size - start, 3 << 16), start) if start < size else b""
    at = data.find(MAGIC)
    while at >= 0:
        n = block_size(data, at)
        if n and (start + at + n == size or block_size(data, at + n)):
            return start + at
        at = data.find(MAGIC, at + 1)
    return size


def blocks(file: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the blocks from that of start on."""
    data, at = b"", start
    while at < size:
        n = block_size(data)
        if not n or len(data) < n:
            more = file.read_at(min(CHUNK, size - at - len(data)), at + len(data))
            if not more:
                raise ValueError(f"broken block at byte {at}")
            data += more
            continue
        view, used = memoryview(data), 0
        while n and used + n <= len(data):
            extra, = struct.unpack_from("<H", data, used + 10)
            text = zlib.decompress(view[used + 12 + extra : used + n - 8], -15)
            if zlib.crc32(text) != struct.unpack_from("<I", data, used + n - 8)[0]:
                raise ValueError(f"checksum of the block at byte {at + used}")
            yield at + used, text
            used += n
            n = block_size(data, used)
        data, at = bytes(view[used:]), at + used


def owned_text(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines of a range, some whole lines at a time."""
    with _open(path) as file:
        size = file.size()
        at = first_block(file, start, size) if start else 0
        held, open_, begun = [], 0, start == 0
        if at >= end:
            return
        for place, text in blocks(file, at, size):
            if not begun:
                if place >= end:
                    return
                cut = text.find(b"\n") + 1
                if not cut:
                    continue
                begun, text = True, text[cut:]
            elif place >= end and (cut := text.find(b"\n") + 1):
                held.append(text[:cut])
                break
            held.append(text)
            open_ += len(text)
            if open_ >= CHUNK and b"\n" in text:
                blob = b"".join(held)
                cut = blob.rfind(b"\n") + 1
                yield blob[:cut]
                held, open_ = [blob[cut:]], len(blob) - cut
        yield b"".join(held)


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.columns = [int(i) + 9 for i in options["samples"].split(",")] if options.get("samples") else None
        self.regions = [_region(r) for r in options["regions"].split(",")] if options.get("regions") else None

    def partitions(self) -> list[Range]:
        out = [Range(p, at, min(at + self.split, n)) for p, n in files(self.path) for at in range(0, n, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.end:
            return
        for blob in owned_text(partition.path, partition.start, partition.end):
            lines = blob.replace(b"\r\n", b"\n").split(b"\n")
            if not lines[-1]:
                lines.pop()
            if self.regions is not None:
                lines = [x for x in lines if x[:1] == b"#" or self.inside(x)]
            if self.columns is not None:
                lines = [self.pruned(x) for x in lines]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], ["value"])

    def inside(self, line: bytes) -> bool:
        chrom, pos, *_ = [*line.split(b"\t", 2), b""]
        if not pos.isdigit():
            return False
        chrom, at = chrom.decode().removeprefix("chr"), int(pos)
        return any(chrom == c and low <= at <= high for c, low, high in self.regions)

    def pruned(self, line: bytes) -> bytes:
        if line[:2] == b"##" or line.count(b"\t") < 9:
            return line
        cells = line.split(b"\t")
        return b"\t".join(cells[:9] + [cells[i] if i < len(cells) else b"." for i in self.columns])


def _region(text: str) -> tuple[str, int, int]:
    """chrom, chrom:pos or chrom:from-to, both ends included."""
    chrom, _, span = text.partition(":")
    low, _, high = span.partition("-")
    return chrom.removeprefix("chr"), int(low or 0), int(high or low or 1 << 62)


def block(text: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    head = MAGIC + bytes([0, 0, 0, 0, 0, 255, 6, 0]) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


class BlockWriter(DataSourceArrowWriter):
    """A file of blocks a task. Tasks write hidden files, which get their names once all are written."""

    def __init__(self, options: dict):
        self.path, self.header, self.run = options["path"], options.get("header", ""), uuid.uuid4().hex

    def _place(self, name: str) -> tuple[fs.FileSystem, str]:
        where, base = fs.FileSystem.from_uri(self.path)
        where.create_dir(base, recursive=True)
        return where, f"{base}/{name}"

    def _write(self, name: str, texts: Iterator[bytes]) -> None:
        where, path = self._place(name)
        with where.open_output_stream(path, compression=None) as out:
            held = b""
            for text in texts:
                held += text
                while len(held) >= TEXT:
                    out.write(block(held[:TEXT]))
                    held = held[TEXT:]
            if held:
                out.write(block(held))
            out.write(END)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"_{self.run}-{uuid.uuid4().hex}.gz"
        parts = ("".join(f"{x}\n" for x in b.column(0).slice(at, 1024).to_pylist() if x is not None) for b in iterator for at in range(0, b.num_rows, 1024))
        self._write(name, (p.encode() for p in parts))
        return Written(name)

    def commit(self, messages: list) -> None:
        if self.header:
            self._write(f"part-00000-{self.run}.gz", iter([self.header.encode()]))
        for i, m in enumerate(messages):
            where, path = self._place(m.name)
            where.move(path, self._place(f"part-{i + 1:05d}-{self.run}.gz")[1])

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                where, path = self._place(m.name)
                where.delete_file(path)


class BlockLines(DataSource):
    """Format "block_lines". Options of a read: path, split (bytes of a task), samples (places among the
    sample columns, comma-joined, in the order asked for), regions (chrom:from-to, comma-joined); of a
    write: path, header (lines before all others). An empty folder gives no lines."""

    @classmethod
    def name(cls) -> str:
        return "block_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> BlockReader:  # noqa: ANN001
        return BlockReader(self.options)

    def writer(self, schema, overwrite: bool) -> BlockWriter:  # noqa: ANN001
        return BlockWriter(self.options)


def is_blocked(path: str) -> bool:
    """Whether the first file that has bytes begins with a block."""
    for name, size in files(path):
        if size:
            with _open(name) as file:
                return block_size(file.read_at(min(size, 1 << 12), 0)) > 0
    return False


def read_block_lines(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    spark.dataSource.register(BlockLines)
    return spark.read.format("block_lines").option("path", path).options(**options).load()


def write_block_lines(lines: DataFrame, path: str, header: str = "") -> None:
    """Writes column value as files of blocks, those of a header first."""
    lines.sparkSession.dataSource.register(BlockLines)
    lines.select("value").write.format("block_lines").option("path", path).option("header", header).mode("append").save()


def head_lines(path: str, mark: str = "#") -> list[str]:
    """The lines that begin with mark at the beginning of the first file that has such lines; no more
    of a file is read than holds them. Blocks, any gzip and plain text."""
    for name, size in files(path):
        with _open(name) as file:
            unzip = zlib.decompressobj(31) if file.read_at(min(size, 2), 0) == MAGIC[:2] else None
            text, at, done = b"", 0, False
            while not done:
                data = file.read_at(min(1 << 16, size - at), at)
                at += len(data)
                while unzip and data:
                    text += unzip.decompress(data)
                    data, unzip = (unzip.unused_data, zlib.decompressobj(31)) if unzip.eof else (b"", unzip)
                text += data
                lines = text.split(b"\n")
                done = at >= size or any(x and not x.startswith(mark.encode()) for x in lines[:-1])
        head = []
        for x in lines:
            if not x.startswith(mark.encode()):
                break
            head.append(x.decode().rstrip("\r"))
        if head:
            return head
    return []
