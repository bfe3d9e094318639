"""Block-compressed text (BGZF): a source whose files are read by many tasks, a sink, and windows read by offset.

A BGZF file is a row of gzip members of at most 64 KiB, each of which names its own size, so any gzip reader can read it
and reading can start at any member.  The source plans ranges of compressed bytes; a task looks for the first member that
begins in its range and owns the lines that begin after that member's first byte and up to the first byte of the next
range's first member, so every line is read once, whatever it crosses.  A task reads many small ranges that follow each
other in one pass.

A line's place is its virtual offset: the member's position shifted by 16 bits, plus the position in its text.
Paths are those that pyarrow's file systems know; a folder stands for the ``.gz`` and ``.bgz`` files below it.
"""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "isoloom_bgzf"
LINES = "value string, file string, block long, line long, at long"
#: Compressed bytes of a range, and those up to which a task takes several smaller ones once there are so many tasks.
SPLIT, TASKS = 32 << 20, 64
#: Bytes of text in a member, and lines of a batch.
TEXT, LINES_AT_ONCE = 65_280, 8192
#: Members that a task keeps unpacked while it cuts windows, which come in the order of the file.
KEPT = 4
_HEAD, _HEAD_BYTES = "<4BI2BH2BHH", 18
_MOST = 1 << 16
#: The empty member that ends a file.
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path.rstrip("/")


def member_size(head: bytes) -> int | None:
    """Bytes of the member whose first 18 are ``head``; None if they begin none."""
    if len(head) < _HEAD_BYTES:
        return None
    a, b, c, d, _, _, _, extra, s1, s2, n, size = struct.unpack(_HEAD, head[:_HEAD_BYTES])
    return size + 1 if (a, b, c, d & 4) == (31, 139, 8, 4) and extra >= 6 and (s1, s2, n) == (66, 67, 2) else None


def compressed(text: bytes) -> bytes:
    """One member."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(text) + z.flush()
    return struct.pack(_HEAD, 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(text), len(text))


class Members:
    """The members of an open file from a position on; ``kept`` holds the last few of them for readers of the same file."""

    def __init__(self, file, at: int, size: int, kept: dict[int, tuple[int, bytes]] | None = None):
        self.file, self.at, self.size, self.read_bytes = file, at, size, 0
        self.kept = kept

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(min(n, self.size - at))
        self.read_bytes += len(out)
        return out

    def find(self) -> None:
        """Go on to the first member at or after here: its header must be followed by another one, or by the end."""
        while self.at < self.size:
            data = self._bytes(self.at, 2 * _MOST)
            k = data.find(b"\x1f\x8b\x08\x04")
            while 0 <= k < _MOST:
                n = member_size(data[k : k + 18])
                if n and (self.at + k + n == self.size or member_size(self._bytes(self.at + k + n, 18))):
                    self.at += k
                    return
                k = data.find(b"\x1f\x8b\x08\x04", k + 1)
            self.at += _MOST

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.at < self.size:
            here = self.at
            if self.kept is not None and here in self.kept:
                n, text = self.kept[here]
                self.read_bytes += 18 + n
            else:
                n = member_size(self._bytes(here, 18))
                if n is None:
                    raise ValueError(f"no BGZF member at byte {here}")
                text = zlib.decompress(self._bytes(here, n), 31)
                if self.kept is not None:
                    while len(self.kept) >= KEPT:
                        del self.kept[next(iter(self.kept))]
                    self.kept[here] = n, text
            self.at = here + n
            yield here, text


@dataclass
class Range(InputPartition):
    """Ranges of ``split`` bytes of a file, from ``first`` to ``stop``."""

    file: str
    first: int
    stop: int
    size: int
    split: int


def owned_lines(members: Members, first: int, stop: int) -> Iterator[tuple[bytes, int]]:
    """(line, virtual offset) of the lines that a range of compressed bytes owns."""
    return ((line, at) for line, at, _ in placed_lines(members, first, stop, stop))


def placed_lines(members: Members, first: int, stop: int, split: int) -> Iterator[tuple[bytes, int, int]]:
    """(line, virtual offset, block) of the lines that the ranges of ``split`` compressed bytes from ``first`` to ``stop`` own, in
    one pass; the block is where the line's range begins."""
    members.at = first
    if first:
        members.find()
    skipping = first > 0  # the line that the range before ends with
    parts: list[bytes] = []
    start: int | None = None
    here = before = block = first  # ranges of this member, of the one before, and of the line
    ended = False  # past the range: only the line that begins at its end, or goes on there, is still ours
    for at, text in members:
        if at >= stop and not ended:
            if skipping:
                return
            ended = True
        if text:
            before, here = here, at // split * split
        k = 0
        while k < len(text):
            if start is None:
                start, block = at << 16 | k, here if k else before
            e = text.find(b"\n", k)
            parts.append(text[k : e if e >= 0 else len(text)])
            if e < 0:
                break
            if not skipping:
                yield b"".join(parts), start, block
            skipping, parts, start, k = False, [], None, e + 1
            if ended:
                return
    if start is not None and not skipping:
        yield b"".join(parts), start, block


class BgzfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        fs, path = _open(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File and f.base_name.endswith((".gz", ".bgz")) and f.base_name[0] not in "_."]
        most = max(1, min(SPLIT, sum(f.size for f in files) // TASKS) // self.split) * self.split
        return [Range(f.path, at, min(at + most, f.size), f.size, self.split) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, most)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.file) as file:
            rows: list[tuple[bytes, int]] = []
            n, block = 0, None
            for line, at, of in placed_lines(Members(file, partition.first, partition.size), partition.first, partition.stop, partition.split):
                if rows and (of != block or len(rows) == LINES_AT_ONCE):
                    yield _batch(rows, partition.file, block, n)
                    n += len(rows)
                    rows = []
                if of != block:
                    n, block = 0, of
                rows.append((line, at))
            if rows:
                yield _batch(rows, partition.file, block, n)


def _batch(rows: list[tuple[bytes, int]], file: str, block: int, n: int) -> pa.RecordBatch:
    value = pa.array([r.rstrip(b"\r").decode("utf-8", "replace") for r, _ in rows], pa.string())
    same = lambda x, t: pa.array([x] * len(rows), t)
    columns = [value, same(file, pa.string()), same(block, pa.int64()), pa.array(range(n, n + len(rows)), pa.int64()), pa.array([a for _, a in rows], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["value", "file", "block", "line", "at"])


@dataclass
class Written(WriterCommitMessage):
    name: str
    part: int


class BgzfWriter(DataSourceArrowWriter):
    """A file for each task, under a name of its own until all are done, so that repeated attempts leave nothing behind."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        name = f"{path}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(name, compression=None) as out:
            held = bytearray()
            for batch in iterator:
                for line in batch.column(0).to_pylist():
                    held += (line or "").encode() + b"\n"
                    while len(held) >= TEXT:
                        out.write(compressed(bytes(held[:TEXT])))
                        del held[:TEXT]
            if held:
                out.write(compressed(bytes(held)))
            out.write(_END)
        return Written(name, TaskContext.get().partitionId())

    def commit(self, messages: list) -> None:
        fs, path = _open(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.name, f"{path}/part-{m.part:05d}.gz")

    def abort(self, messages: list) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.name)


class Bgzf(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return BgzfReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BgzfWriter(self.options)


def _registered(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Spark's helper process need not find this package
    spark.dataSource.register(Bgzf)


def read_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(value, file, block, line, at): lines with the range and the number in it that they have, and their virtual offset."""
    _registered(spark)
    return spark.read.format(FORMAT).option("path", path).option("split", split).load()


def write_lines(df: DataFrame, path: str) -> None:
    """The strings of the first column as lines of BGZF files, one a task."""
    _registered(df.sparkSession)
    df.toDF(*(f"c{k}" for k in range(len(df.columns)))).select("c0").write.format(FORMAT).mode("append").option("path", path).save()


def fasta_index(lines: DataFrame, size: int) -> DataFrame:
    """(chrom, chunk_id, file, at, line_start, length): where reading must begin for each stretch of ``size`` bases: the line
    that holds its first one.  ``lines`` come from ``readers.fasta_lines`` (chrom, at_base, bases, file, at)."""
    n = F.length("bases")
    first = F.ceil(F.col("at_base") / size)
    last = F.floor((F.col("at_base") + n - 1) / size)
    rows = lines.withColumn("chunk_id", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    length = lines.groupBy("chrom").agg(F.max(F.col("at_base") + n).alias("length"))
    return rows.select("chrom", "chunk_id", "file", "at", F.col("at_base").alias("line_start")).join(length.hint("merge"), "chrom")


def read_windows(windows: DataFrame, index: DataFrame, path: str, size: int) -> DataFrame:
    """``windows`` (chrom, start, end) with ``seq``, N beyond either end, and ``bytes_read``: each reads only the members that
    hold its bases, found by an index of the files at ``path``; ``bytes_read`` counts a member for every window that it serves, though
    those that follow each other unpack it once.  Windows of contigs that the index lacks are left out, and
    one that lies outside its contig reads nothing."""
    at = F.floor(F.least(F.greatest("start", F.lit(0)), F.col("length") - 1) / size)
    lengths = index.where("chunk_id = 0").select("chrom", "length")
    placed = windows.select("chrom", "start", "end").distinct().join(lengths.hint("merge"), "chrom").withColumn("chunk_id", at)
    placed = placed.join(index.drop("length").hint("merge"), ["chrom", "chunk_id"])
    near = placed.repartitionByRange("file", "at").sortWithinPartitions("file", "at")
    return near.select("chrom", "start", "end", "length", "file", "at", "line_start").mapInArrow(_Windows(path), "chrom string, start long, end long, seq string, bytes_read long")


class _Windows:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        name, file, size, kept = None, None, 0, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    name, file, size, kept = r["file"], fs.open_input_file(r["file"]), fs.get_file_info(r["file"]).size, {}
                lo, hi = max(r["start"], 0), min(r["end"], r["length"])
                seq, n = _bases(Members(file, r["at"] >> 16, size, kept), r["at"] & 0xFFFF, lo - r["line_start"], hi - r["line_start"]) if hi > lo else ("", 0)
                left = min(max(0, -r["start"]), r["end"] - r["start"])
                out.append((r["chrom"], r["start"], r["end"], "N" * left + seq + "N" * (r["end"] - r["start"] - left - len(seq)), n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["chrom", "start", "end", "seq", "bytes_read"])


def _bases(members: Members, skip: int, first: int, stop: int) -> tuple[str, int]:
    """The bases first to stop of the text after ``skip`` bytes of the first member, line ends aside, and the bytes read."""
    seen, parts = 0, []
    for _, text in members:
        bases = b"".join(text[skip:].split())
        skip = 0
        if seen + len(bases) > first:
            parts.append(bases[max(0, first - seen) : stop - seen])
        seen += len(bases)
        if seen >= stop:
            break
    return b"".join(parts).upper().decode(), members.read_bytes
