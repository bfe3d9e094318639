"""Numbered shards of one Parquet file each, as a Python data source that is written to and read.

Spark's own writer spends some 45 ms on a folder of one small file where the store is a local or mounted folder (it starts a
process to set each file's mode), which is all the time there is where shards are many; and its reader lists a folder a task,
keeps all files in the driver and spends some 6 ms on each.  Here a task writes the shards of its rows one after the other,
each under a hidden name first and then in one move to ``shard=<number>/part.parquet``; so a task that runs again, or twice at
once, moves the same file to the same place.  ``_SUCCESS`` names the numbers that there are, as runs, and readers take so many
of them a task.

A task gets its rows in one of two ways: all rows of a shard are in one partition, side by side (``write_numbered``), or the rows
of the whole table lie in order in files, and a task cuts one file (``write_cut``).

Paths are those that pyarrow's file systems know.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "isoloom_numbered_shards"
#: Shards that a task reads, rows of a batch, and bytes that are buffered of a file that is cut and of one that is written.
SHARDS, ROWS, READ, WRITE = 1000, 65_536, 1 << 20, 1 << 16


@dataclass
class Written(WriterCommitMessage):
    """The shards of a task, as runs (first, stop) of numbers."""

    runs: list[tuple[int, int]]


@dataclass
class Piece:
    """A file of the rows in order: the sum of what lies before it, and the shard of its last row."""

    file: str
    before: int
    last: int


@dataclass
class Runs(InputPartition):
    """Runs (first, stop) of shard numbers: the work of one task."""

    runs: list[tuple[int, int]]


class NumberedShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return (CutWriter if "pieces" in self.options else ShardWriter)(self.options)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShardReader(self.options, schema)


class _Shards:
    """The shards that a task writes one after the other."""

    def __init__(self, fs: pafs.FileSystem, root: str, column: str):
        self._fs, self._root, self._column = fs, root, column
        self._file = self._sink = self._number = None
        self.runs: list[tuple[int, int]] = []

    def put(self, number: int, rows: pa.Table) -> None:
        if self._file is None or number != self._number:
            self.finish()
            self._number = number
            first = self.runs.pop()[0] if self.runs and self.runs[-1][1] == number else number
            self.runs.append((first, number + 1))
            self._folder = f"{self._root}/{self._column}={number}"
            self._fs.create_dir(self._folder, recursive=True)
            self._hidden = f"{self._folder}/.{uuid.uuid4().hex}.parquet"
            self._sink = self._fs.open_output_stream(self._hidden, buffer_size=WRITE)
            self._file = pq.ParquetWriter(self._sink, rows.schema, compression="snappy", store_schema=False)
        self._file.write_table(rows)

    def put_runs(self, numbers: pa.Array, rows: pa.Table) -> None:
        runs = pc.run_end_encode(numbers, run_end_type=pa.int64())
        first = 0
        for number, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            self.put(number, rows.slice(first, stop - first))
            first = stop

    def finish(self) -> None:
        if self._file is not None:
            self._file.close()
            self._sink.close()
            self._fs.move(self._hidden, f"{self._folder}/part.parquet")
            self._file = None


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.column = options["path"], options["column"]

    def _open(self) -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        return fs, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        shards = _Shards(*self._open(), self.column)
        for batch in iterator:
            at = batch.schema.get_field_index(self.column)
            shards.put_runs(batch.column(at), pa.Table.from_batches([batch]).remove_column(at))
        shards.finish()
        return Written(shards.runs)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = self._open()
        fs.create_dir(root, recursive=True)
        runs: list[tuple[int, int]] = []
        for first, stop in sorted(r for m in messages if isinstance(m, Written) for r in m.runs):
            runs.append((runs.pop()[0] if runs and runs[-1][1] == first else first, stop))
        with fs.open_output_stream(f"{root}/_SUCCESS") as f:
            f.write(json.dumps(runs).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """The shards of the tasks that were done go; whoever reads knows by _SUCCESS that the others are not all."""
        fs, root = self._open()
        for m in messages:
            for number in (k for first, stop in m.runs for k in range(first, stop)) if isinstance(m, Written) else ():
                fs.delete_dir(f"{root}/{self.column}={number}")


class CutWriter(ShardWriter):
    """Gets numbers of pieces and writes the shards that begin in them; where the last one goes on in the pieces that follow, its
    rows are read from there."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.pieces = [Piece(**p) for p in json.loads(options["pieces"])]
        self.value, self.budget = options["value"], int(options["budget"])
        self.schema = StructType.fromJson(json.loads(options["schema"]))

    def _batches(self, piece: Piece) -> Iterator[tuple[np.ndarray, pa.Table]]:
        """(shard numbers, which never fall; rows) of a piece."""
        from pyspark.sql.pandas.types import to_arrow_schema

        want, before = to_arrow_schema(self.schema), piece.before
        fs, path = pafs.FileSystem.from_uri(piece.file)
        with fs.open_input_file(path) as f:
            file = pq.ParquetFile(f, buffer_size=READ, pre_buffer=False, coerce_int96_timestamp_unit="us")
            for batch in file.iter_batches(ROWS, columns=[*want.names, self.value]):
                value = batch.column(self.value).to_numpy()
                sums = before + np.cumsum(value)
                before = int(sums[-1])
                yield (sums - value) // self.budget, pa.Table.from_batches([batch]).select(want.names).cast(want)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        shards = _Shards(*self._open(), self.column)
        for k in (k for batch in iterator for k in batch.column(0).to_pylist()):
            last = self.pieces[k].last
            begun = self.pieces[k - 1].last if k else -1
            for numbers, rows in self._batches(self.pieces[k]):
                first = int(np.searchsorted(numbers, begun, "right"))
                shards.put_runs(pa.array(numbers[first:]), rows.slice(first))
            while last != begun and (k := k + 1) < len(self.pieces) and self.pieces[k].before // self.budget == last:
                for numbers, rows in self._batches(self.pieces[k]):
                    stop = int(np.searchsorted(numbers, last, "right"))
                    if stop:
                        shards.put(last, rows.slice(0, stop))
                    if stop < len(numbers):
                        break
            shards.finish()
        return Written(shards.runs)


class ShardReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.column, self.schema = options["path"], options["column"], schema

    def _open(self) -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        return fs, root.rstrip("/")

    def partitions(self) -> list[Runs]:
        fs, root = self._open()
        with fs.open_input_stream(f"{root}/_SUCCESS") as f:
            runs = json.loads(f.read())
        out, room = [], 0
        for first, stop in runs:
            while first < stop:
                if not room:
                    out.append(Runs([]))
                    room = SHARDS
                n = min(room, stop - first)
                out[-1].runs.append((first, first + n))
                first, room = first + n, room - n
        return out or [Runs([])]

    def read(self, partition: Runs) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, root = self._open()
        want = to_arrow_schema(self.schema)
        stored = [n for n in want.names if n not in (self.column, "file")]
        held: list[tuple[int, str, pa.RecordBatch]] = []
        rows = 0

        def batches() -> Iterator[pa.RecordBatch]:
            numbers, names, found = zip(*held, strict=True)
            each = np.repeat(np.arange(len(held)), [b.num_rows for b in found])
            made = {self.column: pa.array(numbers).take(each), "file": pa.array(names).take(each)}
            table = pa.Table.from_batches(found).combine_chunks()
            yield from pa.table([made[n] if n in made else table[n] for n in want.names], want.names).cast(want).to_batches()

        for number in (k for first, stop in partition.runs for k in range(first, stop)):
            for found in fs.get_file_info(pafs.FileSelector(f"{root}/{self.column}={number}")):
                if found.base_name[0] in "_.":
                    continue
                with fs.open_input_file(found.path) as f:
                    file = pq.ParquetFile(f, pre_buffer=False, coerce_int96_timestamp_unit="us")
                    for batch in file.iter_batches(ROWS, columns=stored, use_threads=False):
                        held.append((number, found.base_name, batch))
                        rows += batch.num_rows
                        if rows >= ROWS:
                            yield from batches()
                            held, rows = [], 0
        if held:
            yield from batches()


def _register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Spark's helper process need not find this package
    spark.dataSource.register(NumberedShards)


def _new(path: str) -> None:
    fs, root = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(root).type != pafs.FileType.NotFound:
        raise FileExistsError(path)


def write_numbered(df: DataFrame, path: str, column: str) -> None:
    """A folder ``column``=number of one file for each number; all rows of a number must be in one partition of ``df``, side by
    side.  The path must not exist."""
    _new(path)
    _register(df.sparkSession)
    df.write.format(FORMAT).option("path", path).option("column", column).mode("append").save()


def write_cut(spark: SparkSession, pieces: Sequence[Piece], schema: StructType, value: str, budget: int, path: str, column: str) -> None:
    """The same folders from rows that lie in files in order: a row's number is the sum of ``value`` over all rows before it, none
    of them negative, divided by ``budget``.  ``schema`` is that of the columns to write."""
    _new(path)
    _register(spark)
    options = {"path": path, "column": column, "value": value, "budget": budget, "schema": schema.json(), "pieces": json.dumps([asdict(p) for p in pieces])}
    spark.range(0, len(pieces), 1, max(1, len(pieces))).write.format(FORMAT).options(**options).mode("append").save()


def read_numbered(spark: SparkSession, path: str, schema: StructType, column: str) -> DataFrame:
    """What was written, with the columns of ``schema``; those named ``column`` and ``file`` are a row's shard and the name of its file
    in the shard's folder."""
    _register(spark)
    return spark.read.format(FORMAT).schema(schema).option("path", path).option("column", column).load()
