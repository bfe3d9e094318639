"""A stream of Parquet shards in the order of their names, as a Python data source.

A position is (file, row groups of it that are done), so order and restarts depend on names alone, never on file times.  A
batch is the next file, or as many of its row groups as hold ``rows`` rows (one at least).  Spark's own offset log says
what a restarted query has done, but doesn't tell the source; so ``progress`` names a file, of this query alone like its
checkpoint, in which the source keeps the last position that it gave out, before it does so.  After a restart it goes on
from there: Spark has that position in its log, or else takes the batch together with the next one.

Paths are those that pyarrow's file systems know.  A file whose name sorts before what has been read is never read.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "isoloom_shards"


@dataclass
class Groups(InputPartition):
    """Some row groups of a file: the work of one task."""

    file: str
    first: int
    stop: int


class ShardStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ShardReader(self.options, schema)


class ShardReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.rows = int(options["rows"]) if options.get("rows") else None
        self.progress = options["progress"]
        self.at: tuple[str, int] | None = None

    def _open(self) -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        return fs, root.rstrip("/")

    def _names(self) -> list[str]:
        fs, root = self._open()
        found = (f.path[len(root) + 1 :] for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File)
        return sorted(n for n in found if n.endswith(".parquet") and not any(p[0] in "_." for p in n.split("/")))

    def _sizes(self, name: str) -> list[int]:
        """Rows of each row group of a file, from its footer."""
        fs, root = self._open()
        with fs.open_input_file(f"{root}/{name}") as f:
            meta = pq.ParquetFile(f).metadata
            return [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]

    def _next(self, file: str, done: int) -> tuple[str, int]:
        """The position after one more batch.  An unfinished file comes first; (name, groups) with all groups is finished."""
        names = self._names()
        left = [n for n in names if n > file]
        if file in names:
            sizes = self._sizes(file)
            if done < len(sizes):
                return file, self._groups(sizes, done)
        return (left[0], self._groups(self._sizes(left[0]), 0)) if left else (file, done)

    def _groups(self, sizes: list[int], first: int) -> int:
        if self.rows is None:
            return len(sizes)
        stop, rows = first, 0
        while stop < len(sizes) and (stop == first or rows + sizes[stop] <= self.rows):
            rows += sizes[stop]
            stop += 1
        return stop

    def initialOffset(self) -> dict:
        return {"file": "", "groups": 0}

    def latestOffset(self) -> dict:
        """The end of the next batch; the same as before where nothing more has come."""
        before = self.at or self._kept()
        self.at = self._next(*before)
        if self.at != before:
            self._keep(self.at)
        return {"file": self.at[0], "groups": self.at[1]}

    def _kept(self) -> tuple[str, int]:
        fs, path = pafs.FileSystem.from_uri(self.progress)
        if fs.get_file_info(path).type != pafs.FileType.File:
            return "", 0
        with fs.open_input_stream(path) as f:
            return tuple(json.loads(f.read()))

    def _keep(self, at: tuple[str, int]) -> None:
        fs, path = pafs.FileSystem.from_uri(self.progress)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path + ".new") as f:
            f.write(json.dumps(at).encode())
        fs.move(path + ".new", path)

    def partitions(self, start: dict, end: dict) -> list[Groups]:
        """A task for each row group between the positions."""
        out = []
        for name in (n for n in self._names() if start["file"] <= n <= end["file"]):
            first = start["groups"] if name == start["file"] else 0
            stop = end["groups"] if name == end["file"] else len(self._sizes(name))
            out += [Groups(name, k, k + 1) for k in range(first, stop)]
        return out

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, root = self._open()
        want = to_arrow_schema(self.schema)
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            for batch in pq.ParquetFile(f).iter_batches(row_groups=list(range(partition.first, partition.stop)), columns=want.names):
                columns = [batch.column(x.name).cast(x.type) if x.name in batch.schema.names else pa.nulls(batch.num_rows, x.type) for x in want]
                yield pa.RecordBatch.from_arrays(columns, schema=want)


def stream_by_name(spark: SparkSession, path: str, schema: str, progress: str, rows: int | None = None) -> DataFrame:
    """A stream of the Parquet files below ``path``, by name, a file a batch or ``rows`` rows of one."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Spark's helper process need not find this package
    spark.dataSource.register(ShardStream)
    reader = spark.readStream.format(FORMAT).schema(schema).option("path", path).option("progress", progress)
    return (reader.option("rows", rows) if rows else reader).load()
