"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.sources.scratch import Rounds, written

from .wordhash import buffers

__all__ = ["FOLDS", "HELD_OUT", "Rounds", "bounded_batches", "each_slice", "each_text", "fits_broadcast", "give_back", "held_out", "read_table", "sampled_texts", "slices", "written"]

#: Documents whose crc32(doc_id as text) mod FOLDS equals HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2
#: Bytes of text that a worker handles at once; bounds what it needs beside a batch.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch that Spark hands to a worker at most.
BATCH_BYTES = 8 << 20
#: Bytes of text that a model learns from at most.
SAMPLE_BYTES = 48 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the documents kept for evaluation; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many plus one."""
    return df.limit(rows + 1).count() <= rows


def sampled_texts(docs: DataFrame, chosen: DataFrame, on: list[Column], rows: int, most_bytes: int | None = None) -> list[tuple[int, str, object]]:
    """(id, text, label) of the chosen documents, for a model to learn from: at most ``rows`` of each label, by hash
    order of the id, and ``most_bytes`` of text (``SAMPLE_BYTES`` unless given), shared out evenly among the labels.

    ``chosen`` has __id and __label and is small; equal rows count once.  Ids, hashes and sizes are settled first, so no
    more text than that is ever moved."""
    spark = docs.sparkSession
    found = docs.join(F.broadcast(chosen), on).select(F.col("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("__bytes"), "__label", F.coalesce("text", F.lit("")).alias("__text"))
    sizes: dict[object, list] = {}
    keys = written(found.select("__id", "__hash", "__bytes", "__label").distinct(), "sample-keys")
    for label in sorted(r[0] for r in chosen.select("__label").distinct().collect()):
        few = keys.where(F.col("__label") == label).orderBy(F.xxhash64("__id"), "__id", "__hash").limit(rows)
        sizes[label] = few.select("__id", "__hash", "__bytes").collect()
    taken = []
    for label, few in sizes.items():
        room = (most_bytes or SAMPLE_BYTES) // len(sizes)
        for i, h, n in few:
            if n <= room:
                room -= n
                taken.append((i, h, label))
    if not taken:
        return []
    kind = chosen.schema["__label"].dataType.simpleString()
    few = F.broadcast(spark.createDataFrame(taken, f"__id long, __hash long, __label {kind}"))
    texts = found.join(few, ["__id", "__hash", "__label"]).groupBy("__id", "__hash", "__label").agg(F.first("__text").alias("__text"))
    return sorted((r["__id"], r["__text"], r["__label"]) for r in texts.collect())


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``SLICE_BYTES``, or of one longer text: what a worker handles at once."""
    _, offsets = buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, to
        at = to


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded to ``BATCH_BYTES``: rows are counted by default, and texts are long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(key).rstrip("b")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return freed memory to the system at a task's end.  Workers stay for the tasks of other stages, and an executor has
    several, so what each of them keeps adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def each_text(
    df: DataFrame, schema: str, work: Callable[[pa.Array, pa.Array], Iterable[pa.RecordBatch]], id_col: str | None = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Run ``work(ids, texts)`` over slices of the two columns (null texts arrive as ''; no id column: null ids)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at, to in slices(b.column(1)):
                yield from work(b.column(0).slice(at, to - at), b.column(1).slice(at, to - at))
        b = None
        give_back()

    ids = F.lit(None) if id_col is None else F.col(id_col)
    return bounded_batches(df).select(ids.cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(batches, schema)


def each_slice(df: DataFrame, text_col: str, work: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch], schema=None) -> DataFrame:
    """Run ``work(rows, texts)`` over slices of whole rows; in ``texts`` nulls are ''.  The schema stays unless given."""
    place = df.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(place).fill_null("")
            for at, to in slices(texts):
                yield work(b.slice(at, to - at), texts.slice(at, to - at))
        b = texts = None
        give_back()

    return bounded_batches(df).mapInArrow(batches, schema or df.schema)
