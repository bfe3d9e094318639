"""Writers: sharded, partitioned and guarded Parquet, run metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from isoloom.operators import ordered
from isoloom.sources.readers import REASONS
from isoloom.sources.shard_sink import Piece, read_numbered, write_cut, write_numbered


def write_sharded(df: DataFrame, path: str, rows: int) -> None:
    """Parquet files of at most ``rows`` rows."""
    df.write.option("maxRecordsPerFile", rows).option("compression", "snappy").parquet(path)


def write_by_bases(df: DataFrame, path: str, max_bases: int, order: Sequence[Column], start: str = "start", end: str = "end", unique: bool = False) -> None:
    """Numbered shards (folders shard=0, 1, ... of one Parquet file) of consecutive rows along ``order``.

    A shard takes the rows before which the running sum of ``end - start`` lies between two multiples of ``max_bases``, so it
    exceeds the budget by less than its last row, whatever the rows' lengths.  Numbers skip where one row spans several
    budgets.  The rows are dealt by ranges of the order, and a task cuts a range; a row without bounds counts no bases.
    ``unique`` says that no rows are equal in ``order``, which saves writing them once.  Read with :func:`read_by_bases`."""
    if max_bases <= 0:
        raise ValueError("max_bases must be positive")
    bases = F.coalesce(F.col(end).cast("long") - F.col(start).cast("long"), F.lit(0))
    files, rows = ordered.summed_files(df.withColumn("__bases", bases), order, "__bases", unique)
    if any(f["least"] < 0 for f in files):  # ends before starts: sums fall again, so a shard's rows need not be consecutive
        dealt = ordered.running_sum(rows, order, F.col("__bases"), "__sum").withColumn("shard", F.floor(F.col("__sum") / max_bases)).drop("__sum", "__bases")
        write_numbered(dealt.repartition("shard").sortWithinPartitions("shard", *order), path, "shard")
        return
    pieces, before = [], 0
    for f in files:
        pieces.append(Piece(f["file"], before, (before + f["total"] - f["last"]) // max_bases))
        before += f["total"]
    write_cut(df.sparkSession, pieces, df.drop("shard").schema, "__bases", max_bases, path, "shard")


def read_by_bases(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The columns of ``schema`` of what :func:`write_by_bases` wrote, each row with its shard and the name of the file in the shard's
    folder.  Spark's own reader reads the folders as well, but takes long where they are many."""
    return read_numbered(spark, path, StructType([*schema, StructField("shard", LongType()), StructField("file", StringType())]), "shard")


def write_by(df: DataFrame, path: str, column: str) -> None:
    """One folder for each value of ``column`` (samples, chromosomes); rows of a value may come from many tasks."""
    df.write.partitionBy(column).parquet(path)


def write_parquet(df: DataFrame, path: str, exist_ok: bool = False) -> None:
    df.write.mode("overwrite" if exist_ok else "errorifexists").parquet(path)


def write_with_metadata(df: DataFrame, path: str, inputs: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` and, beside it in ``path``_metadata, its row count, columns, inputs and time as JSON; the count is
    observed while writing, so it costs no second job.  Returns the metadata row."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    meta = df.sparkSession.range(1).select(
        F.lit(seen.get["rows"]).cast("long").alias("rows"), F.array(*map(F.lit, df.columns)).alias("columns"), F.array(*map(F.lit, inputs)).cast("array<string>").alias("inputs"), F.current_timestamp().alias("written_at")
    )
    meta.write.json(f"{path}_metadata")
    return meta


def write_accepted_and_rejected(parsed: DataFrame, path: str) -> dict[str, int]:
    """Write what ``readers.parsed_*`` gives into two tables in one pass, ``path``/kind=row and ``path``/kind=reject, and
    return how many lines each reason had; accepted ones count as 'row'."""
    seen = Observation()
    reasons = ("row", *REASONS)
    reason = F.coalesce("reason", F.lit("row"))
    counted = parsed.observe(seen, *(F.count_if(reason == r).alias(r) for r in reasons))
    counted.withColumn("kind", F.when(F.col("reason").isNull(), "row").otherwise("reject")).write.partitionBy("kind").parquet(path)
    return {r: seen.get[r] for r in reasons}


def read_accepted(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of :func:`write_accepted_and_rejected`; ``schema`` is that of what was written."""
    return spark.read.schema(schema).parquet(path).where("kind = 'row'").select("row.*")


def read_rejected(spark: SparkSession, path: str, schema) -> DataFrame:
    """(line, reason) of the lines that were left out."""
    return spark.read.schema(schema).parquet(path).where("kind = 'reject'").select("line", "reason")
