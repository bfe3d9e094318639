"""Ranks and running sums along an order of a whole table, with no task that sorts it all.

Rows are dealt by ranges of the order that Spark draws, so that a range holds what lies between two bounds.  Ranks and
sums go inside each range, and a table of one row a range gives what lies before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.sources.scratch import written

#: Rows of a table of totals that is broadcast.
LOOKUP_ROWS = 200_000
#: monotonically_increasing_id keeps the place of a row in its partition in so many low bits.
_PLACE = 33


def _ranges(df: DataFrame, order: Sequence[Column], unique: bool) -> DataFrame:
    """``df`` written in ranges, sorted inside each; __range is the range and __place the row's number in it from 0.

    Rows equal in ``order`` are told apart by a number that is written first, so that a hot value is split as well."""
    if not unique:
        df = written(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
        order = [*order, F.col("__row")]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = placed.withColumn("__range", F.shiftright("__id", _PLACE)).withColumn("__place", F.col("__id").bitwiseAND((1 << _PLACE) - 1)).drop("__id")
    return written(placed, "ranges")


def _before(sums: DataFrame, column: str) -> DataFrame:
    """(__range, __before): the sum over all earlier ranges; ``sums`` has one row a range."""
    along = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("__range", F.coalesce(F.sum(column).over(along), F.lit(0)).alias("__before"))


def _with_before(rows: DataFrame, before: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(before), "__range")  # one row a range


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank", unique: bool = False) -> DataFrame:
    """``df`` with the row's number along ``order``, from 1.  Rows equal in it take numbers in any order; ``unique`` says
    that there are none, which saves writing the rows once.  An empty table stays empty."""
    rows = _ranges(df, order, unique)
    before = _before(rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")), "n")
    return _with_before(rows, before).withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__range", "__place", "__before", "__row")


def running_sum(df: DataFrame, order: Sequence[Column], value: Column, name: str = "running", unique: bool = False) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it along ``order`` (0 for the first; a null value adds 0)."""
    rows = _ranges(df.withColumn("__value", F.coalesce(value, F.lit(0))), order, unique)
    before = _before(rows.groupBy("__range").agg(F.sum("__value").alias("n")), "n")
    inside = W.partitionBy("__range").orderBy("__place").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return _with_before(rows, before).withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__place", "__before", "__inside", "__value", "__row")


def summed_files(df: DataFrame, order: Sequence[Column], value: str, unique: bool = False) -> tuple[list[Row], DataFrame]:
    """Files that hold the rows of ``df`` along ``order``, one file after the other, for tasks that cut the order at sums of the column
    ``value``; and the table of them.  Each file's row has its name, the sum of its values, the last one and the least."""
    rows = _ranges(df, order, unique)
    each = rows.groupBy("__range", F.col("_metadata.file_path").alias("file")).agg(F.min("__place").alias("first"), F.sum(value).alias("total"), F.max_by(value, "__place").alias("last"), F.min(value).alias("least"))
    return each.orderBy("__range", "first").collect(), rows.drop("__range", "__place", "__row")  # a row a task


def medians(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, median_<column>...): exact medians of several columns by key, nulls left out; keys whose values are all null have
    null medians.

    Equal values of a key are counted first.  The counts run along (key, column, value) in ranges, so a hot key's values are
    spread over many ranges and no task holds them all; the median is where half of the key's count is reached."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("value")) for c in columns)))
    counts = df.select(key, each.alias("x")).select(key, "x.*").where(F.col("value").isNotNull()).groupBy(key, "of", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = running_sum(counts, [F.col(key), F.col("of"), F.col("value")], F.col("n"), "before", unique=True)
    rows = written(rows, "value-counts")
    totals = rows.groupBy(key, "of").agg(F.min("before").alias("base"), F.sum("n").alias("total"))
    few = totals.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    placed = rows.join(F.broadcast(totals) if few else totals.hint("merge"), [key, "of"])
    at = F.col("before") - F.col("base")
    holds = lambda k: (at <= k) & (k < at + F.col("n"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = placed.groupBy(key, "of").agg(F.max(F.when(holds(low), F.col("value"))).alias("a"), F.max(F.when(holds(high), F.col("value"))).alias("b"))
    return middle.groupBy(key).agg(*(F.max(F.when(F.col("of") == c, (F.col("a") + F.col("b")) / 2)).alias(f"median_{c}") for c in columns))
