"""Counts of overlapping intervals without their pairs.

As many half-open intervals overlap [s, e) as begin before e, less those that end by s.  With a bound on the other
interval's id that counts points of two orders, place and id, and the work grows with the rows, not with the pairs.

Points and questions are dealt twice into ranges of bounded rows, by place and by id.  What a question counts lies in its own
range of places, or in an earlier one and its own range of ids, or in an earlier one and a later range of ids.  The first
two are counted inside a range; the third comes from a table of one row for each pair of ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.sources.scratch import written

from . import ordered

#: Points and questions of a range.
RANGE_ROWS = 200_000
#: Kinds of rows in their order at one place: an interval's end, questions for the ends and the starts before, a start.
END, ASK_ENDS, ASK_STARTS, START = range(4)


def larger_before(kinds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each question the starts, or less the ends, among the rows before it with larger ids; 0 for points.  Runs of rows
    are merged two by two."""
    n, place = len(ids), np.arange(len(ids))
    out, run = np.zeros(n, np.int64), 1
    while run < n:
        right = (place // run) & 1
        at = np.lexsort((1 - right, -ids, place // (2 * run)))  # of equal ids the right run's come first: they don't count
        left, block = right[at] == 0, place[at] // (2 * run)
        begin = np.searchsorted(block, block)
        for kind, ask, sign in ((START, ASK_STARTS, 1), (END, ASK_ENDS, -1)):
            seen = np.concatenate(([0], np.cumsum(left & (kinds[at] == kind))))
            out[at] += np.where(~left & (kinds[at] == ask), sign * (seen[1:] - seen[begin]), 0)
        run *= 2
    return out


def _counted(name: str):
    """Adds ``name``, the partition, and what each question counts in it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = list(batches)
        if not sum(b.num_rows for b in parts):
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        ids = pc.rank(rows.column("id"), "ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        n = larger_before(rows.column("kind").to_numpy(), ids) + rows.column("n").to_numpy()
        rows = rows.set_column(rows.schema.get_field_index("n"), "n", pa.array(n)).append_column(name, pa.array(np.full(len(n), TaskContext.get().partitionId())))
        yield from rows.to_batches()

    return counted


def later_overlaps(df: DataFrame, keys: Sequence[str], name: str, start: str = "start", end: str = "end", range_rows: int = RANGE_ROWS) -> DataFrame:
    """(``name``, n): for each id (a string) how many intervals of the same keys with a larger one overlap its own; ids
    without any are left out, empty intervals overlap none."""
    keys = list(keys)
    some = df.where(F.col(end) > F.col(start)).dropna(subset=[*keys, name])
    each = F.explode(F.array(*(F.struct(F.col(c).cast("long").alias("at"), F.lit(k).alias("kind")) for c, k in ((start, START), (end, END), (start, ASK_ENDS), (end, ASK_STARTS)))))
    rows = written(some.select(*keys, F.col(name).alias("id"), each.alias("x")).select(*keys, "id", "x.at", "x.kind", F.lit(0).cast("long").alias("n")), "overlap-rows")
    ranges = max(1, -(-rows.count() // range_rows))
    order = [*keys, "at", "kind", "id"]
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("id", "kind", "n")
    placed = written(placed.mapInArrow(_counted("places"), "id string, kind int, n long, places long"), "overlap-places")
    # questions come first in their range of places, so that they count earlier ranges only
    dealt = placed.repartitionByRange(ranges, "id").sortWithinPartitions("places", F.col("kind").isin(START, END))
    dealt = written(dealt.mapInArrow(_counted("ids"), "id string, kind int, n long, places long, ids long"), "overlap-ids")
    cells = dealt.groupBy("places", "ids").agg(F.count_if(F.col("kind") == START).alias("starts"), F.count_if(F.col("kind") == END).alias("ends"))
    spark = df.sparkSession
    grid = spark.range(ranges).toDF("places").crossJoin(spark.range(ranges).toDF("ids")).join(cells.hint("merge"), ["places", "ids"], "left").na.fill(0)
    later = W.partitionBy("places").orderBy(F.desc("ids")).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("ids").orderBy("places").rowsBetween(W.unboundedPreceding, -1)
    for along in (later, earlier):
        grid = grid.select("places", "ids", *(F.coalesce(F.sum(c).over(along), F.lit(0)).alias(c) for c in ("starts", "ends")))
    asked = dealt.where(F.col("kind").isin(ASK_ENDS, ASK_STARTS)).join(grid.hint("merge") if ranges > 400 else F.broadcast(grid), ["places", "ids"])
    n = F.col("n") + F.when(F.col("kind") == ASK_STARTS, F.col("starts")).otherwise(-F.col("ends"))
    return asked.groupBy(F.col("id").alias(name)).agg(F.sum(n).alias("n")).where("n > 0")


def held_points(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, name: str, start: str = "start", end: str = "end") -> DataFrame:
    """(``name``, n, total): how many points of the same keys the intervals of each name hold, and their sum; names that hold none
    are left out.  What lies before an interval's end less what lies before its start: points of a place are one row, bounds of
    a place are asked once for all intervals that have it, and running sums go by ranges (``ordered``)."""
    keys = list(keys)
    some = intervals.where(F.col(end) > F.col(start)).dropna(subset=keys)
    bounds = F.explode(F.array(*(F.struct(F.col(c).cast("long").alias("at"), F.lit(sign).alias("sign")) for c, sign in ((start, -1), (end, 1)))))
    asked = some.select(*keys, name, bounds.alias("x")).select(*keys, name, "x.at", "x.sign")
    zero = F.lit(0).cast("long")
    at = points.dropna(subset=[*keys, point]).groupBy(*keys, F.col(point).cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    rows = at.select(*keys, "at", "n").unionByName(asked.select(*keys, "at", zero.alias("n")))
    places = written(rows.groupBy(*keys, "at").agg(F.sum("n").alias("n")), "held-places")
    order = [F.col(c) for c in (*keys, "at")]
    places = ordered.running_sum(places, order, F.col("n"), "before", unique=True)
    places = ordered.running_sum(places, order, F.col("n") * F.col("at"), "below", unique=True).drop("n")
    met = asked.join(places.hint("merge"), [*keys, "at"])
    out = met.groupBy(name).agg(F.sum(F.col("sign") * F.col("before")).alias("n"), F.sum(F.col("sign") * F.col("below")).alias("total"))
    return out.where("n > 0")
