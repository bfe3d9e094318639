"""Interval joins and folds.

Range predicates become equi-joins on bins, which Spark shuffles, sorts and splits like any other join.  Bins come in
levels, each 8 times as wide as the one below: an interval is listed at the first level whose bins are as wide as itself,
where it touches one bin or two, however long it is; a point asks each level that occurs.  Where all intervals fit the
narrowest bins there is one level and a point is one row.  Bins also break up hot keys, since a chromosome is many bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.sources.scratch import Rounds, written

from . import ordered

#: Rows of a lookup table that is broadcast.
LOOKUP_ROWS = 200_000


def looked_up(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` joined with a table of one row a key, such as contig lengths: broadcast up to ``LOOKUP_ROWS`` rows, which
    are counted first, so that a hot chromosome isn't shuffled into one task; merged beyond."""
    few = table.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    return df.join(F.broadcast(table) if few else table.hint("merge"), list(keys))


def _div(x: Column, width: int) -> Column:
    """Floor division (``div`` truncates)."""
    return F.floor(x / F.lit(width)).cast("long")


#: Levels of bins; the widest are 8 ** (LEVELS - 1) times as wide as the narrowest.
LEVELS = 12
_LEVEL, _BIN = "__level", "__bin"


def _level(length: Column, width: int) -> Column:
    """The first level whose bins are as wide as an interval."""
    return sum((length > F.lit(width * 8**k)).cast("int") for k in range(LEVELS - 1)) + F.lit(0)


def _bins_at(level: Column, start: Column, end: Column, width: int) -> Column:
    """The bins of a level that [start, end) touches; one or two if it isn't longer than they are wide."""
    wide = F.lit(width).cast("long") * F.pow(F.lit(8), level).cast("long")
    return F.sequence(F.floor(start / wide).cast("long"), F.floor((end - 1) / wide).cast("long"))


def listed(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """A row for each bin of its level that [start, end) touches, two at most; empty intervals touch none."""
    out = df.where(end > start).withColumn(_LEVEL, _level(end - start, width))
    return out.withColumn(_BIN, F.explode(_bins_at(F.col(_LEVEL), start, end, width)))


def levels(df: DataFrame, start: Column, end: Column, width: int) -> list[int]:
    """The levels that intervals need, a dozen numbers at most; the narrowest if there are none."""
    found = df.where(end > start).select(_level(end - start, width).alias("level")).distinct().collect()
    return sorted(r["level"] for r in found) or [0]


def _asking(points: DataFrame, point: Column, width: int, at: Sequence[int]) -> DataFrame:
    """A row for each level: the bin of it that holds the point."""
    each = F.array(*(F.struct(F.lit(k).alias("level"), _div(point, width * 8**k).alias("bin")) for k in at))
    return points.withColumn("__ask", F.explode(each)).withColumn(_LEVEL, F.col("__ask.level")).withColumn(_BIN, F.col("__ask.bin")).drop("__ask")


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str = "start", end: str = "end", width: int = 4096, how: str = "inner") -> DataFrame:
    """Points with the intervals of the same keys that hold them; ``how`` is inner or left.  Each pair meets in one bin."""
    at = levels(intervals, F.col(start), F.col(end), width)
    held = listed(intervals, F.col(start), F.col(end), width)
    inside = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    on = [*keys, _LEVEL, _BIN]
    if how == "inner":
        return _asking(points, F.col(point), width, at).join(held.hint("merge"), on).where(inside).drop(_LEVEL, _BIN)
    # a point may find intervals on one level and none on others: those that find none at all are added once
    numbered = written(points.withColumn("__id", F.monotonically_increasing_id()), "points")
    found = written(_asking(numbered, F.col(point), width, at).join(held.hint("merge"), on).where(inside).drop(_LEVEL, _BIN), "points-held")
    none = numbered.join(found.select("__id").distinct().hint("merge"), "__id", "left_anti")
    return found.unionByName(none, allowMissingColumns=True).drop("__id")


def contained(inner: DataFrame, outer: DataFrame, keys: Sequence[str], lo: str, hi: str, start: str = "start", end: str = "end", width: int = 4096) -> DataFrame:
    """Rows of ``inner`` with those of ``outer`` that contain [lo, hi): they meet in a bin of lo."""
    at = levels(outer, F.col(start), F.col(end), width)
    held = listed(outer, F.col(start), F.col(end), width)
    return _asking(inner, F.col(lo), width, at).join(held.hint("merge"), [*keys, _LEVEL, _BIN]).where((F.col(start) <= F.col(lo)) & (F.col(hi) <= F.col(end))).drop(_LEVEL, _BIN)


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], ls: str, le: str, rs: str, re: str, width: int = 4096) -> DataFrame:
    """Pairs of overlapping half-open intervals.

    Each side is listed at its own level and at the wider ones that occur on the other side, two rows a level at most.  A
    pair meets on the wider of both levels, in the first bin that both touch."""
    sides = []
    need = {k for df, a, b in ((left, ls, le), (right, rs, re)) for k in levels(df, F.col(a), F.col(b), width)}
    for df, a, b, own in ((left, ls, le, "__l"), (right, rs, re, "__r")):
        start, end = F.col(a), F.col(b)
        some = df.where(end > start).withColumn(own, _level(end - start, width))
        some = some.withColumn(_LEVEL, F.explode(F.filter(F.array(*(F.lit(k) for k in sorted(need))), lambda k: k >= F.col(own))))  # noqa: B023
        sides.append(some.withColumn(_BIN, F.explode(_bins_at(F.col(_LEVEL), start, end, width))))
    met = sides[0].join(sides[1].hint("merge"), [*keys, _LEVEL, _BIN])
    first = F.get(_bins_at(F.col(_LEVEL), F.greatest(ls, rs), F.greatest(ls, rs) + 1, width), 0)
    met = met.where((F.col(_LEVEL) == F.greatest("__l", "__r")) & (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)) & (F.col(_BIN) == first))
    return met.drop(_LEVEL, _BIN, "__l", "__r")


def tiles(contigs: DataFrame, window: int, stride: int, bin_size: int = 1, length: str = "length") -> DataFrame:
    """Full windows of each contig (columns start, end); a tail shorter than a window is dropped."""
    if min(window, stride, bin_size) <= 0 or window % bin_size or stride % bin_size:
        raise ValueError("window and stride must be positive multiples of bin_size")
    listed = contigs.where(F.col(length) >= window).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - window, F.lit(stride).cast("long"))))
    return listed.withColumn("end", F.col("start") + window)


def tiles_of(point: Column, window: int, stride: int, first: Column | int = 0) -> Column:
    """Starts of the tiles first, first + stride, ... that hold ``point``; empty before the first."""
    origin = F.lit(first).cast("long") if isinstance(first, int) else first
    x = point - origin
    lo = F.greatest(F.ceil((x - window + 1) / F.lit(stride)), F.lit(0)).cast("long")
    hi = F.floor(x / F.lit(stride)).cast("long")
    return F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda k: origin + k * stride)).otherwise(F.array().cast("array<long>"))


def greedy(items: Column, start: str = "start", end: str = "end") -> Column:
    """The items of an array sorted by position that greedy acceptance keeps: each must begin at or after the end of the
    last accepted.  The array is a window's variants, bounded by its caller."""
    kind = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<int>").alias("kept"))
    fold = F.aggregate(
        F.transform(items, lambda x, i: F.struct(x[start].alias("s"), x[end].alias("e"), i.alias("i"))),
        kind,
        lambda a, x: F.when(a["last"].isNull() | (x["s"] >= a["last"]), F.struct(x["e"].cast("long").alias("last"), F.concat(a["kept"], F.array(x["i"])).alias("kept"))).otherwise(a),
    )
    return F.when(F.size(items) < 2, items).otherwise(F.transform(fold["kept"], lambda i: F.get(items, i)))


#: Bases of a stretch of a key, in which its rows are sorted.
STRETCH_BASES, STRETCH = 1 << 16, "__stretch"


def in_stretches(df: DataFrame, keys: Sequence[str], start: str) -> DataFrame:
    """``df`` dealt by stretch of ``start`` and the first key, so that what is grouped by these and more needs no other shuffle."""
    return df.withColumn(STRETCH, _div(F.col(start), STRETCH_BASES)).repartition(keys[0], STRETCH)


def islands(items: DataFrame, keys: Sequence[str], start: str, end: str, name: str) -> DataFrame:
    """``items`` of :func:`in_stretches`, one row for each key and start, with ``name``, the start of the island that a row is in.

    A row where no earlier one of its key reaches beyond its start begins an island; greedy acceptance keeps it whatever came
    before, so islands are selected by themselves.  Rows are sorted in stretches; a table of a row a stretch tells how far
    the earlier ones reach and which island they leave open, so no task holds a key."""
    keys = list(keys)
    before = W.partitionBy(*keys, STRETCH).orderBy(start).rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy(*keys, STRETCH).orderBy(start).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = items.withColumn("__reach", F.max(end).over(before))
    here = here.withColumn("__head", F.max(F.when(F.col("__reach").isNull() | (F.col(start) >= F.col("__reach")), F.col(start))).over(so_far))
    here = written(here.drop("__reach"), "stretches")
    along = W.partitionBy(*keys).orderBy(STRETCH).rowsBetween(W.unboundedPreceding, -1)
    ends = here.groupBy(*keys, STRETCH).agg(F.max(end).alias("__to"), F.max("__head").alias("__last"))  # a row a stretch
    ends = ends.withColumn("__carried", F.max("__to").over(along))
    begins = F.when(F.col("__carried").isNull() | (F.col("__last") >= F.col("__carried")), F.col("__last"))
    ends = written(ends.withColumn("__open", F.max(begins).over(along)).select(*keys, STRETCH, "__carried", "__open"), "stretch-ends")
    # only a stretch into which an earlier one reaches needs to know it
    reached = ends.join(here.groupBy(*keys, STRETCH).agg(F.min(start).alias("__from")).hint("merge"), [*keys, STRETCH]).where("__carried > __from").drop("__from")
    reached = written(reached, "stretches-reached")
    few = reached.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    placed = here.join(F.broadcast(reached) if few else reached.hint("merge"), [*keys, STRETCH], "left")
    island = F.when(F.col("__head") < F.col("__carried"), F.col("__open")).otherwise(F.col("__head"))
    return placed.withColumn(name, island).drop("__head", "__carried", "__open", STRETCH)


def greedy_chain(items: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """The rows that :func:`greedy` keeps of each key, for keys of any size; ``items`` has one row for each key and start.

    The row after a kept one is the first that begins at its end or later.  All rows get this pointer at once: starts and
    ends are sorted together in ranges, and the number of starts before an end is the number of the row it points to.
    Then pointers are followed in doubling steps, 1, 2, 4, ... rows on, so the kept rows are known after as many rounds as
    the length of the longest chain has bits.  Rows meet by number, so no task holds a key."""
    items = written(items, "chain-items")
    keys = list(keys)
    at = items.select(*keys, F.col(start).alias("__at"), F.lit(1).cast("long").alias("__kind"), F.col(start).alias("__s"))
    to = items.select(*keys, F.col(end).alias("__at"), F.lit(0).cast("long").alias("__kind"), F.col(start).alias("__s"))
    order = [*map(F.col, keys), F.col("__at"), F.col("__kind"), F.col("__s")]
    placed = written(ordered.running_sum(at.unionByName(to), order, F.col("__kind"), "__n", unique=True), "chain-places")
    rows = placed.where("__kind = 1").select(*keys, "__s", F.col("__n").alias("__row"))
    ends = rows.groupBy(*keys).agg(F.min("__row").alias("__first"), F.max("__row").alias("__last"))
    named = rows.join(placed.where("__kind = 0").select(*keys, "__s", F.col("__n").alias("__next")).hint("merge"), [*keys, "__s"])
    named = written(looked_up(named, written(ends, "chain-ends"), keys), "chain-pointers")
    rounds, kept = Rounds(items.sparkSession, "chain-pointers"), Rounds(items.sparkSession, "chain-kept")
    pointer = rounds.written(named.withColumn("__next", F.greatest("__next", F.col("__row") + 1)).where(F.col("__next") <= F.col("__last")).select("__row", "__next"))
    reached = kept.written(named.where(F.col("__row") == F.col("__first")).select("__row"))
    while not pointer.isEmpty():
        further = reached.join(pointer.hint("merge"), "__row").select(F.col("__next").alias("__row"))
        reached = kept.written(reached.unionByName(further).distinct())
        twice = pointer.select(F.col("__next").alias("__mid"), F.col("__row").alias("__from"))
        pointer = rounds.written(twice.join(pointer.hint("merge"), F.col("__mid") == F.col("__row")).select(F.col("__from").alias("__row"), "__next"))
    chosen = named.join(reached.hint("merge"), "__row", "left_semi").select(*keys, F.col("__s").alias(start))
    return items.join(chosen.hint("merge"), [*keys, start], "left_semi")
