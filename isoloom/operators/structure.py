"""Transcript structure: bounds, introns, splice sites and transcript ends, binned tracks over tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.functions import arrays

from . import intervals

KINDS = ("donor", "acceptor", "tss", "polya")


def features(gtf: DataFrame, wanted: tuple[str, ...], chroms: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the wanted features; an empty list of chromosomes means all."""
    out = gtf.where(F.col("feature").isin(*wanted))
    return out.where(F.col("chrom").isin(*chroms)) if chroms else out


def bounds(exons: DataFrame) -> DataFrame:
    """Smallest start and largest end of each transcript."""
    return exons.groupBy("tx", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def introns(exons: DataFrame) -> DataFrame:
    """(tx, chrom, strand, left_end, right_start) of neighbouring exons in coordinate order."""
    nxt = F.lead("start").over(W.partitionBy("tx", "chrom").orderBy("start", "end"))
    return exons.select("tx", "chrom", "strand", F.col("end").alias("left_end"), nxt.alias("right_start")).where(F.col("right_start").isNotNull())


def sites(exons: DataFrame) -> DataFrame:
    """Distinct (chrom, kind, pos): last and first bases beside introns, and transcript ends, by strand."""
    plus = F.col("strand") == "+"
    pair = lambda a, b, x, y: F.explode(F.array(F.struct(F.lit(x).alias("kind"), a.alias("pos")), F.struct(F.lit(y).alias("kind"), b.alias("pos"))))
    left, right = F.col("left_end") - 1, F.col("right_start")
    splice = introns(exons).select("chrom", pair(F.when(plus, left).otherwise(right), F.when(plus, right).otherwise(left), "donor", "acceptor").alias("s"))
    first, last = F.col("start"), F.col("end") - 1
    ends = bounds(exons).select("chrom", pair(F.when(plus, first).otherwise(last), F.when(plus, last).otherwise(first), "tss", "polya").alias("s"))
    return splice.unionByName(ends).select("chrom", "s.kind", "s.pos").distinct()


def binned_tracks(found: DataFrame, contigs: DataFrame, window: int, stride: int, bin_size: int) -> DataFrame:
    """Every full tile of every contig with sorted sets of bins that hold a site, one column a kind, empty where none does.

    Sites find their tiles by arithmetic, so the only shuffles are by tile."""
    size = contigs.select("chrom", "length")
    placed = intervals.looked_up(found, size, ["chrom"]).withColumn("start", F.explode(intervals.tiles_of(F.col("pos"), window, stride))).where(F.col("start") + window <= F.col("length"))
    bin_of = F.floor((F.col("pos") - F.col("start")) / F.lit(bin_size)).cast("int")
    sets = placed.groupBy("chrom", "start").agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == k, bin_of))).alias(k) for k in KINDS))
    tiles = intervals.tiles(size, window, stride, bin_size).select("chrom", "start", "end")
    empty = F.array().cast("array<int>")
    return tiles.join(sets.hint("merge"), ["chrom", "start"], "left").select("chrom", "start", "end", *(F.coalesce(k, empty).alias(k) for k in KINDS))


def densified(tracks: DataFrame, bins: int) -> DataFrame:
    """The same tracks as 0/1 arrays: the last step, since dense arrays are long."""
    return tracks.select("chrom", "start", "end", *(arrays.dense(F.col(k), bins).alias(k) for k in KINDS))
