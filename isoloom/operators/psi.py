"""Percent spliced in: junction filters, totals and ratios, gene assignment, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.sources.scratch import written

from . import intervals, ordered

_KEY = ("sample_id", "chrom", "strand")
_JUNCTION = ("chrom", "donor", "acceptor", "strand")


def min_count(junctions: DataFrame, least: int) -> DataFrame:
    """Junctions with enough reads; applied before totals, so it changes them."""
    return junctions.where(F.col("count") >= least)


def covered(junctions: DataFrame, least: int = 2, samples: int = 3) -> DataFrame:
    """Junctions that at least ``samples`` samples cover with ``least`` reads."""
    good = junctions.groupBy(*_JUNCTION).agg(F.count_if(F.col("count") >= least).alias("__n")).where(F.col("__n") >= samples).drop("__n")
    return junctions.join(good, list(_JUNCTION), "left_semi")


def psi(junctions: DataFrame, least_total: int = 0) -> DataFrame:
    """Totals by donor and by acceptor and the junction's shares; a share is null where its total is under ``least_total``."""
    out = junctions
    for site in ("donor", "acceptor"):
        total, share = f"{site}_total", f"psi_{site}"
        out = out.withColumn(total, F.sum("count").over(W.partitionBy(*_KEY, site)))
        out = out.withColumn(share, F.when(F.col(total) >= least_total, F.try_divide(F.col("count"), F.col(total))))
    return out


def psi_by_join(junctions: DataFrame) -> DataFrame:
    """The same totals, grouped first and joined back: for sites so hot that a window would hold them in one task."""
    out = junctions
    for site in ("donor", "acceptor"):
        keys = [*_KEY, site]
        out = out.join(junctions.groupBy(*keys).agg(F.sum("count").alias(f"{site}_total")).hint("merge"), keys, "left")
    return out


def with_gene(junctions: DataFrame, genes: DataFrame, width: int | None = None) -> DataFrame:
    """``gene_id`` of the gene on the same chromosome and strand that contains the junction, the first by start and id.

    Bins are as wide as most genes are long, unless ``width`` is given."""
    if width is None:
        long = genes.agg(F.percentile_approx(F.col("end") - F.col("start"), 0.9)).first()[0] or 1
        width = 1 << max(6, int(long - 1).bit_length())
    spans = junctions.select(*_JUNCTION).distinct().withColumn("__lo", F.least("donor", "acceptor")).withColumn("__hi", F.greatest("donor", "acceptor") + 1)
    found = intervals.contained(spans, genes.select("chrom", "strand", "start", "end", "gene_id"), ["chrom", "strand"], "__lo", "__hi", width=width)
    best = found.groupBy(*_JUNCTION).agg(F.min(F.struct("start", "gene_id")).alias("__g")).select(*_JUNCTION, F.col("__g.gene_id").alias("gene_id"))
    return junctions.join(best.hint("merge"), list(_JUNCTION), "left")


def gene_summary(junctions: DataFrame, least_samples: int = 0) -> DataFrame:
    """Per gene: samples, junctions, mean and exact median of both shares; junctions without a gene don't count.

    Medians are selected over ranges of values, so a hot gene's shares never meet in one buffer."""
    rows = written(junctions.where(F.col("gene_id").isNotNull()).select("gene_id", "sample_id", "psi_donor", "psi_acceptor"), "gene-shares")
    out = rows.groupBy("gene_id").agg(F.count_distinct("sample_id").alias("n_samples_covered"), F.count(F.lit(1)).alias("n_junctions"), F.avg("psi_donor").alias("mean_psi_donor"), F.avg("psi_acceptor").alias("mean_psi_acceptor"))
    out = out.where(F.col("n_samples_covered") >= least_samples).join(ordered.medians(rows, "gene_id", ["psi_donor", "psi_acceptor"]).hint("merge"), "gene_id", "left")
    return out.select("gene_id", "n_samples_covered", "n_junctions", "mean_psi_donor", "median_psi_donor", "mean_psi_acceptor", "median_psi_acceptor")


def roll_up(junctions: DataFrame) -> DataFrame:
    """Junctions over all samples: summed reads and mean shares; rows with a null key are left out."""
    keys = [*_JUNCTION, "gene_id"]
    return junctions.dropna(subset=keys).groupBy(*keys).agg(F.sum("count").alias("count"), F.avg("psi_donor").alias("psi_donor"), F.avg("psi_acceptor").alias("psi_acceptor"))


def spans(junctions: DataFrame) -> DataFrame:
    """With junction_length (signed) and midpoint (floored)."""
    return junctions.withColumn("junction_length", F.col("acceptor") - F.col("donor")).withColumn("midpoint", F.floor((F.col("acceptor") + F.col("donor")) / 2).cast("long"))


def window_metrics(junctions: DataFrame, window: int, stride: int) -> DataFrame:
    """Junction metrics of each tile that holds a junction's midpoint."""
    placed = spans(junctions).withColumn("start", F.explode(intervals.tiles_of(F.col("midpoint"), window, stride)))
    return placed.groupBy("chrom", "start").agg(
        F.sum("count").alias("gtex_count_sum"),
        F.count("count").alias("gtex_count_count"),
        F.avg("count").alias("gtex_count_mean"),
        F.avg("psi_donor").alias("gtex_psi_donor_mean"),
        F.avg("psi_acceptor").alias("gtex_psi_acceptor_mean"),
        F.avg("junction_length").alias("gtex_junction_length_mean"),
        F.min("junction_length").alias("gtex_junction_length_min"),
        F.max("junction_length").alias("gtex_junction_length_max"),
    ).withColumn("end", F.col("start") + window)


def chromosome_counts(ids: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Rows by chromosome, those that couldn't be parsed under ``unparseable``."""
    return ids.groupBy(F.coalesce(F.col(chrom), F.lit("unparseable")).alias("chrom")).agg(F.count(F.lit(1)).alias("n"))


def quality_thresholds(junctions: DataFrame, chrom: str, least: int = 2, thresholds: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """(threshold, n_junctions, percent): junctions of a chromosome that so many samples cover, in one pass."""
    per = junctions.where(F.col("chrom") == chrom).groupBy(*_JUNCTION).agg(F.count_if(F.col("count") >= least).alias("n"))
    one = per.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("n") >= t).alias(f"t{t}") for t in thresholds))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n_junctions")) for t in thresholds)))
    return one.select("total", rows.alias("r")).select("r.threshold", "r.n_junctions", F.when(F.col("total") > 0, 100.0 * F.col("r.n_junctions") / F.col("total")).otherwise(0.0).alias("percent"))


def smoke(junctions: DataFrame, samples: int) -> DataFrame:
    """The junctions of the first ``samples`` samples by name: a deliberately small run."""
    first = junctions.select("sample_id").distinct().orderBy("sample_id").limit(samples)
    return junctions.join(F.broadcast(first), "sample_id", "left_semi")
