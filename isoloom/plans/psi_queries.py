"""Queries on junction counts: filters, shares, genes, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoloom.functions import ids
from isoloom.operators import dominance, psi
from isoloom.plans.fixtures import oracle, positions, view
from isoloom.schema import keep_columns

#: Windows of the junction metrics.
WINDOW, STRIDE = 256, 128


def _junctions(spark, sf_dir):
    return view(spark, sf_dir, "fx_junctions")


def _psi(spark, sf_dir, least_total=20):
    return psi.psi(psi.min_count(_junctions(spark, sf_dir), 5), least_total)


def _annotated(spark, sf_dir):
    j = psi.psi(psi.min_count(view(spark, sf_dir, "fx_far_junctions"), 5), 20)
    return psi.with_gene(j, view(spark, sf_dir, "fx_far_genes"))


def r9(name):
    return F.round(name, 9).alias(name)


def p1_keep_columns(spark, sf_dir):
    return keep_columns(_junctions(spark, sf_dir), ["chrom", "no_such_column", "donor", "count"]).withColumnRenamed("count", "reads")


def p4_parse_junction(spark, sf_dir):
    j = _junctions(spark, sf_dir)
    text = F.when(F.col("donor") % 3 == 0, F.concat("chrom", F.lit(":"), "donor", F.lit("-"), "acceptor", F.lit(":"), "strand")).when(F.col("donor") % 3 == 1, F.concat_ws("_", "chrom", "donor", "acceptor")).otherwise(F.concat("chrom", F.lit(":"), "donor", F.lit("-"), "acceptor", F.lit("_"), "strand"))
    return j.select(ids.parse_junction(text).alias("j")).groupBy("j.chrom", "j.donor", "j.acceptor", "j.strand").agg(F.count(F.lit(1)).alias("n"))


def p10_strand_sites(spark, sf_dir):
    d, a = ids.strand_sites(F.col("donor"), F.col("acceptor"), F.col("strand"))
    return _junctions(spark, sf_dir).select("sample_id", "chrom", "strand", d.alias("donor_site"), a.alias("acceptor_site"))


def p11_spans(spark, sf_dir):
    return psi.spans(_junctions(spark, sf_dir)).select("sample_id", "chrom", "strand", "donor", "acceptor", "junction_length", "midpoint")


def p25_sample_names(spark, sf_dir):
    return view(spark, sf_dir, "supplier").select("s_suppkey", ids.sample_name(F.col("s_name")).alias("sample_name"))


def f1_chromosomes(spark, sf_dir):
    return _junctions(spark, sf_dir).where(F.col("chrom").isin("A", "R")).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


def f3_min_count(spark, sf_dir):
    return psi.min_count(_junctions(spark, sf_dir), 10).select("sample_id", "chrom", "strand", "donor", "acceptor", F.col("count").alias("reads"))


def f4_covered(spark, sf_dir):
    return psi.covered(_junctions(spark, sf_dir), 10, 2).select("sample_id", "chrom", "strand", "donor", "acceptor", F.col("count").alias("reads"))


def f9_smoke(spark, sf_dir):
    return psi.smoke(_junctions(spark, sf_dir), 3).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


def a1_psi_totals(spark, sf_dir):
    return psi.psi(psi.min_count(_junctions(spark, sf_dir), 5)).select("sample_id", "chrom", "strand", "donor", "acceptor", "donor_total", "acceptor_total", r9("psi_donor"), r9("psi_acceptor"))


def f5_psi_gated(spark, sf_dir):
    return _psi(spark, sf_dir, 30).select("sample_id", "chrom", "strand", "donor", "acceptor", r9("psi_donor"), r9("psi_acceptor"))


def j1_totals_by_join(spark, sf_dir):
    return psi.psi_by_join(_junctions(spark, sf_dir)).select("sample_id", "chrom", "strand", "donor", "acceptor", "donor_total", "acceptor_total")


def j2_gene_of_junction(spark, sf_dir):
    return psi.with_gene(view(spark, sf_dir, "fx_far_junctions"), view(spark, sf_dir, "fx_far_genes")).select("sample_id", "chrom", "strand", "donor", "acceptor", "gene_id")


def _summary(spark, sf_dir, least):
    s = psi.gene_summary(_annotated(spark, sf_dir), least)
    return s.select("gene_id", "n_samples_covered", "n_junctions", *(r9(c) for c in s.columns[3:]))


def a2_gene_psi_summary(spark, sf_dir):
    return _summary(spark, sf_dir, 0)


def f6_min_samples(spark, sf_dir):
    return _summary(spark, sf_dir, 20)


def a3_roll_up(spark, sf_dir):
    return psi.roll_up(_annotated(spark, sf_dir)).select("chrom", "donor", "acceptor", "strand", "gene_id", F.col("count").alias("reads"), r9("psi_donor"), r9("psi_acceptor"))


def a4_window_metrics(spark, sf_dir):
    m = psi.window_metrics(_psi(spark, sf_dir), WINDOW, STRIDE)
    return positions(m.select("chrom", "start", "end", "gtex_count_sum", "gtex_count_count", *(r9(c) for c in m.columns if c.endswith("_mean")), "gtex_junction_length_min", "gtex_junction_length_max"))


def j3_midpoint_in_window(spark, sf_dir):
    """For each gene the junctions whose midpoint it holds, counted and summed without listing the pairs."""
    j = psi.spans(_junctions(spark, sf_dir)).select("chrom", "strand", "donor", "acceptor", "midpoint").distinct()
    w = view(spark, sf_dir, "fx_genes").select("chrom", "strand", "start", "end", "gene_id")
    held = dominance.held_points(j, w, ["chrom", "strand"], "midpoint", "gene_id")
    return held.select("gene_id", F.col("n").alias("n_junctions"), F.col("total").alias("sum_midpoints"))


def j11_overlapping_genes(spark, sf_dir):
    """For each gene those after it in the order of names that overlap it, counted without listing the pairs."""
    n = dominance.later_overlaps(view(spark, sf_dir, "fx_genes"), ["chrom", "strand"], "gene_id")
    return n.select(F.col("gene_id").alias("a"), F.col("n").alias("n_overlaps"))


def a11_rows_by_chromosome(spark, sf_dir):
    j = _junctions(spark, sf_dir).withColumn("chrom", F.when(F.col("donor") % 7 == 0, F.lit(None)).otherwise(F.col("chrom")))
    return psi.chromosome_counts(j)


def a12_quality_thresholds(spark, sf_dir):
    return psi.quality_thresholds(_junctions(spark, sf_dir), "R", 20).select("threshold", "n_junctions", r9("percent"))


def u1_union_all(spark, sf_dir):
    j = _junctions(spark, sf_dir)
    parts = [j.where(F.col("chrom") == c) for c in ("A", "N", "R")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("chrom", "strand").agg(F.sum("count").alias("reads"))


def u4_finished_chromosomes(spark, sf_dir):
    j = _junctions(spark, sf_dir)
    seen, now = j.select("chrom", "strand").distinct(), j.where(F.col("count") > 100).select("chrom", "strand").distinct()
    return seen.exceptAll(now)


QUERIES = {
    f.__name__: f
    for f in (
        p1_keep_columns, p4_parse_junction, p10_strand_sites, p11_spans, p25_sample_names, f1_chromosomes, f3_min_count, f4_covered, f5_psi_gated, f6_min_samples, f9_smoke, a1_psi_totals, a2_gene_psi_summary,
        a3_roll_up, a4_window_metrics, a11_rows_by_chromosome, a12_quality_thresholds, j1_totals_by_join, j2_gene_of_junction, j3_midpoint_in_window, j11_overlapping_genes, u1_union_all, u4_finished_chromosomes,
    )
}

_J = ["fx_junctions"]
_T = "CAST(sum(count) OVER (PARTITION BY sample_id, chrom, strand, {0}) AS BIGINT) AS {0}_total"
_PSI = f"""t AS (SELECT *, {_T.format("donor")}, {_T.format("acceptor")} FROM fx_junctions WHERE count >= 5),
p AS (SELECT *, CASE WHEN donor_total >= {{0}} THEN count / donor_total END AS psi_donor, CASE WHEN acceptor_total >= {{0}} THEN count / acceptor_total END AS psi_acceptor FROM t)"""
_FAR, _FAR_PSI = ["fx_far_junctions", "fx_far_genes"], _PSI.format(20).replace("fx_junctions", "fx_far_junctions")
_GENE = """n AS (SELECT p.*, (SELECT min_by(gene_id, (start_pos, gene_id)) FROM fx_far_genes g WHERE g.chrom = p.chrom AND g.strand = p.strand AND start_pos <= least(donor, acceptor) AND greatest(donor, acceptor) + 1 <= end_pos) AS gene_id FROM p)"""
_SUMMARY = """SELECT gene_id, count(DISTINCT sample_id) AS n_samples_covered, count(*) AS n_junctions, round(avg(psi_donor), 9) AS mean_psi_donor, round(quantile_cont(psi_donor, 0.5), 9) AS median_psi_donor,
       round(avg(psi_acceptor), 9) AS mean_psi_acceptor, round(quantile_cont(psi_acceptor, 0.5), 9) AS median_psi_acceptor
FROM n WHERE gene_id IS NOT NULL GROUP BY gene_id"""
_SITES = "sample_id, chrom, strand, donor, acceptor"

ORACLES = {
    "p1_keep_columns": oracle(_J, "SELECT chrom, donor, count AS reads FROM fx_junctions"),
    "p4_parse_junction": oracle(_J, "SELECT chrom, donor, acceptor, CASE WHEN donor % 3 = 1 THEN '+' ELSE strand END AS strand, count(*) AS n FROM fx_junctions GROUP BY 1, 2, 3, 4"),
    "p10_strand_sites": oracle(_J, "SELECT sample_id, chrom, strand, CASE WHEN strand = '-' THEN acceptor - 1 ELSE donor END AS donor_site, CASE WHEN strand = '-' THEN donor ELSE acceptor END AS acceptor_site FROM fx_junctions"),
    "p11_spans": oracle(_J, f"SELECT {_SITES}, acceptor - donor AS junction_length, CAST(floor((donor + acceptor) / 2) AS BIGINT) AS midpoint FROM fx_junctions"),
    "p25_sample_names": "SELECT s_suppkey, regexp_replace(s_name, '[^\\p{L}\\p{N}]', '_', 'g') AS sample_name FROM supplier",
    "f1_chromosomes": oracle(_J, "SELECT chrom, count(*) AS n FROM fx_junctions WHERE chrom IN ('A', 'R') GROUP BY chrom"),
    "f3_min_count": oracle(_J, f"SELECT {_SITES}, count AS reads FROM fx_junctions WHERE count >= 10"),
    "f4_covered": oracle(_J, f"SELECT {_SITES}, count AS reads FROM fx_junctions QUALIFY count(*) FILTER (count >= 10) OVER (PARTITION BY chrom, donor, acceptor, strand) >= 2"),
    "f5_psi_gated": oracle(_J, f"{_PSI.format(30)} SELECT {_SITES}, round(psi_donor, 9) AS psi_donor, round(psi_acceptor, 9) AS psi_acceptor FROM p"),
    "f6_min_samples": oracle(_FAR, f"{_FAR_PSI}, {_GENE} {_SUMMARY} HAVING count(DISTINCT sample_id) >= 20"),
    "f9_smoke": oracle(_J, "SELECT sample_id, count(*) AS n FROM fx_junctions WHERE sample_id IN (SELECT DISTINCT sample_id FROM fx_junctions ORDER BY 1 LIMIT 3) GROUP BY 1"),
    "a1_psi_totals": oracle(_J, f"{_PSI.format(0)} SELECT {_SITES}, donor_total, acceptor_total, round(psi_donor, 9) AS psi_donor, round(psi_acceptor, 9) AS psi_acceptor FROM p"),
    "a2_gene_psi_summary": oracle(_FAR, f"{_FAR_PSI}, {_GENE} {_SUMMARY}"),
    "a3_roll_up": oracle(_FAR, f"{_FAR_PSI}, {_GENE} SELECT chrom, donor, acceptor, strand, gene_id, CAST(sum(count) AS BIGINT) AS reads, round(avg(psi_donor), 9) AS psi_donor, round(avg(psi_acceptor), 9) AS psi_acceptor FROM n WHERE gene_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5"),
    "a4_window_metrics": oracle(
        _J,
        f"""{_PSI.format(20)}, w AS (SELECT *, acceptor - donor AS jl, s * {STRIDE} AS start_pos FROM p, range(0, 20) r(s) WHERE s * {STRIDE} <= floor((donor + acceptor) / 2) AND floor((donor + acceptor) / 2) < s * {STRIDE} + {WINDOW})
SELECT chrom, CAST(start_pos AS BIGINT) AS start_pos, CAST(start_pos + {WINDOW} AS BIGINT) AS end_pos, CAST(sum(count) AS BIGINT) AS gtex_count_sum, count(count) AS gtex_count_count, round(avg(count), 9) AS gtex_count_mean,
       round(avg(psi_donor), 9) AS gtex_psi_donor_mean, round(avg(psi_acceptor), 9) AS gtex_psi_acceptor_mean, round(avg(jl), 9) AS gtex_junction_length_mean, min(jl) AS gtex_junction_length_min, max(jl) AS gtex_junction_length_max
FROM w GROUP BY 1, 2, 3""",
    ),
    "a11_rows_by_chromosome": oracle(_J, "SELECT coalesce(CASE WHEN donor % 7 <> 0 THEN chrom END, 'unparseable') AS chrom, count(*) AS n FROM fx_junctions GROUP BY 1"),
    "a12_quality_thresholds": oracle(
        _J,
        "q AS (SELECT count(*) FILTER (count >= 20) AS n FROM fx_junctions WHERE chrom = 'R' GROUP BY donor, acceptor, strand) SELECT CAST(t AS INTEGER) AS threshold, count(*) FILTER (n >= t) AS n_junctions, round(100.0 * count(*) FILTER (n >= t) / count(*), 9) AS percent FROM q, (VALUES (1), (5), (10), (20)) v(t) GROUP BY t",
    ),
    "j1_totals_by_join": oracle(_J, f"SELECT {_SITES}, {_T.format('donor')}, {_T.format('acceptor')} FROM fx_junctions"),
    "j2_gene_of_junction": oracle(_FAR, f"p AS (SELECT * FROM fx_far_junctions), {_GENE} SELECT {_SITES}, gene_id FROM n"),
    "j3_midpoint_in_window": oracle(
        [*_J, "fx_genes"],
        "j AS (SELECT DISTINCT chrom, strand, donor, acceptor, CAST(floor((donor + acceptor) / 2) AS BIGINT) AS midpoint FROM fx_junctions) SELECT gene_id, count(*) AS n_junctions, CAST(sum(midpoint) AS BIGINT) AS sum_midpoints FROM j JOIN fx_genes g ON j.chrom = g.chrom AND j.strand = g.strand AND start_pos <= midpoint AND midpoint < end_pos GROUP BY gene_id",
    ),
    "j11_overlapping_genes": oracle(["fx_genes"], "SELECT x.gene_id AS a, count(*) AS n_overlaps FROM fx_genes x JOIN fx_genes y ON x.chrom = y.chrom AND x.strand = y.strand AND x.start_pos < y.end_pos AND x.end_pos > y.start_pos AND x.gene_id < y.gene_id GROUP BY 1"),
    "u1_union_all": oracle(_J, "SELECT chrom, strand, CAST(sum(count) AS BIGINT) AS reads FROM fx_junctions GROUP BY 1, 2"),
    "u4_finished_chromosomes": oracle(_J, "SELECT DISTINCT chrom, strand FROM fx_junctions EXCEPT SELECT DISTINCT chrom, strand FROM fx_junctions WHERE count > 100"),
}
