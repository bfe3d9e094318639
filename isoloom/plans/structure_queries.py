"""Queries on transcript structure, sequences and nonsense-mediated decay."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoloom.functions import arrays, ids, sequence
from isoloom.operators import intervals, nmd, structure
from isoloom.plans.fixtures import oracle, positions, view

WINDOW, STRIDE, BIN = 2000, 1000, 100
TILE, HOP = 512, 256
#: Weights of the example network: 5 -> 3 -> 1.
NETWORK = (((0.2, -0.1, 0.5, 0.3, 1.0), (-0.3, 0.2, 0.1, -0.5, 0.7), (0.05, 0.4, -0.2, 0.6, -0.4)), (0.1, -0.2, 0.05), (0.8, -0.6, 0.4), -0.3)


def _exons(spark, sf_dir):
    return view(spark, sf_dir, "fx_exons")


def _lengths(spark, sf_dir):
    return _exons(spark, sf_dir).groupBy("chrom").agg(F.max("end").alias("length"))


def _isoforms(spark, sf_dir):
    """(tx, strand, exons in transcription order, cds)."""
    item = F.struct("start", "end", F.lit(1.0).alias("score"))
    exons = _exons(spark, sf_dir).groupBy("tx", "gene_id", "strand").agg(F.array_sort(F.collect_list(item)).alias("exons"))
    cds = view(spark, sf_dir, "fx_cds").groupBy("tx").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("cds"))
    return exons.withColumn("exons", F.when(F.col("strand") == "-", F.reverse("exons")).otherwise(F.col("exons"))).join(cds, "tx", "left")


def r9(c, name):
    return F.round(c, 9).alias(name)


def w1_introns(spark, sf_dir):
    return structure.introns(_exons(spark, sf_dir))


def f2_features(spark, sf_dir):
    e = _exons(spark, sf_dir).withColumn("feature", F.when(F.col("rank") % 2 == 0, "exon").otherwise("CDS"))
    return structure.features(e, ("exon",), ("chr1", "chr3")).select("tx", "chrom", "rank")


def a6_transcript_bounds(spark, sf_dir):
    return positions(structure.bounds(_exons(spark, sf_dir)))


def a7_site_sets(spark, sf_dir):
    return structure.sites(_exons(spark, sf_dir))


def x1_tiles(spark, sf_dir):
    return positions(intervals.tiles(view(spark, sf_dir, "fx_contigs").select("chrom", "length"), TILE, HOP, 8).select("chrom", "start", "end"))


def a8_binned_tracks(spark, sf_dir):
    t = structure.binned_tracks(structure.sites(_exons(spark, sf_dir)), _lengths(spark, sf_dir), WINDOW, STRIDE, BIN)
    d = structure.densified(t, WINDOW // BIN)
    return d.select("chrom", F.col("start").alias("start_pos"), *(F.array_join(k, "").alias(k) for k in structure.KINDS))


def j6_site_bins(spark, sf_dir):
    t = structure.binned_tracks(structure.sites(_exons(spark, sf_dir)), _lengths(spark, sf_dir), WINDOW, STRIDE, BIN)
    return t.select("chrom", F.col("start").alias("start_pos"), *(F.array_join(k, ",").alias(k) for k in structure.KINDS))


def p3_half_open(spark, sf_dir):
    return _exons(spark, sf_dir).select("tx", "rank", (F.col("start") - 1).alias("start_pos"), F.col("end").alias("end_pos"))


def p7_isoform_key(spark, sf_dir):
    return _isoforms(spark, sf_dir).select("tx", ids.isoform_key(F.col("exons"), F.col("strand")).alias("isoform_key"))


def p26_isoform_properties(spark, sf_dir):
    return _isoforms(spark, sf_dir).select(
        "tx", F.size("exons").alias("n_exons"), arrays.exon_length(F.col("exons")).alias("tx_length"), F.array_min(F.transform("exons", lambda e: e["start"])).alias("start_pos"),
        F.array_max(F.transform("exons", lambda e: e["end"])).alias("end_pos"), arrays.in_order(F.col("exons"), F.col("strand")).alias("in_order"),
    )


def t1_transcription_order(spark, sf_dir):
    return _isoforms(spark, sf_dir).select("tx", F.posexplode("exons").alias("place", "e")).select("tx", "place", F.col("e.start").alias("start_pos"))


def w2_offsets(spark, sf_dir):
    return positions(nmd.with_offsets(_exons(spark, sf_dir)).select("tx", "rank", "offset", "n_exons", "tx_length", "last_junction_tx"))


def j10_coding_transcripts(spark, sf_dir):
    e = _exons(spark, sf_dir).select("tx").distinct()
    late = view(spark, sf_dir, "fx_cds").where("start > 2000").select("tx").distinct()
    return e.join(late, "tx", "left_semi").withColumn("coding", F.lit(True)).unionByName(e.join(late, "tx", "left_anti").withColumn("coding", F.lit(False)))


def j12_to_transcript(spark, sf_dir):
    points = view(spark, sf_dir, "fx_cds").select("tx", F.col("start").alias("point"))
    return nmd.to_transcript(points, nmd.with_offsets(_exons(spark, sf_dir)), "point", "tx_pos").groupBy("tx").agg(F.sum("tx_pos").alias("sum_tx_pos"), F.count(F.lit(1)).alias("n"))


def n1_labels(spark, sf_dir):
    return nmd.labels(_exons(spark, sf_dir), view(spark, sf_dir, "fx_cds")).drop("gene_id")


def n1_labels_legacy(spark, sf_dir):
    return nmd.labels(_exons(spark, sf_dir), view(spark, sf_dir, "fx_cds"), legacy=True).drop("gene_id")


def n2_stop_distance(spark, sf_dir):
    return _isoforms(spark, sf_dir).select("tx", nmd.stop_distance(F.col("exons"), F.col("strand"), F.col("cds")).alias("distance"))


def n3_hard_rule(spark, sf_dir):
    d = nmd.stop_distance(F.col("exons"), F.col("strand"), F.col("cds"))
    return _isoforms(spark, sf_dir).select("tx", nmd.hard_rule(d).alias("over"), nmd.hard_rule(d, strict=False).alias("at_least"))


def n4_soft_rule(spark, sf_dir):
    s = nmd.scores(_isoforms(spark, sf_dir))
    return s.select("tx", r9("rule_soft", "rule_soft"))


def n5_features(spark, sf_dir):
    s = nmd.scores(_isoforms(spark, sf_dir))
    f = nmd.feature_vector(F.col("exons"), F.col("rule_soft"))
    return s.select("tx", *(r9(F.get(f, k), f"x{k}") for k in range(5)))


def n6_hybrid_scores(spark, sf_dir):
    s = nmd.scores(_isoforms(spark, sf_dir), NETWORK, "hybrid", 0.4)
    return s.select("tx", r9("p", "p"))


def n7_score_details(spark, sf_dir):
    s = nmd.scores(_isoforms(spark, sf_dir), NETWORK, "learned")
    return s.select("tx", "distance", "rule_hard", r9("rule_soft", "rule_soft"), "mode", r9("p", "p"))


def p8_revcomp(spark, sf_dir):
    return view(spark, sf_dir, "fx_contigs").select("chrom", sequence.revcomp(F.col("seq")).alias("rc"))


def p9_tokens(spark, sf_dir):
    return view(spark, sf_dir, "fx_contigs").select("chrom", F.array_join(sequence.tokens(F.col("seq"), 64), "").alias("tokens"))


def p12_padded_windows(spark, sf_dir):
    c = view(spark, sf_dir, "fx_contigs").withColumn("at", F.explode(F.array(F.lit(-40).cast("long"), F.col("length").cast("long") - 40)))
    return c.select("chrom", F.col("at").alias("start_pos"), sequence.padded_window(F.col("seq"), F.col("length"), F.col("at"), F.col("at") + 100).alias("piece"))


def p13_crops(spark, sf_dir):
    return view(spark, sf_dir, "fx_contigs").select("chrom", sequence.crop(F.col("seq"), F.col("chrom"), 100, 7).alias("piece"))


def p14_fitted(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, F.lit(1) + (F.col("vec_id") % 64).cast("int")).alias("v"))
    return e.select("vec_id", F.size(arrays.fit(F.transform("v", lambda x: x.cast("double")), 32, 0)).alias("n"), r9(F.aggregate(arrays.fit(F.transform("v", lambda x: x.cast("double")), 32, 0), F.lit(0.0), lambda a, x: a + x), "total"))


def p23_spliced_cdna(spark, sf_dir):
    c = view(spark, sf_dir, "fx_contigs").where("length >= 60")
    third = (F.col("length") / 3).cast("long")  # three exons over the whole contig
    exons = F.array(*(F.struct((F.lit(a) + k * third).cast("long").alias("start"), e.cast("long").alias("end")) for k, (a, e) in enumerate(((5, third), (10, 2 * third), (7, F.col("length"))))))
    strand = F.when(F.col("contig_no") % 2 == 0, "+").otherwise("-")
    return c.select("chrom", sequence.spliced_cdna(exons, F.col("seq"), strand).alias("cdna"))


def p24_stop_gain(spark, sf_dir):
    table = spark.createDataFrame(sequence.stop_edits(), "codon string, offset int, new_base string")
    # cut from left to right in one pass: substr would count from the sequence's beginning for each codon
    each = F.posexplode(F.regexp_extract_all("seq", F.lit("(?s).{3}"), F.lit(0))).alias("k", "codon")
    codons = view(spark, sf_dir, "fx_contigs").select("chrom", each).withColumn("at", F.col("k") * 3)
    hits = codons.join(F.broadcast(table), "codon")  # 64 rows at most
    spec = ids.variant_spec(F.col("chrom"), F.col("at") + F.col("offset") + 1, F.col("codon").substr(F.col("offset") + 1, F.lit(1)), F.col("new_base"))
    return hits.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min(spec).alias("first_spec"), F.max(spec).alias("last_spec"))


_QUERIES = (
    w1_introns, w2_offsets, f2_features, a6_transcript_bounds, a7_site_sets, a8_binned_tracks, j6_site_bins, j10_coding_transcripts, j12_to_transcript, x1_tiles, t1_transcription_order, p3_half_open,
    p7_isoform_key, p8_revcomp, p9_tokens, p12_padded_windows, p13_crops, p14_fitted, p23_spliced_cdna, p24_stop_gain, p26_isoform_properties, n1_labels, n1_labels_legacy, n2_stop_distance, n3_hard_rule, n4_soft_rule,
    n5_features, n6_hybrid_scores, n7_score_details,
)
QUERIES = {f.__name__: f for f in _QUERIES}

_E, _C = ["fx_exons"], ["fx_contigs"]
_INTRON = "i AS (SELECT tx, chrom, strand, end_pos AS left_end, lead(start_pos) OVER (PARTITION BY tx, chrom ORDER BY start_pos, end_pos) AS right_start FROM fx_exons QUALIFY right_start IS NOT NULL)"
_BOUNDS = "b AS (SELECT tx, chrom, strand, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM fx_exons GROUP BY 1, 2, 3)"
_SITES = f"""{_INTRON}, {_BOUNDS},
s AS (SELECT chrom, 'donor' AS kind, CASE WHEN strand = '+' THEN left_end - 1 ELSE right_start END AS pos FROM i UNION SELECT chrom, 'acceptor', CASE WHEN strand = '+' THEN right_start ELSE left_end - 1 END FROM i
      UNION SELECT chrom, 'tss', CASE WHEN strand = '+' THEN start_pos ELSE end_pos - 1 END FROM b UNION SELECT chrom, 'polya', CASE WHEN strand = '+' THEN end_pos - 1 ELSE start_pos END FROM b)"""
_TILED = f"""{_SITES}, l AS (SELECT chrom, max(end_pos) AS length FROM fx_exons GROUP BY 1),
w AS (SELECT chrom, CAST(k * {STRIDE} AS BIGINT) AS start_pos FROM l, range(0, 1000) r(k) WHERE k * {STRIDE} + {WINDOW} <= length)"""
_OFFSETS = """o AS (SELECT *, CAST(coalesce(sum(end_pos - start_pos) OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '-' THEN -start_pos ELSE start_pos END, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
      count(*) OVER (PARTITION BY tx) AS n_exons, CAST(sum(end_pos - start_pos) OVER (PARTITION BY tx) AS BIGINT) AS tx_length FROM fx_exons),
j AS (SELECT *, max("offset") OVER (PARTITION BY tx) AS last_junction_tx FROM o)"""
_AT = "CASE WHEN x.strand = '-' THEN x.\"offset\" + x.end_pos - 1 - {0} ELSE x.\"offset\" + {0} - x.start_pos END"
_DIST = f"""{_OFFSETS}, c AS (SELECT tx, CASE WHEN strand = '-' THEN min(start_pos) + 2 ELSE max(end_pos) - 3 END AS stop FROM fx_cds GROUP BY tx, strand),
p AS (SELECT x.tx, max({_AT.format("stop")}) AS at FROM j x JOIN c ON x.tx = c.tx AND stop >= x.start_pos AND stop < x.end_pos GROUP BY x.tx),
t AS (SELECT tx, strand, max(n_exons) AS n_exons, max(tx_length) AS tx_length, max(last_junction_tx) AS last_junction_tx FROM j GROUP BY 1, 2),
d AS (SELECT t.*, CASE WHEN n_exons > 1 THEN last_junction_tx - p.at END AS distance FROM t LEFT JOIN p ON t.tx = p.tx),
s AS (SELECT *, coalesce(1 / (1 + exp(-(distance - 55) / 10.0)), 0.0) AS rule_soft, CASE WHEN distance > 55 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rule_hard FROM d),
f AS (SELECT *, n_exons::DOUBLE AS x0, tx_length / 1000.0 AS x1, CASE WHEN n_exons > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x2, (tx_length - last_junction_tx) / tx_length AS x3, rule_soft AS x4 FROM s)"""
_UNITS = ", ".join("greatest(" + " + ".join(f"({w}) * x{k}" for k, w in enumerate(ws)) + f" + ({b}), 0.0) AS u{i}" for i, (ws, b) in enumerate(zip(NETWORK[0], NETWORK[1], strict=True)))
_LEARNED = f"{_DIST}, u AS (SELECT *, {_UNITS} FROM f), m AS (SELECT *, 1 / (1 + exp(-({' + '.join(f'({w}) * u{i}' for i, w in enumerate(NETWORK[2]))} + ({NETWORK[3]})))) AS learned FROM u)"


def _labels(first: str, last: str, stop: str) -> str:
    return f"""{_OFFSETS}, c AS (SELECT tx, strand, min(start_pos) AS lo, max(end_pos) AS hi, max(start_pos) AS top_start, min(end_pos) AS low_end FROM fx_cds GROUP BY 1, 2),
e AS (SELECT tx, CASE WHEN strand = '+' THEN lo ELSE {first} END AS a, CASE WHEN strand = '+' THEN hi - 1 ELSE {last} END AS z FROM c),
p AS (SELECT x.tx, x.chrom, x.strand, x.n_exons, x.last_junction_tx, {_AT.format("a")} AS cds_tx_start FROM j x JOIN e ON x.tx = e.tx AND a >= start_pos AND a < end_pos WHERE n_exons > 1),
q AS (SELECT p.*, {_AT.format("z")} AS cds_tx_end FROM p JOIN e ON p.tx = e.tx JOIN j x ON x.tx = p.tx AND z >= x.start_pos AND z < x.end_pos),
d AS (SELECT *, last_junction_tx - ({stop}) AS distance FROM q)
SELECT tx, chrom, strand, n_exons, cds_tx_start, cds_tx_end, last_junction_tx, distance, CAST(distance > 55 AS INTEGER) AS nmd_label FROM d"""


_GAIN = ", ".join(f"('{c}', {o}, '{b}')" for c, o, b in sequence.stop_edits())
ORACLES = {
    "w1_introns": oracle(_E, f"{_INTRON} SELECT * FROM i"),
    "f2_features": oracle(_E, "SELECT tx, chrom, rank FROM fx_exons WHERE rank % 2 = 0 AND chrom IN ('chr1', 'chr3')"),
    "a6_transcript_bounds": oracle(_E, f"{_BOUNDS} SELECT * FROM b"),
    "a7_site_sets": oracle(_E, f"{_SITES} SELECT * FROM s"),
    "x1_tiles": oracle(_C, f"SELECT chrom, CAST(k * {HOP} AS BIGINT) AS start_pos, CAST(k * {HOP} + {TILE} AS BIGINT) AS end_pos FROM (SELECT chrom, length, unnest(range(0, length // {HOP} + 1)) AS k FROM fx_contigs) c WHERE k * {HOP} + {TILE} <= length"),
    "a8_binned_tracks": oracle(
        _E,
        f"""{_TILED}, g AS (SELECT chrom, start_pos, b FROM w, range(0, {WINDOW // BIN}) r(b)),
h AS (SELECT g.*, kind FROM g LEFT JOIN s ON s.chrom = g.chrom AND pos >= start_pos + b * {BIN} AND pos < start_pos + (b + 1) * {BIN}),
d AS (SELECT chrom, start_pos, b, {", ".join(f"CASE WHEN count(*) FILTER (kind = '{k}') > 0 THEN '1' ELSE '0' END AS {k}" for k in structure.KINDS)} FROM h GROUP BY 1, 2, 3)
SELECT chrom, start_pos, {", ".join(f"string_agg({k}, '' ORDER BY b) AS {k}" for k in structure.KINDS)} FROM d GROUP BY 1, 2""",
    ),
    "j6_site_bins": oracle(
        _E,
        f"""{_TILED}, h AS (SELECT DISTINCT w.chrom, w.start_pos, kind, (pos - start_pos) // {BIN} AS b FROM w LEFT JOIN s ON s.chrom = w.chrom AND pos >= start_pos AND pos < start_pos + {WINDOW})
SELECT chrom, start_pos, {", ".join(f"coalesce(string_agg(b::STRING, ',' ORDER BY b) FILTER (kind = '{k}'), '') AS {k}" for k in structure.KINDS)} FROM h GROUP BY 1, 2""",
    ),
    "p3_half_open": oracle(_E, "SELECT tx, rank, start_pos - 1 AS start_pos, end_pos FROM fx_exons"),
    "p7_isoform_key": oracle(_E, "SELECT tx, strand || ':' || string_agg(start_pos || '-' || end_pos, ',' ORDER BY CASE WHEN strand = '-' THEN -start_pos ELSE start_pos END) AS isoform_key FROM fx_exons GROUP BY tx, strand"),
    "p26_isoform_properties": oracle(_E, "SELECT tx, CAST(count(*) AS INTEGER) AS n_exons, CAST(sum(end_pos - start_pos) AS BIGINT) AS tx_length, min(start_pos) AS start_pos, max(end_pos) AS end_pos, true AS in_order FROM fx_exons GROUP BY tx"),
    "t1_transcription_order": oracle(_E, "SELECT tx, CAST(row_number() OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '-' THEN -start_pos ELSE start_pos END) - 1 AS INTEGER) AS place, start_pos FROM fx_exons"),
    "w2_offsets": oracle(_E, f'{_OFFSETS} SELECT tx, rank, "offset", n_exons, tx_length, last_junction_tx FROM j'),
    "j10_coding_transcripts": oracle([*_E, "fx_cds"], "SELECT DISTINCT tx, tx IN (SELECT tx FROM fx_cds WHERE start_pos > 2000) AS coding FROM fx_exons"),
    "j12_to_transcript": oracle([*_E, "fx_cds"], f"{_OFFSETS} SELECT x.tx, CAST(sum({_AT.format('c.start_pos')}) AS BIGINT) AS sum_tx_pos, count(*) AS n FROM j x JOIN fx_cds c ON x.tx = c.tx AND c.start_pos >= x.start_pos AND c.start_pos < x.end_pos GROUP BY x.tx"),
    "n1_labels": oracle([*_E, "fx_cds"], _labels("hi - 1", "lo", "cds_tx_end - 2")),
    "n1_labels_legacy": oracle([*_E, "fx_cds"], _labels("top_start", "low_end - 1", "CASE WHEN strand = '+' THEN cds_tx_end - 2 ELSE cds_tx_start END")),
    "n2_stop_distance": oracle([*_E, "fx_cds"], f"{_DIST} SELECT tx, distance FROM d"),
    "n3_hard_rule": oracle([*_E, "fx_cds"], f"{_DIST} SELECT tx, coalesce(distance > 55, false) AS over, coalesce(distance >= 55, false) AS at_least FROM d"),
    "n4_soft_rule": oracle([*_E, "fx_cds"], f"{_DIST} SELECT tx, round(rule_soft, 9) AS rule_soft FROM s"),
    "n5_features": oracle([*_E, "fx_cds"], f"{_DIST} SELECT tx, {', '.join(f'round(x{k}, 9) AS x{k}' for k in range(5))} FROM f"),
    "n6_hybrid_scores": oracle([*_E, "fx_cds"], f"{_LEARNED} SELECT tx, round(0.4 * rule_soft + 0.6 * learned, 9) AS p FROM m"),
    "n7_score_details": oracle([*_E, "fx_cds"], f"{_LEARNED} SELECT tx, distance, rule_hard, round(rule_soft, 9) AS rule_soft, 'learned' AS mode, round(learned, 9) AS p FROM m"),
    "p8_revcomp": oracle(_C, "SELECT chrom, reverse(translate(upper(seq), 'ACGTN', 'TGCAN')) AS rc FROM fx_contigs"),
    "p9_tokens": oracle(_C, "SELECT chrom, rpad(translate(substr(seq, 1, 64), 'ACGTN', '12345'), 64, '0') AS tokens FROM fx_contigs"),
    "p12_padded_windows": oracle(
        _C,
        "a AS (SELECT chrom, seq, length, CAST(unnest([-40, length - 40]) AS BIGINT) AS s FROM fx_contigs) SELECT chrom, s AS start_pos, string_agg(CASE WHEN s + k >= 0 AND s + k < length THEN substr(seq, CAST(s + k + 1 AS BIGINT), 1) ELSE 'N' END, '' ORDER BY k) AS piece FROM (SELECT row_number() OVER () AS id, * FROM a) b, range(0, 100) r(k) GROUP BY id, chrom, s",
    ),
    "p13_crops": oracle(_C, "SELECT chrom, CASE WHEN length > 100 THEN substr(seq, CAST(('0x' || substr(md5('7:' || chrom), 1, 8))::BIGINT % (length - 99) + 1 AS BIGINT), 100) ELSE seq END AS piece FROM fx_contigs"),
    "p14_fitted": "SELECT vec_id, CAST(32 AS INTEGER) AS n, round(list_sum(CAST(embedding[1:least(32, 1 + vec_id % 64)] AS DOUBLE[])), 9) AS total FROM embeddings",
    "p23_spliced_cdna": oracle(_C, "c AS (SELECT chrom, contig_no, substr(seq, 6, length // 3 - 5) || substr(seq, length // 3 + 11, length // 3 - 10) || substr(seq, length // 3 * 2 + 8) AS m FROM fx_contigs WHERE length >= 60) SELECT chrom, CASE WHEN contig_no % 2 = 0 THEN m ELSE reverse(translate(m, 'ACGTN', 'TGCAN')) END AS cdna FROM c"),
    "p24_stop_gain": oracle(
        _C,
        f"g(codon, off, base) AS (VALUES {_GAIN}), k AS (SELECT chrom, seq, unnest(range(0, length // 3)) * 3 AS a FROM fx_contigs), h AS (SELECT k.chrom, chrom || ':' || (a + off + 1) || substr(codon, off + 1, 1) || '>' || base AS spec FROM k JOIN g ON substr(seq, a + 1, 3) = codon) SELECT chrom, count(*) AS n, min(spec) AS first_spec, max(spec) AS last_spec FROM h GROUP BY 1",
    ),
}
