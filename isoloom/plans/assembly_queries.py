"""Queries on splice graphs, isoforms and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoloom.functions.arrays import log_sigmoid, sigmoid
from isoloom.operators import assembly, evaluation, nmd
from isoloom.plans.fixtures import oracle, view
from isoloom.sources.scratch import written

#: High thresholds, since the tracks derived from embeddings have no sharp peaks.
CONFIG = assembly.Config(thresholds={"donor": 0.95, "acceptor": 0.95, "tss": 0.9, "polya": 0.9}, max_starts=3, max_ends=3, max_intron=40, beam=4, max_paths=6)


def _tracks(spark, sf_dir):
    return view(spark, sf_dir, "fx_tracks").withColumn("strand", F.when(F.col("locus") % 2 == 0, "+").otherwise("-"))


def _peaks(spark, sf_dir):
    return written(assembly.peaks(_tracks(spark, sf_dir), CONFIG), "peaks")


def _graph(spark, sf_dir):
    found = _peaks(spark, sf_dir)
    nodes = written(assembly.exons(found, CONFIG), "exons")
    return found, nodes, written(assembly.edges(nodes, found, CONFIG), "introns")


def _paths(spark, sf_dir):
    _, nodes, links = _graph(spark, sf_dir)
    return written(assembly.paths(nodes, links, CONFIG), "paths")


def r9(c, name):
    return F.round(c, 9).alias(name)


def p22_sigmoids(spark, sf_dir):
    x = F.col("logit")
    return _tracks(spark, sf_dir).select("locus", "track", "pos", r9(sigmoid(x), "sigmoid"), r9(log_sigmoid(x), "log_sigmoid"))


def w5_peaks(spark, sf_dir):
    return _peaks(spark, sf_dir).select("locus", "strand", "track", "pos", r9("p", "p"))


def j8_candidate_exons(spark, sf_dir):
    return assembly.exons(_peaks(spark, sf_dir), CONFIG).select("locus", "strand", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), r9("score", "score"))


def u6_best_exons(spark, sf_dir):
    return assembly.exons(_peaks(spark, sf_dir), CONFIG).groupBy("locus").agg(F.count(F.lit(1)).alias("n_exons"), r9(F.max("score"), "best"))


def j9_introns(spark, sf_dir):
    _, _, links = _graph(spark, sf_dir)
    return links.select("locus", "strand", "src_start", "src_end", "dst_start", "dst_end", r9("score", "score"))


def g1_graph_sizes(spark, sf_dir):
    _, nodes, links = _graph(spark, sf_dir)
    n = nodes.groupBy("locus").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = links.groupBy("locus").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, "locus", "left").select("locus", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def j10_source_exons(spark, sf_dir):
    _, nodes, links = _graph(spark, sf_dir)
    return assembly.sources(nodes, links).select("locus", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


def g2_paths(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.select("locus", "rank", F.size("exons").alias("n_exons"), F.array_join(F.transform("exons", lambda e: F.concat_ws("-", e["start"], e["end"])), ",").alias("path"), r9("score", "score"))


def t3_best_path(spark, sf_dir):
    return _paths(spark, sf_dir).where("rank = 1").select("locus", r9("score", "score"))


def u7_distinct_paths(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy("locus").agg(F.count_distinct("exons").alias("n_paths"), F.max("rank").alias("last_rank"))


def w7_near_peak(spark, sf_dir):
    return assembly.near_peak(_tracks(spark, sf_dir), "tss", 2).select("locus", "pos", r9("best", "best"))


def g3_path_scores(spark, sf_dir):
    s = assembly.path_scores(_paths(spark, sf_dir), _tracks(spark, sf_dir), None, CONFIG)
    return s.select("locus", "rank", *(r9(c, c) for c in ("s_spl", "s_tss", "s_pa", "s_len", "path_score")))


def g4_length_prior(spark, sf_dir):
    return _paths(spark, sf_dir).select("locus", "rank", assembly.length_prior(F.col("exons")).alias("prior"))


def _orf_tracks(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    names = {"donor": "orf_start", "acceptor": "orf_stop", "tss": "orf_frame0", "polya": "orf_frame1"}
    orf = [t.where(F.col("track") == a).withColumn("track", F.lit(b)) for a, b in names.items()] + [t.where("track = 'donor'").withColumn("track", F.lit("orf_frame2")).withColumn("logit", -F.col("logit"))]
    tracks = orf[0]
    for x in orf[1:]:
        tracks = tracks.unionByName(x)
    return tracks


def g5_orf_from_tracks(spark, sf_dir):
    return assembly.orf_from_tracks(_paths(spark, sf_dir), _orf_tracks(spark, sf_dir)).select("locus", "rank", r9("s_orf", "s_orf"))


def g6_orf_from_sequence(spark, sf_dir):
    c = view(spark, sf_dir, "fx_contigs")
    t = c.select("chrom", F.col("seq").alias("cdna"), F.when(F.col("contig_no") % 2 == 0, F.floor(F.col("length") * 0.7).cast("long")).alias("last_junction"))
    return assembly.orf_from_sequence(t, ["chrom"], 5, 60).select("chrom", r9("s_orf", "s_orf"))


def _decoded(spark, sf_dir):
    return written(assembly.decode(_tracks(spark, sf_dir), CONFIG), "decoded")


def g7_decode(spark, sf_dir):
    return _decoded(spark, sf_dir).select("locus", "rank", "iso_rank", r9("path_score", "path_score"))


def g7_decode_with_orf(spark, sf_dir):
    tracks = _tracks(spark, sf_dir).unionByName(_orf_tracks(spark, sf_dir))
    d = assembly.decode(tracks, CONFIG, orf_tracks=True)
    return d.select("locus", "rank", "iso_rank", F.round("path_score", 6).alias("path_score"))


def w3_softmax_psi(spark, sf_dir):
    return assembly.with_psi(_decoded(spark, sf_dir)).select("locus", "rank", r9("psi", "psi"))


def w4_dominant(spark, sf_dir):
    return assembly.dominant(_decoded(spark, sf_dir)).select("locus", "rank", r9("path_score", "path_score"))


def g8_locus_summary(spark, sf_dir):
    d = _decoded(spark, sf_dir)
    loci = _tracks(spark, sf_dir).select("locus", "strand").distinct()
    span = F.struct(F.get("exons", 0)["start"].alias("start"), F.get("exons", 0)["end"].alias("end"))  # as if the first exon coded
    p = nmd.scores(d.withColumn("cds", span), threshold=5)
    s = assembly.summary(loci, d, p)
    return s.select("locus", "n_isoforms", "dominant_rank", "dominant_exons", r9("psi", "psi"), "p_nmd")


def _examples(spark, sf_dir):
    """Predictions and truths over the same transcripts: the truth's exons, some shifted, dropped or in another order."""
    e = view(spark, sf_dir, "fx_exons")
    item = F.struct("start", "end")
    truth = e.groupBy(F.col("tx").alias("example"), "strand").agg(F.array_sort(F.collect_list(item)).alias("exons"))
    ranks = truth.where("example % 7 <> 0").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(3))))
    moved = F.transform("exons", lambda x: F.struct((x["start"] + F.col("shift")).alias("start"), (x["end"] + F.col("shift")).alias("end")))
    preds = ranks.withColumn("shift", (F.col("example") * F.col("rank")) % 4).withColumn("exons", moved)
    preds = preds.withColumn("exons", F.when((F.col("example") % 5 == 0) & (F.size("exons") > 1), F.slice("exons", F.lit(1), F.size("exons") - 1)).otherwise(F.col("exons")))
    return preds.select("example", "rank", "strand", "exons"), truth


def e1_junctions(spark, sf_dir):
    _, t = _examples(spark, sf_dir)
    j = evaluation.junctions(evaluation.in_transcription_order(F.col("exons"), F.col("strand")))
    return t.select("example", F.explode(j).alias("j")).select("example", "j.donor", "j.acceptor")


def e2_chain_match(spark, sf_dir):
    return evaluation.evaluate(*_examples(spark, sf_dir), k=3, slop=1).select("example", "chain")


def e3_junction_f1(spark, sf_dir):
    return evaluation.evaluate(*_examples(spark, sf_dir), k=3).select("example", r9("precision", "precision"), r9("recall", "recall"), r9("f1", "f1"))


def u5_slop_matches(spark, sf_dir):
    return evaluation.evaluate(*_examples(spark, sf_dir), k=3, slop=2).select("example", r9("precision", "precision"), r9("recall", "recall"))


def t4_topk_recall(spark, sf_dir):
    return evaluation.evaluate(*_examples(spark, sf_dir), k=2).select("example", "topk")


def j13_examples(spark, sf_dir):
    """Some predictions here have no truth, and some truths no prediction: all show up."""
    p, t = _examples(spark, sf_dir)
    a = evaluation.aligned(p.where("rank = 1").drop("strand", "exons"), t.where("example % 11 <> 3").select("example"))
    return a.groupBy("has_truth", "has_pred").agg(F.count(F.lit(1)).alias("n"), F.sum("example").alias("examples"))


def e4_evaluate_set(spark, sf_dir):
    m = evaluation.means(evaluation.evaluate(*_examples(spark, sf_dir), k=3, slop=1))
    return m.select("n", *(r9(c, c) for c in m.columns[1:]))


def a14_means(spark, sf_dir):
    m = evaluation.means(evaluation.evaluate(*_examples(spark, sf_dir), k=2))
    return m.select("n", *(r9(c, c) for c in m.columns[1:]))


def _scored(spark, sf_dir):
    return view(spark, sf_dir, "fx_scored")


def a15_masked_losses(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("pad", F.col("example") % 5 == 0)
    y = F.col("label").cast("double")
    logits = F.array(F.col("logit"), -F.col("logit"), F.lit(0.5))
    a = evaluation.masked_mean(s, evaluation.bce(F.col("logit"), y), F.col("pad"), "bce")
    b = evaluation.masked_mean(s, evaluation.bce(F.col("logit"), y, 3.0), F.col("pad"), "weighted_bce")
    c = evaluation.masked_mean(s, evaluation.cross_entropy(logits, (F.col("example") % 3).cast("int")), F.col("pad"), "ce")
    return a.crossJoin(b).crossJoin(c).select(*(r9(x, x) for x in ("bce", "weighted_bce", "ce")))  # one row each


def a16_psi_divergence(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("locus", F.floor(F.col("example") / 10)).withColumn("score", F.col("logit"))
    from pyspark.sql import Window as W

    s = s.withColumn("target", (F.col("label") + 1) / F.sum(F.col("label") + 1).over(W.partitionBy("locus")))
    return evaluation.psi_divergence(s).select(r9("mean_kl", "mean_kl"))


def a17_consistency(spark, sf_dir):
    s = _scored(spark, sf_dir).select(F.col("label").cast("double").alias("rule"), sigmoid(F.col("logit")).alias("learned"))
    return evaluation.consistency(s, "rule", "learned").select(r9("consistency", "consistency"))


def a18_auroc(spark, sf_dir):
    return evaluation.auroc(_scored(spark, sf_dir), "score", "label").select(r9("auroc", "auroc"))


def a19_hinge(spark, sf_dir):
    s = _scored(spark, sf_dir).select(F.floor(F.col("example") / 20).alias("locus"), F.col("logit").alias("score"), "label")
    return evaluation.hinge(s).select(r9("mean_hinge", "mean_hinge"))


def w6_first_stop(spark, sf_dir):
    from pyspark.sql import Window as W

    t = _tracks(spark, sf_dir).where("track = 'donor'")
    ahead = W.partitionBy("locus", "frame").orderBy("pos").rowsBetween(0, W.unboundedFollowing)
    rows = t.withColumn("frame", F.col("pos") % 3).withColumn("stop", F.first(F.when(F.col("logit") > 2, F.col("pos")), ignorenulls=True).over(ahead))
    return rows.select("locus", "pos", "stop")


_QUERIES = (
    p22_sigmoids, w3_softmax_psi, w4_dominant, w5_peaks, w6_first_stop, w7_near_peak, j8_candidate_exons, j9_introns, j10_source_exons, j13_examples, u5_slop_matches, u6_best_exons, u7_distinct_paths, t3_best_path,
    t4_topk_recall, g1_graph_sizes, g2_paths, g3_path_scores, g4_length_prior, g5_orf_from_tracks, g6_orf_from_sequence, g7_decode, g7_decode_with_orf, g8_locus_summary, e1_junctions, e2_chain_match, e3_junction_f1, e4_evaluate_set,
    a14_means, a15_masked_losses, a16_psi_divergence, a17_consistency, a18_auroc, a19_hinge,
)
QUERIES = {f.__name__: f for f in _QUERIES}

_T = ["fx_tracks"]
_C = CONFIG.thresholds
_PEAKS = f"""t AS (SELECT *, CASE WHEN locus % 2 = 0 THEN '+' ELSE '-' END AS strand, 1 / (1 + exp(-logit)) AS p FROM fx_tracks),
k AS (SELECT locus, strand, track, pos, p FROM t WHERE p > CASE track WHEN 'donor' THEN {_C["donor"]} WHEN 'acceptor' THEN {_C["acceptor"]} WHEN 'tss' THEN {_C["tss"]} ELSE {_C["polya"]} END
      QUALIFY track IN ('donor', 'acceptor') OR row_number() OVER (PARTITION BY locus, track ORDER BY p DESC, pos) <= {CONFIG.max_starts})"""
_EXONS = f"""{_PEAKS}, n AS (SELECT a.locus, a.strand, least(a.pos, b.pos) AS s, greatest(a.pos, b.pos) AS e, max((a.p + b.p) / 2) AS score FROM k a JOIN k b ON a.locus = b.locus AND a.track IN ('tss', 'acceptor') AND b.track IN ('donor', 'polya')
      AND CASE WHEN a.strand = '+' THEN b.pos - a.pos ELSE a.pos - b.pos END >= 1 GROUP BY 1, 2, 3, 4)"""
_EDGES = f"""{_EXONS}, i AS (SELECT u.locus, u.strand, u.s AS src_start, u.e AS src_end, d.s AS dst_start, d.e AS dst_end, (u.score + d.score) / 2 AS score, d.score AS dst_score FROM n u JOIN n d ON u.locus = d.locus
      AND CASE WHEN u.strand = '+' THEN d.s - u.e ELSE u.s - d.e END BETWEEN 1 AND {CONFIG.max_intron}
      AND EXISTS (SELECT 1 FROM k WHERE k.locus = u.locus AND track = 'donor' AND pos = CASE WHEN u.strand = '+' THEN u.e ELSE u.s END)
      AND EXISTS (SELECT 1 FROM k WHERE k.locus = u.locus AND track = 'acceptor' AND pos = CASE WHEN u.strand = '+' THEN d.s ELSE d.e END))"""
_SRC = f"{_EDGES}, o AS (SELECT n.* FROM n LEFT JOIN i ON i.locus = n.locus AND i.dst_start = n.s AND i.dst_end = n.e WHERE i.locus IS NULL)"
_PATHS = f"""{_SRC}, g AS (SELECT 1 AS level, locus, strand, [{{'start': s, 'end': e}}] AS exons, score AS total, s, e FROM o UNION ALL
      SELECT level + 1, g.locus, g.strand, list_append(exons, {{'start': dst_start, 'end': dst_end}}), total + dst_score, dst_start, dst_end FROM g JOIN i ON i.locus = g.locus AND i.src_start = g.s AND i.src_end = g.e
      QUALIFY row_number() OVER (PARTITION BY g.locus ORDER BY round(total + dst_score, 9) DESC, list_append(exons, {{'start': dst_start, 'end': dst_end}})) <= {CONFIG.beam}),
h AS (SELECT *, total / len(exons) AS score, row_number() OVER (PARTITION BY locus ORDER BY round(total / len(exons), 9) DESC, exons) AS rank FROM g QUALIFY rank <= {CONFIG.max_paths})"""
_SCORES = f"""{_PATHS}, x AS (SELECT h.locus, h.strand, h.rank, len(exons) AS n, exons[1].start AS fs, exons[1]."end" AS fe, exons[-1].start AS ls, exons[-1]."end" AS le, exons FROM h),
y AS (SELECT locus, strand, rank, unnest(range(1, n)) AS j, exons FROM x WHERE n > 1),
z AS (SELECT locus, rank, 'donor' AS track, CASE WHEN strand = '+' THEN exons[j]."end" ELSE exons[j].start END AS pos FROM y UNION ALL SELECT locus, rank, 'acceptor', CASE WHEN strand = '+' THEN exons[j + 1].start ELSE exons[j + 1]."end" END FROM y),
q AS (SELECT z.locus, rank, avg(logit) AS s_spl FROM z JOIN t ON t.locus = z.locus AND t.track = z.track AND t.pos = z.pos GROUP BY 1, 2),
f AS (SELECT x.locus, x.rank, x.n, coalesce(s_spl, 0) AS s_spl, coalesce((SELECT max(ln(p + 1e-9)) FROM t WHERE t.locus = x.locus AND track = 'tss' AND abs(pos - CASE WHEN x.strand = '+' THEN fs ELSE fe END) <= 1), 0) AS s_tss,
      coalesce((SELECT max(ln(p + 1e-9)) FROM t WHERE t.locus = x.locus AND track = 'polya' AND abs(pos - CASE WHEN x.strand = '+' THEN le ELSE ls END) <= 1), 0) AS s_pa, CASE WHEN n BETWEEN 2 AND 20 THEN 0.0 ELSE -0.5 END AS s_len FROM x LEFT JOIN q ON q.locus = x.locus AND q.rank = x.rank),
r AS (SELECT *, s_spl + 0.4 * s_tss + 0.4 * s_pa + 0.1 * s_len AS path_score FROM f),
w AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY round(path_score, 9) DESC, rank) AS iso_rank, exp(path_score) / sum(exp(path_score)) OVER (PARTITION BY locus) AS psi FROM r)"""
_E = ["fx_exons"]
_EVAL = """a AS (SELECT tx AS example, strand, list({'s': start_pos, 'e': end_pos} ORDER BY start_pos) AS x FROM fx_exons GROUP BY 1, 2),
b AS (SELECT example, strand, rank, x, (example * rank) % 4 AS d FROM a, (VALUES (1), (2), (3)) v(rank) WHERE example % 7 <> 0),
p AS (SELECT example, strand, rank, list_transform(CASE WHEN example % 5 = 0 AND len(x) > 1 THEN x[1:len(x) - 1] ELSE x END, lambda y: {'s': y.s + d, 'e': y.e + d}) AS x FROM b),
m AS (SELECT a.example, a.strand, a.x AS t, p.x AS g, coalesce(p.rank, 1) AS rank FROM a LEFT JOIN p ON p.example = a.example AND p.rank <= {k}),
c AS (SELECT *, coalesce(len(g), 0) = len(t) AND coalesce(list_bool_and(list_transform(range(1, len(t) + 1), lambda i: abs(g[i].s - t[i].s) <= {slop} AND abs(g[i].e - t[i].e) <= {slop})), false) AS hit,
      list_transform(range(1, len(t)), lambda i: CASE WHEN strand = '-' THEN (t[i + 1].e, t[i].s) ELSE (t[i].e, t[i + 1].s) END) AS tj, coalesce(list_transform(range(1, len(g)), lambda i: CASE WHEN strand = '-' THEN (g[i + 1].e, g[i].s) ELSE (g[i].e, g[i + 1].s) END), []) AS gj FROM m),
e AS (SELECT example, strand, any_value(hit::INT) FILTER (rank = 1) AS chain, any_value(tj) FILTER (rank = 1) AS tj, any_value(gj) FILTER (rank = 1) AS gj, max(hit::INT) FILTER (rank <= {k}) AS topk FROM c GROUP BY 1, 2),
u AS (SELECT example, chain::DOUBLE AS chain, coalesce(topk, 0)::DOUBLE AS topk, len(tj) AS nt, len(gj) AS ng, len(list_filter(gj, lambda y: len(list_filter(tj, lambda w: abs(w[1] - y[1]) <= {slop} AND abs(w[2] - y[2]) <= {slop})) > 0)) AS tp FROM e),
s AS (SELECT *, CASE WHEN nt = 0 AND ng = 0 THEN 1.0 WHEN nt = 0 OR ng = 0 THEN 0.0 ELSE tp / ng END AS precision, CASE WHEN nt = 0 AND ng = 0 THEN 1.0 WHEN nt = 0 OR ng = 0 THEN 0.0 ELSE tp / nt END AS recall FROM u),
z AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM s)"""


def _eval(k: int, slop: int, select: str) -> str:
    return oracle(_E, _EVAL.replace("{k}", str(k)).replace("{slop}", str(slop)) + "\n" + select)


_MEANS = "SELECT count(*) AS n, round(avg(chain), 9) AS exact_chain_acc, round(avg(precision), 9) AS junc_precision, round(avg(recall), 9) AS junc_recall, round(avg(f1), 9) AS junc_f1, round(avg(topk), 9) AS topk_recall FROM z"
_S = ["fx_scored"]
_ORF = f"""{_PATHS}, v AS (SELECT locus, pos, max(logit) FILTER (track = 'donor') AS a, max(logit) FILTER (track = 'acceptor') AS b, max(logit) FILTER (track = 'tss') AS f0, max(logit) FILTER (track = 'polya') AS f1, -max(logit) FILTER (track = 'donor') AS f2 FROM fx_tracks GROUP BY 1, 2),
x AS (SELECT locus, rank, unnest(range(1, len(exons) + 1)) AS j, exons FROM h), y AS (SELECT locus, rank, j, exons, unnest(range(exons[j].start, exons[j]."end")) AS pos FROM x),
c AS (SELECT y.locus, rank, y.pos, row_number() OVER (PARTITION BY y.locus, rank ORDER BY j, y.pos) - 1 AS tx, CASE WHEN len(exons) > 1 THEN list_sum(list_transform(exons[1:len(exons) - 1], lambda q: q."end" - q.start)) END AS junction, 1 / (1 + exp(-a)) AS sp, 1 / (1 + exp(-b)) AS tp,
      [exp(f0) / (exp(f0) + exp(f1) + exp(f2)), exp(f1) / (exp(f0) + exp(f1) + exp(f2)), exp(f2) / (exp(f0) + exp(f1) + exp(f2))] AS fr FROM y JOIN v ON v.locus = y.locus AND v.pos = y.pos),
d AS (SELECT locus, rank, tx AS s, sp AS s_p, o FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY locus, rank ORDER BY sp DESC, tx) <= 5) q, range(0, 3) r(o)),
m AS (SELECT d.locus, d.rank, s, s_p, o, tx, tp, junction, avg(fr[o + 1]) OVER (PARTITION BY d.locus, d.rank, s, o ORDER BY tx ROWS UNBOUNDED PRECEDING) AS mf FROM d JOIN c ON c.locus = d.locus AND c.rank = d.rank AND tx >= s + o AND (tx - s) % 3 = o),
w AS (SELECT locus, rank, s, o, any_value(s_p) AS s_p, min(tx) FILTER (tp > 0.5) AS hit, arg_min(tp, tx) FILTER (tp > 0.5) AS stop_p, arg_min(mf, tx) FILTER (tp > 0.5) AS mf, any_value(junction) AS junction FROM m GROUP BY 1, 2, 3, 4),
z AS (SELECT locus, rank, max(CASE WHEN hit IS NULL THEN 0.5 * s_p - 0.6 ELSE 0.5 * s_p + 0.3 * mf + 0.5 * stop_p - CASE WHEN hit < junction - 55 THEN 0.6 ELSE 0.0 END END) AS best FROM w GROUP BY 1, 2)
SELECT h.locus, h.rank, round(greatest(coalesce(best, 0.0), 0.0), 9) AS s_orf FROM h LEFT JOIN z ON z.locus = h.locus AND z.rank = h.rank"""
_WITH_ORF = f"""{_SCORES}, orfs AS (WITH {_ORF[len(_PATHS) + 2 :].replace("round(greatest(coalesce(best, 0.0), 0.0), 9)", "greatest(coalesce(best, 0.0), 0.0)")}),
summed AS (SELECT r.locus, r.rank, r.path_score + 0.8 * o.s_orf AS path_score FROM r JOIN orfs o ON o.locus = r.locus AND o.rank = r.rank)
SELECT locus, rank, CAST(row_number() OVER (PARTITION BY locus ORDER BY round(path_score, 9) DESC, rank) AS INTEGER) AS iso_rank, round(path_score, 6) AS path_score FROM summed"""

ORACLES = {
    "g7_decode_with_orf": oracle(_T, _WITH_ORF),
    "p22_sigmoids": oracle(_T, "SELECT locus, track, pos, round(1 / (1 + exp(-logit)), 9) AS sigmoid, round(ln(1 / (1 + exp(-logit)) + 1e-9), 9) AS log_sigmoid FROM fx_tracks"),
    "w5_peaks": oracle(_T, f"{_PEAKS} SELECT locus, strand, track, pos, round(p, 9) AS p FROM k"),
    "j8_candidate_exons": oracle(_T, f"{_EXONS} SELECT locus, strand, s AS start_pos, e AS end_pos, round(score, 9) AS score FROM n"),
    "u6_best_exons": oracle(_T, f"{_EXONS} SELECT locus, count(*) AS n_exons, round(max(score), 9) AS best FROM n GROUP BY 1"),
    "j9_introns": oracle(_T, f"{_EDGES} SELECT locus, strand, src_start, src_end, dst_start, dst_end, round(score, 9) AS score FROM i"),
    "g1_graph_sizes": oracle(_T, f"{_EDGES} SELECT locus, count(*) AS n_nodes, coalesce((SELECT count(*) FROM i WHERE i.locus = n.locus), 0) AS n_edges FROM n GROUP BY 1"),
    "j10_source_exons": oracle(_T, f"{_SRC} SELECT locus, s AS start_pos, e AS end_pos FROM o"),
    "g2_paths": oracle(_T, f"{_PATHS} SELECT locus, CAST(rank AS INTEGER) AS rank, CAST(len(exons) AS INTEGER) AS n_exons, array_to_string(list_transform(exons, lambda x: x.start || '-' || x.\"end\"), ',') AS path, round(score, 9) AS score FROM h"),
    "t3_best_path": oracle(_T, f"{_PATHS} SELECT locus, round(score, 9) AS score FROM h WHERE rank = 1"),
    "u7_distinct_paths": oracle(_T, f"{_PATHS} SELECT locus, count(DISTINCT exons) AS n_paths, CAST(max(rank) AS INTEGER) AS last_rank FROM h GROUP BY 1"),
    "w6_first_stop": oracle(_T, "SELECT a.locus, a.pos, (SELECT min(b.pos) FROM fx_tracks b WHERE b.track = 'donor' AND b.locus = a.locus AND b.pos >= a.pos AND b.pos % 3 = a.pos % 3 AND b.logit > 2) AS stop FROM fx_tracks a WHERE a.track = 'donor'"),
    "w7_near_peak": oracle(_T, "t AS (SELECT locus, pos, ln(1 / (1 + exp(-logit)) + 1e-9) AS x FROM fx_tracks WHERE track = 'tss') SELECT locus, pos, round(max(x) OVER (PARTITION BY locus ORDER BY pos RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS best FROM t"),
    "g3_path_scores": oracle(_T, f"{_SCORES} SELECT locus, CAST(rank AS INTEGER) AS rank, round(s_spl, 9) AS s_spl, round(s_tss, 9) AS s_tss, round(s_pa, 9) AS s_pa, CAST(s_len AS DOUBLE) AS s_len, round(path_score, 9) AS path_score FROM w"),
    "g4_length_prior": oracle(_T, f"{_PATHS} SELECT locus, CAST(rank AS INTEGER) AS rank, CAST(CASE WHEN len(exons) BETWEEN 2 AND 20 THEN 0.0 ELSE -0.5 END AS DOUBLE) AS prior FROM h"),
    "g5_orf_from_tracks": oracle(_T, _ORF.replace("SELECT h.locus, h.rank,", "SELECT h.locus, CAST(h.rank AS INTEGER) AS rank,")),
    "g6_orf_from_sequence": oracle(
        ["fx_contigs"],
        """c AS (SELECT chrom, seq, length, CASE WHEN contig_no % 2 = 0 THEN CAST(floor(length * 0.7) AS BIGINT) END AS lj, unnest(range(0, greatest(length - 2, 0))) AS i FROM fx_contigs),
m AS (SELECT *, substr(seq, i + 1, 3) AS codon FROM c WHERE substr(seq, i + 1, 3) IN ('ATG', 'TAA', 'TAG', 'TGA')),
s AS (SELECT *, min(CASE WHEN codon <> 'ATG' THEN i END) OVER (PARTITION BY chrom, i % 3 ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS j FROM m),
v AS (SELECT chrom, max(0.5 + CASE WHEN (j - i) // 3 BETWEEN 5 AND 60 THEN 0.3 ELSE 0.0 END + CASE WHEN i >= 3 AND i + 4 < length AND substr(seq, i - 2, 1) IN ('A', 'G') AND substr(seq, i + 4, 1) = 'G' THEN 0.2 ELSE 0.0 END - CASE WHEN j < lj - 55 THEN 0.6 ELSE 0.0 END) AS best FROM s WHERE codon = 'ATG' AND j IS NOT NULL GROUP BY 1)
SELECT f.chrom, CAST(round(greatest(coalesce(best, 0.0), 0.0), 9) AS DOUBLE) AS s_orf FROM fx_contigs f LEFT JOIN v ON v.chrom = f.chrom""",
    ),
    "g7_decode": oracle(_T, f"{_SCORES} SELECT locus, CAST(rank AS INTEGER) AS rank, CAST(iso_rank AS INTEGER) AS iso_rank, round(path_score, 9) AS path_score FROM w"),
    "w3_softmax_psi": oracle(_T, f"{_SCORES} SELECT locus, CAST(rank AS INTEGER) AS rank, round(psi, 9) AS psi FROM w"),
    "w4_dominant": oracle(_T, f"{_SCORES} SELECT locus, CAST(rank AS INTEGER) AS rank, round(path_score, 9) AS path_score FROM w WHERE iso_rank = 1"),
    "g8_locus_summary": oracle(
        _T,
        f"""{_SCORES}, c AS (SELECT locus, count(*) AS n FROM w GROUP BY 1), b AS (SELECT w.locus, w.rank, w.psi, x.n, x.exons FROM w JOIN x ON x.locus = w.locus AND x.rank = w.rank WHERE iso_rank = 1),
m AS (SELECT *, exons[1]."end" - exons[1].start AS len0, list_sum(list_transform(exons[1:len(exons) - 1], lambda q: q."end" - q.start)) AS junction FROM b), l AS (SELECT DISTINCT locus FROM t)
SELECT l.locus, coalesce(c.n, 0) AS n_isoforms, CAST(m.rank AS INTEGER) AS dominant_rank, CAST(m.n AS INTEGER) AS dominant_exons, round(psi, 9) AS psi, CASE WHEN m.n > 1 AND len0 >= 3 AND junction - len0 + 3 > 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_nmd
FROM l LEFT JOIN c ON c.locus = l.locus LEFT JOIN m ON m.locus = l.locus""",
    ),
    "e1_junctions": oracle(_E, "j AS (SELECT tx AS example, strand, start_pos, end_pos, lead(start_pos) OVER w AS ns, lead(end_pos) OVER w AS ne FROM fx_exons WINDOW w AS (PARTITION BY tx ORDER BY CASE WHEN strand = '-' THEN -start_pos ELSE start_pos END)) SELECT DISTINCT example, end_pos AS donor, ns AS acceptor FROM j WHERE ns IS NOT NULL"),
    "e2_chain_match": _eval(3, 1, "SELECT example, chain FROM z"),
    "e3_junction_f1": _eval(3, 0, "SELECT example, CAST(round(precision, 9) AS DOUBLE) AS precision, CAST(round(recall, 9) AS DOUBLE) AS recall, CAST(round(f1, 9) AS DOUBLE) AS f1 FROM z"),
    "u5_slop_matches": _eval(3, 2, "SELECT example, CAST(round(precision, 9) AS DOUBLE) AS precision, CAST(round(recall, 9) AS DOUBLE) AS recall FROM z"),
    "t4_topk_recall": _eval(2, 0, "SELECT example, topk FROM z"),
    "j13_examples": oracle(_E, "a AS (SELECT DISTINCT tx FROM fx_exons) SELECT tx % 11 <> 3 AS has_truth, tx % 7 <> 0 AS has_pred, count(*) AS n, CAST(sum(tx) AS BIGINT) AS examples FROM a WHERE tx % 11 <> 3 OR tx % 7 <> 0 GROUP BY 1, 2"),
    "e4_evaluate_set": _eval(3, 1, _MEANS),
    "a14_means": _eval(2, 0, _MEANS),
    "a15_masked_losses": oracle(
        _S,
        """k AS (SELECT *, label::DOUBLE AS y, [logit, -logit, 0.5] AS l FROM fx_scored WHERE example % 5 <> 0)
SELECT round(avg(greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit)))), 9) AS bce, round(avg((1 - y) * logit + (1 + 2 * y) * (ln(1 + exp(-abs(logit))) + greatest(-logit, 0))), 9) AS weighted_bce, round(avg(ln(exp(logit) + exp(-logit) + exp(0.5)) - l[example % 3 + 1]), 9) AS ce FROM k""",
    ),
    "a16_psi_divergence": oracle(
        _S,
        "a AS (SELECT floor(example / 10) AS locus, logit, (label + 1) / sum(label + 1) OVER (PARTITION BY floor(example / 10)) AS p, logit - ln(sum(exp(logit)) OVER (PARTITION BY floor(example / 10))) AS q FROM fx_scored), b AS (SELECT sum(p * (ln(p + 1e-8) - q)) AS kl FROM a GROUP BY locus) SELECT round(avg(kl), 9) AS mean_kl FROM b",
    ),
    "a17_consistency": oracle(
        _S,
        "a AS (SELECT least(greatest(label::DOUBLE, 1e-6), 1 - 1e-6) AS a, least(greatest(1 / (1 + exp(-logit)), 1e-6), 1 - 1e-6) AS b FROM fx_scored) SELECT round(avg((-(a * ln(b) + (1 - a) * ln(1 - b)) - (b * ln(a) + (1 - b) * ln(1 - a))) / 2), 9) AS consistency FROM a",
    ),
    "a18_auroc": oracle(_S, "r AS (SELECT label, avg(n) OVER (PARTITION BY score) AS rk FROM (SELECT label, score, row_number() OVER (ORDER BY score) AS n FROM fx_scored) q) SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 9) AS auroc FROM r"),
    "a19_hinge": oracle(_S, "s AS (SELECT floor(example / 20) AS locus, logit, label FROM fx_scored) SELECT round(avg(greatest(0, 1 - (a.logit - b.logit))), 9) AS mean_hinge FROM s a JOIN s b ON a.locus = b.locus AND a.label = 1 AND b.label = 0"),
}
