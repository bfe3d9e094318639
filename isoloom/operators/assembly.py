"""Splice graphs and isoforms of many loci at once.

Score tracks are rows (locus, strand, track, pos, logit).  A graph is two tables, nodes (exons) and edges, keyed by
locus and strand.  The beam search of a locus runs in one task, loci side by side; loci with too many edges for that grow
level by level on the cluster instead, each level written out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.functions.arrays import exon_length, log_sigmoid, sigmoid
from isoloom.functions.sequence import STOPS, spliced_cdna
from isoloom.sources.scratch import scratch_path, written

#: Introns of a locus that is searched in one task.
TASK_EDGES = 100_000
_LOCUS = ["locus", "strand"]
_PLACES = Decimal("1e-9")


@dataclass(frozen=True)
class Config:
    """Thresholds, caps and weights."""

    thresholds: dict[str, float] = field(default_factory=lambda: {"donor": 0.6, "acceptor": 0.6, "tss": 0.5, "polya": 0.5})
    max_starts: int = 8
    max_ends: int = 8
    min_exon: int = 1
    max_intron: int = 500_000
    unanchored: bool = True
    beam: int = 16
    max_paths: int = 32
    near_end: int = 1
    w_spl: float = 1.0
    w_tss: float = 0.4
    w_pa: float = 0.4
    w_orf: float = 0.8
    w_len: float = 0.1


def peaks(tracks: DataFrame, config: Config = Config()) -> DataFrame:
    """(locus, strand, track, pos, p): sites whose probability exceeds their track's threshold; of starts and ends only the
    best few (ties: the smaller position)."""
    limit = F.lit(None).cast("double")
    for track, t in config.thresholds.items():
        limit = F.when(F.col("track") == track, F.lit(t)).otherwise(limit)
    found = tracks.withColumn("p", sigmoid(F.col("logit"))).where(F.col("p") > limit)
    most = F.when(F.col("track") == "tss", config.max_starts).when(F.col("track") == "polya", config.max_ends)
    rank = F.row_number().over(W.partitionBy(*_LOCUS, "track").orderBy(F.desc("p"), "pos"))
    return found.withColumn("__r", rank).where(most.isNull() | (F.col("__r") <= most)).select(*_LOCUS, "track", "pos", "p")


def exons(found: DataFrame, config: Config = Config()) -> DataFrame:
    """Candidate exons (start, end, score, site flags): every start with every end beyond it on the strand; of equal exons
    the best score.  ``left_site`` and ``right_site`` tell which ends are splice sites rather than transcript ends."""
    starts, ends = ["tss", "acceptor"], ["donor", "polya"]
    s = found.where(F.col("track").isin(*starts)).select(*_LOCUS, F.col("track").alias("from_track"), F.col("pos").alias("s"), F.col("p").alias("sp"))
    e = found.where(F.col("track").isin(*ends)).select(*_LOCUS, F.col("track").alias("to_track"), F.col("pos").alias("e"), F.col("p").alias("ep"))
    plus = F.col("strand") == "+"
    pairs = s.join(e.hint("merge"), _LOCUS).where(F.when(plus, F.col("e") - F.col("s")).otherwise(F.col("s") - F.col("e")) >= max(1, config.min_exon))
    if not config.unanchored:
        pairs = pairs.where(~((F.col("from_track") == "acceptor") & (F.col("to_track") == "donor")))
    pairs = pairs.select(*_LOCUS, F.least("s", "e").alias("start"), F.greatest("s", "e").alias("end"), ((F.col("sp") + F.col("ep")) / 2).alias("score"))
    return pairs.groupBy(*_LOCUS, "start", "end").agg(F.max("score").alias("score"))


def edges(nodes: DataFrame, found: DataFrame, config: Config = Config()) -> DataFrame:
    """Introns between exons: the upstream one ends at a donor peak, the downstream one begins at an acceptor peak."""
    plus = F.col("strand") == "+"
    out_end, in_end = F.when(plus, F.col("end")).otherwise(F.col("start")), F.when(plus, F.col("start")).otherwise(F.col("end"))
    sites = lambda t, name: found.where(F.col("track") == t).select(*_LOCUS, F.col("pos").alias(name))
    # on the way of transcription an intron leads from u to v, 0 < v - u <= max_intron: v is in the bin of u or the next
    sign, width = F.when(plus, 1).otherwise(-1), config.max_intron
    up = nodes.withColumn("gap_from", out_end).join(sites("donor", "gap_from").hint("merge"), [*_LOCUS, "gap_from"], "left_semi").select(*_LOCUS, F.col("start").alias("src_start"), F.col("end").alias("src_end"), F.col("score").alias("src_score"), "gap_from")
    down = nodes.withColumn("gap_to", in_end).join(sites("acceptor", "gap_to").hint("merge"), [*_LOCUS, "gap_to"], "left_semi").select(*_LOCUS, F.col("start").alias("dst_start"), F.col("end").alias("dst_end"), F.col("score").alias("dst_score"), "gap_to")
    gap = F.when(plus, F.col("gap_to") - F.col("gap_from")).otherwise(F.col("gap_from") - F.col("gap_to"))
    bin_of = lambda c: F.floor(sign * F.col(c) / width).cast("long")
    up = up.withColumn("bin", F.explode(F.array(bin_of("gap_from"), bin_of("gap_from") + 1)))
    joined = up.join(down.withColumn("bin", bin_of("gap_to")).hint("merge"), [*_LOCUS, "bin"]).where((gap > 0) & (gap <= config.max_intron))
    return joined.select(*_LOCUS, "src_start", "src_end", "dst_start", "dst_end", "src_score", "dst_score", ((F.col("src_score") + F.col("dst_score")) / 2).alias("score"))


def sources(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Exons that no intron leads to."""
    return nodes.join(links.select(*_LOCUS, F.col("dst_start").alias("start"), F.col("dst_end").alias("end")).distinct().hint("merge"), [*_LOCUS, "start", "end"], "left_anti")


def paths(nodes: DataFrame, links: DataFrame, config: Config = Config(), task_edges: int = TASK_EDGES) -> DataFrame:
    """(locus, strand, exons, total, score, rank): beam search from the sources until no path grows; every prefix is a path,
    ranked by mean node score, ties by the path.  Scores are compared rounded to 9 places.

    A locus of up to ``task_edges`` introns is searched in one task, whatever its depth; larger ones level by level."""
    large = written(links.groupBy(*_LOCUS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_edges).select(*_LOCUS), "large-loci")
    if large.isEmpty():
        return _paths_in_tasks(nodes, links, config)
    some = lambda df, how: df.join(large.hint("merge"), _LOCUS, how)
    small = _paths_in_tasks(some(nodes, "left_anti"), some(links, "left_anti"), config)
    return small.unionByName(paths_by_level(written(some(nodes, "left_semi"), "exons"), written(some(links, "left_semi"), "introns"), config))


def _paths_in_tasks(nodes: DataFrame, links: DataFrame, config: Config) -> DataFrame:
    kind = nodes.schema["locus"].dataType.simpleString()
    exon = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def searched(exons: pa.Table, introns: pa.Table) -> pa.Table:
        rows = lambda t, *names: list(zip(*(t.column(c).to_pylist() for c in names), strict=True))
        found = beam(rows(exons, "start", "end", "score"), rows(introns, "src_start", "src_end", "dst_start", "dst_end", "dst_score"), config.beam, config.max_paths)
        of = exons if exons.num_rows else introns
        same = lambda c: pa.array([of.column(c)[0].as_py()] * len(found) if found else [], of.schema.field(c).type)
        path = pa.array([[dict(zip(("start", "end", "score"), e, strict=True)) for e in p] for _, p, _ in found], pa.list_(exon))
        total = [t for _, _, t in found]
        return pa.table({"locus": same("locus"), "strand": same("strand"), "exons": path, "total": pa.array(total, pa.float64()), "score": pa.array([t / len(p) for _, p, t in found], pa.float64()), "rank": pa.array(range(1, len(found) + 1), pa.int32())})

    n = nodes.select(*_LOCUS, F.col("start").cast("long"), F.col("end").cast("long"), F.col("score").cast("double")).groupBy(*_LOCUS)
    e = links.select(*_LOCUS, *(F.col(c).cast("long") for c in ("src_start", "src_end", "dst_start", "dst_end")), F.col("dst_score").cast("double")).groupBy(*_LOCUS)
    return n.cogroup(e).applyInArrow(searched, f"locus {kind}, strand string, exons array<struct<start:bigint,end:bigint,score:double>>, total double, score double, rank int")


def beam(exons: list[tuple], introns: list[tuple], width: int, most: int) -> list[tuple[Decimal, tuple, float]]:
    """(-score, path, total) of the ``most`` best paths of one locus, best first.  Only the beam and these are held."""
    after: dict[tuple, dict[tuple, None]] = {}
    reached = set()
    for a, b, c, d, x in introns:
        after.setdefault((a, b), {})[(c, d, x)] = None
        reached.add((c, d))
    level = {(e,): e[2] for e in exons if e[:2] not in reached}
    best: list[tuple[Decimal, tuple, float]] = []
    while level:
        best = sorted([*best, *((-_rounded(t / len(p)), p, t) for p, t in level.items())])[:most]
        grown = [((*p, e), t + e[2]) for p, t in level.items() for e in after.get(p[-1][:2], ())]
        level = dict(sorted(grown, key=lambda x: (-_rounded(x[1]), x[0]))[:width])
    return best


def _rounded(x: float) -> Decimal:
    """What Spark's round makes of a double at 9 places."""
    return Decimal(repr(x)).quantize(_PLACES, ROUND_HALF_UP)


def paths_by_level(nodes: DataFrame, links: DataFrame, config: Config = Config()) -> DataFrame:
    """What :func:`paths` returns, a join a level."""
    exon = lambda s, e, x: F.struct(F.col(s).alias("start"), F.col(e).alias("end"), F.col(x).alias("score"))
    level = sources(nodes, links).select(*_LOCUS, F.array(exon("start", "end", "score")).alias("exons"), F.col("score").alias("total"), F.col("start").alias("src_start"), F.col("end").alias("src_end"))
    steps = links.select(*_LOCUS, "src_start", "src_end", exon("dst_start", "dst_end", "dst_score").alias("next"))
    spark, base, n = nodes.sparkSession, scratch_path(nodes.sparkSession, "beam"), 0

    def kept(df: DataFrame) -> DataFrame:
        df.write.parquet(f"{base}/{n}")
        return spark.read.schema(df.schema).parquet(f"{base}/{n}")

    level = kept(level)
    best = F.row_number().over(W.partitionBy(*_LOCUS).orderBy(F.desc(F.round("total", 9)), "exons"))
    while not level.isEmpty():
        n += 1
        grown = level.join(steps.hint("merge"), [*_LOCUS, "src_start", "src_end"])
        grown = grown.select(*_LOCUS, F.concat("exons", F.array("next")).alias("exons"), (F.col("total") + F.col("next.score")).alias("total"), F.col("next.start").alias("src_start"), F.col("next.end").alias("src_end"))
        level = kept(grown.withColumn("__r", best).where(F.col("__r") <= config.beam).drop("__r"))
    out = spark.read.schema(level.schema).parquet(*(f"{base}/{k}" for k in range(n + 1)))
    out = out.groupBy(*_LOCUS, "exons").agg(F.max("total").alias("total")).withColumn("score", F.col("total") / F.size("exons"))
    rank = F.row_number().over(W.partitionBy(*_LOCUS).orderBy(F.desc(F.round("score", 9)), "exons"))
    return out.withColumn("rank", rank).where(F.col("rank") <= config.max_paths)


def length_prior(exon_list: Column) -> Column:
    return F.when(F.size(exon_list).between(2, 20), F.lit(0.0)).otherwise(F.lit(-0.5))


def near_peak(tracks: DataFrame, track: str, width: int) -> DataFrame:
    """(locus, strand, pos, best): the largest log-probability of a track within ``width`` bases."""
    near = W.partitionBy(*_LOCUS).orderBy("pos").rangeBetween(-width, width)
    return tracks.where(F.col("track") == track).select(*_LOCUS, "pos", F.max(log_sigmoid(F.col("logit"))).over(near).alias("best"))


def path_scores(isoforms: DataFrame, tracks: DataFrame, orf: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """``isoforms`` (locus, strand, rank, exons) with splice, start, end, ORF and length terms and their weighted sum.

    The splice term averages donor and acceptor logits at the introns' ends; one exon has none.  ``orf`` has one score a
    path (locus, strand, rank, s_orf); without it the term is 0, as the start or end term is for a locus without that
    track."""
    key = [*_LOCUS, "rank"]
    plus = F.col("strand") == "+"
    pairs = F.transform(F.sequence(F.lit(0), F.size("exons") - 2), lambda i: F.struct(F.get("exons", i).alias("a"), F.get("exons", i + 1).alias("b")))
    many = isoforms.where(F.size("exons") > 1).select(*key, F.explode(pairs).alias("x"))
    used = many.select(*key, F.explode(F.array(F.struct(F.lit("donor").alias("track"), F.when(plus, F.col("x.a.end")).otherwise(F.col("x.a.start")).alias("pos")), F.struct(F.lit("acceptor").alias("track"), F.when(plus, F.col("x.b.start")).otherwise(F.col("x.b.end")).alias("pos")))).alias("u")).select(*key, "u.track", "u.pos")
    splice = used.join(tracks.select(*_LOCUS, "track", "pos", "logit").hint("merge"), [*_LOCUS, "track", "pos"]).groupBy(*key).agg(F.avg("logit").alias("s_spl"))
    first, last = F.get("exons", 0), F.element_at("exons", -1)
    out = isoforms.withColumn("five", F.when(plus, first["start"]).otherwise(first["end"])).withColumn("three", F.when(plus, last["end"]).otherwise(last["start"])).join(splice.hint("merge"), key, "left")
    for at, track, name in (("five", "tss", "s_tss"), ("three", "polya", "s_pa")):
        out = out.join(near_peak(tracks, track, config.near_end).select(*_LOCUS, F.col("pos").alias(at), F.col("best").alias(name)).hint("merge"), [*_LOCUS, at], "left")
    out = out.join(orf.hint("merge"), key, "left") if orf is not None else out.withColumn("s_orf", F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumn("s_len", length_prior(F.col("exons")))
    total = config.w_spl * zero("s_spl") + config.w_tss * zero("s_tss") + config.w_pa * zero("s_pa") + config.w_orf * zero("s_orf") + config.w_len * F.col("s_len")
    return out.drop("five", "three").withColumns({"s_spl": zero("s_spl"), "s_tss": zero("s_tss"), "s_pa": zero("s_pa"), "s_orf": zero("s_orf"), "path_score": total})


def orf_from_sequence(transcripts: DataFrame, key: list[str], min_aa: int = 50, max_aa: int = 10_000, gamma: float = 0.6, kozak: float = 0.2) -> DataFrame:
    """``key`` and s_orf of (key..., cdna, last_junction or null): over every ATG to its first in-frame stop 0.5, +0.3 for a
    length within bounds, + ``kozak`` for a strong context, - ``gamma`` for a stop over 55 bases before the last junction;
    the best, at least 0.  A row's codons are scanned where the row is: nothing is shuffled."""

    def scanned(batches):
        for b in batches:
            rows = zip(b.column("cdna").to_pylist(), b.column("last_junction").to_pylist(), strict=True)
            best = [_best_orf(cdna or "", last, min_aa, max_aa, gamma, kozak) for cdna, last in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in key), pa.array(best, pa.float64())], [*key, "s_orf"])

    schema = transcripts.select(*key).schema.add("s_orf", "double")
    return transcripts.select(*key, "cdna", "last_junction").mapInArrow(scanned, schema)


def _best_orf(cdna: str, last_junction: int | None, min_aa: int, max_aa: int, gamma: float, kozak: float) -> float:
    x = np.frombuffer(cdna.encode("ascii", "replace"), np.uint8)
    if len(x) < 3:
        return 0.0
    is_codon = lambda c: (x[:-2] == ord(c[0])) & (x[1:-1] == ord(c[1])) & (x[2:] == ord(c[2]))
    starts, stops = np.flatnonzero(is_codon("ATG")), np.flatnonzero(np.any([is_codon(c) for c in STOPS], axis=0))
    best = 0.0
    for frame in range(3):
        at, ends = starts[starts % 3 == frame], stops[stops % 3 == frame]
        k = np.searchsorted(ends, at)
        at, stop = at[k < len(ends)], ends[k[k < len(ends)]]
        if not len(at):
            continue
        aa = (stop - at) // 3
        near = (at >= 3) & (at + 4 < len(x))
        strong = near & np.isin(x[np.maximum(at - 3, 0)], (ord("A"), ord("G"))) & (x[np.minimum(at + 3, len(x) - 1)] == ord("G"))
        early = np.zeros(len(at), bool) if last_junction is None else stop < last_junction - 55
        value = 0.5 + np.where((aa >= min_aa) & (aa <= max_aa), 0.3, 0.0) + np.where(strong, kozak, 0.0) - np.where(early, gamma, 0.0)
        best = max(best, float(value.max()))
    return best


def orf_from_tracks(isoforms: DataFrame, tracks: DataFrame, top: int = 5, alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.6) -> DataFrame:
    """(locus, strand, rank, s_orf) from tracks orf_start, orf_stop and orf_frame0 to orf_frame2.

    Of an isoform's bases the ``top`` most likely starts are tried in three frames: alpha * start + beta * mean frame
    probability + alpha * stop at the first likely stop, less gamma if that lies over 55 bases before the last junction;
    without a stop alpha * start - gamma; the best, at least 0.  Bases run up in each exon, exons in transcription order."""
    key = [*_LOCUS, "rank"]
    wide = tracks.where(F.col("track").startswith("orf_")).groupBy(*_LOCUS, "pos").pivot("track", ["orf_start", "orf_stop", "orf_frame0", "orf_frame1", "orf_frame2"]).agg(F.first("logit"))
    parts = sum((F.exp(f"orf_frame{k}") for k in range(3)), F.lit(0.0))
    wide = wide.select(*_LOCUS, "pos", sigmoid(F.col("orf_start")).alias("start_p"), sigmoid(F.col("orf_stop")).alias("stop_p"), F.array(*(F.exp(f"orf_frame{k}") / parts for k in range(3))).alias("frames"))
    bases = F.flatten(F.transform("exons", lambda e: F.sequence(e["start"], e["end"] - 1)))
    last = F.element_at("exons", -1)
    junction = F.when(F.size("exons") > 1, exon_length(F.col("exons")) - (last["end"] - last["start"]))
    placed = isoforms.select(*key, junction.alias("junction"), F.posexplode(bases).alias("tx", "pos")).join(wide.hint("merge"), [*_LOCUS, "pos"])
    order = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("start_p"), "tx"))
    starts = placed.withColumn("__r", order).where(F.col("__r") <= top).select(*key, F.col("tx").alias("s"), F.col("start_p").alias("s_p"))
    tries = starts.withColumn("offset", F.explode(F.array(*map(F.lit, range(3)))))
    read = tries.join(placed.select(*key, "tx", "junction", "stop_p", "frames").hint("merge"), key).where((F.col("tx") >= F.col("s") + F.col("offset")) & ((F.col("tx") - F.col("s")) % 3 == F.col("offset")))
    read = read.withColumn("frame_p", F.get("frames", F.col("offset")))
    along = W.partitionBy(*key, "s", "offset").orderBy("tx").rowsBetween(W.unboundedPreceding, W.currentRow)
    read = read.withColumn("mean_frame", F.avg("frame_p").over(along)).withColumn("hit", F.col("stop_p") > 0.5)
    first = F.min_by(F.struct("tx", "stop_p", "mean_frame", "junction"), F.when(F.col("hit"), F.col("tx")))
    one = read.groupBy(*key, "s", "s_p", "offset").agg(first.alias("x"))
    early = F.coalesce(F.col("x.tx") < F.col("x.junction") - 55, F.lit(False))
    value = F.when(F.col("x").isNotNull(), alpha * F.col("s_p") + beta * F.col("x.mean_frame") + alpha * F.col("x.stop_p") - F.when(early, gamma).otherwise(0.0)).otherwise(alpha * F.col("s_p") - gamma)
    best = one.groupBy(*key).agg(F.max(value).alias("best"))
    return isoforms.select(*key).join(best.hint("merge"), key, "left").select(*key, F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)).alias("s_orf"))


def decode(tracks: DataFrame, config: Config = Config(), sequences: DataFrame | None = None, orf_tracks: bool = False) -> DataFrame:
    """Isoforms of every locus by path score: peaks, exons, introns, paths, scores.

    The ORF term comes from ``sequences`` (locus, seq, position 0 the track's first base) where given, else from the ORF
    tracks with ``orf_tracks``, else it is 0."""
    found = written(peaks(tracks, config), "peaks")
    nodes = written(exons(found, config), "exons")
    links = written(edges(nodes, found, config), "introns")
    ranked = written(paths(nodes, links, config), "paths")
    orf = None
    if sequences is not None:
        last = F.element_at("exons", -1)
        junction = F.when(F.size("exons") > 1, exon_length(F.col("exons")) - (last["end"] - last["start"]))
        spliced = ranked.join(sequences.select("locus", "seq").hint("merge"), "locus").select(*_LOCUS, "rank", spliced_cdna(F.col("exons"), F.col("seq"), F.col("strand")).alias("cdna"), junction.alias("last_junction"))
        orf = orf_from_sequence(spliced, [*_LOCUS, "rank"])
    elif orf_tracks:
        orf = orf_from_tracks(ranked, tracks)
    scored = path_scores(ranked, tracks, orf, config)
    order = W.partitionBy(*_LOCUS).orderBy(F.desc(F.round("path_score", 9)), "rank")
    return scored.withColumn("iso_rank", F.row_number().over(order))


def with_psi(isoforms: DataFrame, score: str = "path_score") -> DataFrame:
    """``psi``: softmax of the scores of each locus, shifted by the largest."""
    locus = W.partitionBy(*_LOCUS)
    out = isoforms.withColumn("__e", F.exp(F.col(score) - F.max(score).over(locus)))
    return out.withColumn("psi", F.col("__e") / F.sum("__e").over(locus)).drop("__e")


def dominant(isoforms: DataFrame, score: str = "path_score") -> DataFrame:
    """The isoform of each locus with the largest score, the first on ties."""
    n = F.row_number().over(W.partitionBy(*_LOCUS).orderBy(F.desc(F.round(score, 9)), "rank"))
    return isoforms.withColumn("__n", n).where(F.col("__n") == 1).drop("__n")


def summary(loci: DataFrame, isoforms: DataFrame, p_nmd: DataFrame | None = None, score: str = "path_score") -> DataFrame:
    """Per locus: isoforms, the dominant one's rank, exons and psi, and its decay probability; loci without isoforms stay, with 0."""
    best = dominant(with_psi(isoforms, score), score).select(*_LOCUS, F.col("rank").alias("dominant_rank"), F.size("exons").alias("dominant_exons"), "psi")
    n = isoforms.groupBy(*_LOCUS).agg(F.count(F.lit(1)).alias("n_isoforms"))
    out = loci.join(n.hint("merge"), _LOCUS, "left").join(best.hint("merge"), _LOCUS, "left").withColumn("n_isoforms", F.coalesce("n_isoforms", F.lit(0)))
    if p_nmd is not None:
        out = out.join(p_nmd.select(*_LOCUS, F.col("rank").alias("dominant_rank"), "p").hint("merge"), [*_LOCUS, "dominant_rank"], "left").withColumn("p_nmd", F.coalesce("p", F.lit(0.0))).drop("p")
    return out
