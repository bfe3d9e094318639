"""Nonsense-mediated decay: transcript coordinates, distance from stop to last junction, rules, features, scores.

The stop is the last three coding bases in transcription order on either strand; ``legacy`` uses the formulas that mix
up the minus strand instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.functions.arrays import exon_length, sigmoid

THRESHOLD = 55


def with_offsets(exons: DataFrame) -> DataFrame:
    """Exons with their offset in the transcript, and the transcript's exon count, length and last junction."""
    order = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    before = W.partitionBy("tx").orderBy(order, "end").rowsBetween(W.unboundedPreceding, -1)
    length = F.col("end") - F.col("start")
    out = exons.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))
    whole = W.partitionBy("tx")
    return out.withColumn("n_exons", F.count(F.lit(1)).over(whole)).withColumn("tx_length", F.sum(length).over(whole)).withColumn("last_junction_tx", F.max("offset").over(whole))


def _offset_of(p: Column) -> Column:
    """The transcript coordinate of a position in this exon."""
    return F.col("offset") + F.when(F.col("strand") == "-", F.col("end") - 1 - p).otherwise(p - F.col("start"))


def to_transcript(points: DataFrame, offsets: DataFrame, point: str, name: str) -> DataFrame:
    """``points`` (tx, ..., point) with the transcript coordinate of a genomic position; rows outside all exons go."""
    e = offsets.select("tx", F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("offset").alias("__o"), F.col("strand").alias("__strand"))
    p = F.col(point)
    at = F.col("__o") + F.when(F.col("__strand") == "-", F.col("__e") - 1 - p).otherwise(p - F.col("__s"))
    return points.join(e, "tx").where((p >= F.col("__s")) & (p < F.col("__e"))).withColumn(name, at).drop("__s", "__e", "__o", "__strand")


def labels(exons: DataFrame, cds: DataFrame, threshold: int = THRESHOLD, legacy: bool = False) -> DataFrame:
    """Annotation labels of coding transcripts with two exons or more: 1 if the stop lies more than ``threshold`` bases
    before the last junction.

    A transcript's exons meet its coding ends once: the places of both ends are found in the group of its exons."""
    offsets = with_offsets(exons).where(F.col("n_exons") > 1)
    plus = F.col("strand") == "+"
    ends = cds.groupBy("tx", "strand").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.max("start").alias("top_start"), F.min("end").alias("low_end"))
    first = F.when(plus, F.col("lo")).otherwise(F.col("top_start") if legacy else F.col("hi") - 1)
    last = F.when(plus, F.col("hi") - 1).otherwise(F.col("low_end") - 1 if legacy else F.col("lo"))
    ends = ends.select("tx", F.col("strand").alias("__of"), first.alias("first"), last.alias("last"))
    met = offsets.join(ends.hint("merge"), "tx")
    meta = F.struct("gene_id", "chrom", "strand", "n_exons", "last_junction_tx")
    held = [F.collect_list(F.when((F.col(c) >= F.col("start")) & (F.col(c) < F.col("end")), _offset_of(F.col(c)))).alias(name) for c, name in (("first", "cds_tx_start"), ("last", "cds_tx_end"))]
    placed = met.groupBy("tx", "__of", "first", "last").agg(*held, F.collect_set(meta).alias("meta"))
    for c in ("cds_tx_start", "cds_tx_end", "meta"):
        placed = placed.withColumn(c, F.explode(c))
    stop = F.col("cds_tx_end") - 2
    if legacy:
        stop = F.when(plus, stop).otherwise(F.col("cds_tx_start"))
    out = placed.select("tx", "meta.*", "cds_tx_start", "cds_tx_end").withColumn("distance", F.col("last_junction_tx") - stop)
    return out.select("tx", "gene_id", "chrom", "strand", "n_exons", "cds_tx_start", "cds_tx_end", "last_junction_tx", "distance", (F.col("distance") > threshold).cast("int").alias("nmd_label"))


def transcript_position(exons: Column, strand: Column, pos: Column) -> Column:
    """Transcript coordinate of a position in an isoform's exons (in transcription order); null outside them."""
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("at"))

    def step(a: Column, e: Column) -> Column:
        inside = (pos >= e["start"]) & (pos < e["end"])
        here = a["before"] + F.when(strand == "-", e["end"] - 1 - pos).otherwise(pos - e["start"])
        return F.struct((a["before"] + e["end"] - e["start"]).alias("before"), F.coalesce(a["at"], F.when(inside, here)).alias("at"))

    return F.aggregate(exons, start, step)["at"]


def last_junction(exons: Column) -> Column:
    last = F.element_at(exons, -1)
    return F.when(F.size(exons) > 1, exon_length(exons) - (last["end"] - last["start"]))


def stop_start(cds: Column, strand: Column, inclusive: bool = False, legacy: bool = False) -> Column:
    """Genomic position of the first base of the stop, in transcription order."""
    plus = cds["end"] - (2 if inclusive else 3)
    return F.when(strand == "-", cds["start"] + (0 if legacy else 2)).otherwise(plus)


def stop_distance(exons: Column, strand: Column, cds: Column, inclusive: bool = False, legacy: bool = False) -> Column:
    """Last junction minus stop in transcript coordinates; null for one exon, no coding span or a stop outside the exons."""
    return last_junction(exons) - transcript_position(exons, strand, stop_start(cds, strand, inclusive, legacy))


def hard_rule(distance: Column, threshold: int = THRESHOLD, strict: bool = True) -> Column:
    return F.coalesce(distance > threshold if strict else distance >= threshold, F.lit(False))


def soft_rule(distance: Column, threshold: int = THRESHOLD, tau: float = 10.0) -> Column:
    return F.coalesce(sigmoid((distance - threshold) / F.lit(max(1e-6, tau))), F.lit(0.0))


def feature_vector(exons: Column, soft: Column) -> Column:
    """[exons, kilobases, more than one exon, share of the last exon, soft rule]."""
    total, last = exon_length(exons).cast("double"), F.element_at(exons, -1)
    share = F.when(total > 0, (last["end"] - last["start"]) / total).otherwise(0.0)
    return F.array(F.size(exons).cast("double"), total / 1000.0, (F.size(exons) > 1).cast("double"), share, soft)


def mlp(features: Column, hidden: Sequence[Sequence[float]], hidden_bias: Sequence[float], out: Sequence[float], out_bias: float) -> Column:
    """Logit of a two-layer ReLU network whose weights are literals."""
    vector = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    units = F.array(*(F.greatest(dot(features, vector(w)) + float(b), F.lit(0.0)) for w, b in zip(hidden, hidden_bias, strict=True)))
    return dot(units, vector(out)) + float(out_bias)


def scores(isoforms: DataFrame, weights: tuple | None = None, mode: str = "rule", alpha: float = 0.5, threshold: int = THRESHOLD, tau: float = 10.0, strict: bool = True) -> DataFrame:
    """``isoforms`` (exons, strand, cds) with distance, rule_hard, rule_soft, mode and p, in mode rule, learned or hybrid."""
    d = stop_distance(F.col("exons"), F.col("strand"), F.col("cds"))
    out = isoforms.withColumn("distance", d).withColumn("rule_hard", hard_rule(F.col("distance"), threshold, strict).cast("double")).withColumn("rule_soft", soft_rule(F.col("distance"), threshold, tau))
    if mode == "rule":
        p = F.col("rule_hard")
    else:
        learned = sigmoid(mlp(feature_vector(F.col("exons"), F.col("rule_soft")), *weights))
        p = learned if mode == "learned" else alpha * F.col("rule_soft") + (1 - alpha) * learned
    return out.withColumn("mode", F.lit(mode)).withColumn("p", p)
