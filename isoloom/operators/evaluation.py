"""Comparison of predicted and true transcripts, and scores of tables of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.functions.arrays import once
from isoloom.sources.scratch import written


def in_transcription_order(exons: Column, strand: Column) -> Column:
    """Exons by (start, end), reversed on the minus strand."""
    plus = F.array_sort(F.transform(exons, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))))
    return F.when(strand == "-", F.reverse(plus)).otherwise(plus)


def junctions(exons: Column) -> Column:
    """array<struct<donor,acceptor>>: end of each exon with the start of the next, distinct, in order."""
    n = F.greatest(F.size(exons) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(exons, F.lit(1), n), F.slice(exons, 2, 1 << 30), lambda a, b: F.struct(a["end"].alias("donor"), b["start"].alias("acceptor"))))


def chain_match(pred: Column, truth: Column, slop: int = 0) -> Column:
    """Whether both chains have as many exons and all bounds agree within ``slop``."""
    near = F.zip_with(pred, truth, lambda a, b: (F.abs(a["start"] - b["start"]) <= slop) & (F.abs(a["end"] - b["end"]) <= slop))
    return (F.size(pred) == F.size(truth)) & F.coalesce(F.forall(near, lambda x: x), F.lit(False))


def matched_junctions(pred: Column, truth: Column, slop: int = 0) -> Column:
    """How many predicted junctions find a true one of their own, in order, each true one used once."""
    if slop == 0:
        return F.size(F.array_intersect(pred, truth))

    def step(used: Column, p: Column) -> Column:
        free = F.filter(F.transform(truth, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: (F.abs(x["t"]["donor"] - p["donor"]) <= slop) & (F.abs(x["t"]["acceptor"] - p["acceptor"]) <= slop) & ~F.array_contains(used, x["i"]))
        return F.when(F.size(free) > 0, F.concat(used, F.array(F.get(free, 0)["i"]))).otherwise(used)

    return F.size(F.aggregate(pred, F.array().cast("array<int>"), step))


def junction_scores(pred: Column, truth: Column, slop: int = 0) -> Column:
    """struct<precision,recall,f1>: all 1 without junctions on either side, all 0 without on one."""

    def counted(x: Column) -> Column:
        return F.struct(matched_junctions(x["pred"], x["truth"], slop).alias("tp"), F.size(x["pred"]).alias("n"), F.size(x["truth"]).alias("m"))

    def scored(x: Column) -> Column:
        tp, n, m = x["tp"], x["n"], x["m"]
        p, r = tp / n, tp / m
        f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
        pick = lambda x: F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(x)
        return F.struct(pick(p).alias("precision"), pick(r).alias("recall"), pick(f1).alias("f1"))

    return once(once(F.struct(pred.alias("pred"), truth.alias("truth")), counted), scored)


def aligned(preds: DataFrame, truths: DataFrame, strict: bool = False) -> DataFrame:
    """Predictions and truths of the same example side by side: every row of either, with ``has_pred`` and ``has_truth``.

    Both come with a column ``example``; other columns need different names.  A truth without a prediction is an example
    with an empty one.  A prediction without a truth has nothing to be held against: with ``strict`` it is an error that
    names the example."""
    p = preds.withColumn("has_pred", F.lit(True))
    t = truths.withColumn("has_truth", F.lit(True))
    both = t.hint("merge").join(p, "example", "full_outer")
    both = both.withColumn("has_pred", F.coalesce("has_pred", F.lit(False)))
    found = F.coalesce("has_truth", F.lit(False))
    if strict:
        found = F.when(found, True).otherwise(F.raise_error(F.concat(F.lit("no truth for example "), F.coalesce(F.col("example").cast("string"), F.lit("null")))).cast("boolean"))
    return both.withColumn("has_truth", found)


def evaluate(preds: DataFrame, truths: DataFrame, k: int = 5, slop: int = 0, strict: bool = False) -> DataFrame:
    """Per example: exact chain, junction scores of the best prediction, and whether one of the first k matches.

    ``preds`` (example, rank from 1, strand, exons), ``truths`` (example, strand, exons), one truth an example.  An example
    without predictions has an empty chain; predictions without a truth are left out, or with ``strict`` are an error."""
    t = truths.select("example", in_transcription_order(F.col("exons"), F.col("strand")).alias("truth"))
    p = preds.select("example", "rank", in_transcription_order(F.col("exons"), F.col("strand")).alias("pred"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    rows = aligned(p.where(F.col("rank") <= max(k, 1)), t, strict).where("has_truth").withColumn("pred", F.coalesce("pred", empty)).withColumn("rank", F.coalesce("rank", F.lit(1)))
    rows = rows.withColumn("hit", chain_match(F.col("pred"), F.col("truth"), slop))
    best = F.first(F.when(F.col("rank") == 1, F.struct("pred", "truth", "hit")), ignorenulls=True).alias("b")
    one = rows.groupBy("example").agg(best, F.max(F.when(F.col("rank") <= k, F.col("hit"))).alias("topk"))
    j = junction_scores(junctions(F.col("b.pred")), junctions(F.col("b.truth")), slop)
    return one.select("example", F.col("b.hit").cast("double").alias("chain"), j.alias("j"), F.coalesce("topk", F.lit(False)).cast("double").alias("topk")).select("example", "chain", "j.precision", "j.recall", "j.f1", "topk")


def means(per_example: DataFrame) -> DataFrame:
    """One row: examples and the five means, 0 without examples."""
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    return per_example.agg(F.count(F.lit(1)).alias("n"), mean("chain", "exact_chain_acc"), mean("precision", "junc_precision"), mean("recall", "junc_recall"), mean("f1", "junc_f1"), mean("topk", "topk_recall"))


def bce(logit: Column, target: Column, weight: float = 1.0) -> Column:
    """Binary cross-entropy of a logit, stable; ``weight`` multiplies the positive term."""
    soft = F.log1p(F.exp(-F.abs(logit)))
    if weight == 1.0:
        return F.greatest(logit, F.lit(0.0)) - logit * target + soft
    return (1 - target) * logit + (1 + (weight - 1) * target) * (soft + F.greatest(-logit, F.lit(0.0)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """log sum exp of an array of logits less the target's."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))) - F.get(logits, target)


def masked_mean(df: DataFrame, value: Column, pad: Column, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean over rows that aren't padding, 0 if all are."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.when(~pad, value)), F.lit(0.0)).alias(name))


def psi_divergence(df: DataFrame, eps: float = 1e-8) -> DataFrame:
    """One row, mean over loci of sum(p * (ln(p + eps) - log softmax(score))); ``df`` has locus, score, target."""
    locus = W.partitionBy("locus")
    shifted = F.col("score") - F.max("score").over(locus)
    rows = df.withColumn("__s", shifted).withColumn("__q", F.col("__s") - F.log(F.sum(F.exp("__s")).over(locus)))
    per = rows.groupBy("locus").agg(F.sum(F.col("target") * (F.log(F.col("target") + eps) - F.col("__q"))).alias("kl"))
    return per.agg(F.coalesce(F.avg("kl"), F.lit(0.0)).alias("mean_kl"))


def consistency(df: DataFrame, rule: str, learned: str) -> DataFrame:
    """One row, the mean of both binary cross-entropies between rule and learned probabilities (clamped)."""
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    a, b = clamp(rule), clamp(learned)
    h = lambda p, y: -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return df.agg(F.coalesce(F.avg((h(b, a) + h(a, b)) / 2), F.lit(0.0)).alias("consistency"))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the ROC curve, ties halved; null with one class only.

    Labels are counted by score first and dealt by ranges of scores that Spark draws.  The running count of negatives goes
    inside each range and over the ranges' sums, so no task sorts all scores."""
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    per = written(per.repartitionByRange("s").withColumn("range", F.spark_partition_id()), "scores")
    before = per.groupBy("range").agg(F.sum("neg").alias("neg_in"), F.sum("pos").alias("pos_in"))
    running = before.withColumn("neg_before", F.coalesce(F.sum("neg_in").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("neg").over(W.partitionBy("range").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = per.withColumn("inside", inside).join(F.broadcast(running.select("range", "neg_before")), "range")  # one row a range
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.col("inside") + F.col("neg") / 2))
    total = F.sum("pos") * F.sum("neg")
    return rows.agg(F.when(total > 0, area / total).alias("auroc"))


def hinge(df: DataFrame, margin: float = 1.0) -> DataFrame:
    """One row, mean of max(0, margin - (positive - negative)) over the pairs of each locus; ``df`` has locus, score, label.

    No pair is formed: a positive p meets the negatives above p - margin, whose number and sum run along the scores."""
    rows = df.where("label IN (0, 1) AND score IS NOT NULL AND locus IS NOT NULL").withColumn("at", F.when(F.col("label") == 1, F.col("score") - margin).otherwise(F.col("score")))
    above = W.partitionBy("locus").orderBy(F.desc("at"), "label").rowsBetween(W.unboundedPreceding, W.currentRow)
    negative = F.when(F.col("label") == 0, F.col("score"))
    rows = rows.withColumn("n", F.count(negative).over(above)).withColumn("sum", F.coalesce(F.sum(negative).over(above), F.lit(0.0)))
    loss = F.when(F.col("label") == 1, F.col("n") * (margin - F.col("score")) + F.col("sum")).otherwise(0.0)
    per = rows.groupBy("locus").agg(F.sum(loss).alias("loss"), (F.count_if(F.col("label") == 1) * F.count_if(F.col("label") == 0)).alias("pairs"))
    total = F.sum("pairs")
    return per.agg(F.coalesce(F.when(total > 0, F.sum("loss") / total), F.lit(0.0)).alias("mean_hinge"))


