"""Variants over tiled windows: deduplication, placement, channels, conflict-free selection, counts.

Everything groups by (chrom, window start): a tile bounds what meets in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.functions import ids, variants
from isoloom.functions.arrays import once
from isoloom.sources.readers import window_sequences
from isoloom.sources.scratch import written

from . import intervals, ordered

TYPES = ("SNP", "INS", "DEL")
#: Places of a window that is folded in one row.
TASK_PLACES = 20_000


def typed(df: DataFrame) -> DataFrame:
    """With var_type, spec, and the 0-based span [span_start, span_end) that a variant takes."""
    out = df.withColumn("var_type", ids.length_type(F.col("ref"), F.col("alt"))).withColumn("spec", ids.variant_spec(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    return out.withColumn("span_start", F.col("pos").cast("long") - 1).withColumn("span_end", variants.span_end(F.col("span_start"), F.col("ref"), F.col("var_type")))


def first_of_equals(df: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each (chrom, pos, ref, alt): the first in the given order."""
    n = F.row_number().over(W.partitionBy("chrom", "pos", "ref", "alt").orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") == 1).drop("__n")


def duplicates(df: DataFrame) -> DataFrame:
    """One row: rows, distinct variants and duplicates."""
    per = df.groupBy("chrom", "pos", "ref", "alt").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_unique"))


def in_windows(df: DataFrame, lengths: DataFrame, window: int, stride: int) -> DataFrame:
    """Each variant with every full tile that holds it: start, end, in_window_idx (1-based) and idx0."""
    placed = intervals.looked_up(df, lengths.select("chrom", "length"), ["chrom"]).withColumn("start", F.explode(intervals.tiles_of(F.col("pos").cast("long") - 1, window, stride)))
    placed = placed.where(F.col("start") + window <= F.col("length")).drop("length")
    return placed.withColumn("end", F.col("start") + window).withColumn("in_window_idx", F.col("pos") - F.col("start")).withColumn("idx0", F.col("in_window_idx") - 1)


def channels(placed: DataFrame, window: int) -> DataFrame:
    """Sparse channels of each window: anchors of SNPs and insertions, all reference bases of deletions, all anchors."""
    at = F.col("idx0").cast("int")
    hit = lambda kind: F.array_sort(F.collect_set(F.when(F.col("var_type") == kind, at)))
    run = F.sequence(at, F.least(at + F.length("ref"), F.lit(window)) - 1)
    dele = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("var_type") == "DEL", run)))))
    return placed.groupBy("chrom", "start", "end").agg(hit("SNP").alias("ch_snp"), hit("INS").alias("ch_ins"), dele.alias("ch_del"), F.array_sort(F.collect_set(at)).alias("ch_any"))


def without_conflicts(placed: DataFrame, longest: int | None = None, task_places: int = TASK_PLACES) -> DataFrame:
    """The variants of each window that greedy acceptance by (span, ref, alt) keeps.

    Of variants that begin at one place only the first can be accepted: if it isn't, none of them is, and if it is, it is
    in the others' way.  So one for each place is looked at.  A window of up to ``task_places`` bases is folded in one row.  Where
    windows may be longer than that, or of any length, they fall into islands first (intervals.islands), which are folded in a row
    each; an island of more than ``task_places`` places is followed by pointers (intervals.greedy_chain)."""
    window = ["chrom", "start", "end"]
    item = F.struct("span_start", "span_end", "pos", "ref", "alt", "var_type", "spec")

    def folded(df: DataFrame, keys: list[str]) -> DataFrame:
        grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_list("item")).alias("items"))
        kept = F.explode(intervals.greedy(F.col("items"), "span_start", "span_end")).alias("v")
        return grouped.select(*window, kept).select(*window, "v.*")

    if longest is not None and longest <= task_places:
        return folded(placed.groupBy(*window, "span_start").agg(F.min(item).alias("item")), window)
    island, key = "__island", [*window, "__island"]
    dealt = intervals.in_stretches(placed.withColumn("item", item).select(*window, "span_start", "item"), window, "span_start")
    first = dealt.groupBy(*window, intervals.STRETCH, "span_start").agg(F.min("item").alias("item"))
    rows = written(intervals.islands(first.withColumn("span_end", F.col("item.span_end")), window, "span_start", "span_end", island), "window-islands")
    large = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_places).select(*key), "large-islands")
    if large.isEmpty():
        return folded(rows, key)
    rest = folded(rows.join(large.hint("merge"), key, "left_anti"), key)
    flat = rows.join(large.hint("merge"), key, "left_semi").select(*key, "item.*")
    return rest.unionByName(intervals.greedy_chain(flat, key, "span_start", "span_end").drop(island))


def quotas(counts: Column, most: int) -> Column:
    """struct<SNP,INS,DEL>: floor(cap * share) slots a type, what is left to the commonest (ties: SNP, INS, DEL); the cap
    is ``most`` or the number of variants if fewer."""
    total = counts["SNP"] + counts["INS"] + counts["DEL"]
    cap = F.least(total, F.lit(most).cast("long"))
    share = {t: F.floor(cap * counts[t] / total) for t in TYPES}
    left = cap - share["SNP"] - share["INS"] - share["DEL"]
    top = F.when((counts["SNP"] >= counts["INS"]) & (counts["SNP"] >= counts["DEL"]), "SNP").when(counts["INS"] >= counts["DEL"], "INS").otherwise("DEL")
    return F.struct(*((share[t] + F.when(top == t, left).otherwise(0)).alias(t) for t in TYPES))


def balanced(placed: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` variants of each window, types in their natural shares, none overlapping.

    Order within a type is the md5 of seed and spec, so no layout or shuffle seed matters; insertions and deletions
    take turns first, SNPs fill up.  A window without more than ``most`` variants only loses conflicts.  Of the variants of
    a type with one span only the first in order can be taken, so no more are folded: a window's length bounds the array."""
    luck = F.md5(F.concat(F.lit(f"{seed}:"), "spec").cast("binary"))
    window = W.partitionBy("chrom", "start")
    ranked = placed.withColumn("luck", luck).withColumn("turn", F.row_number().over(W.partitionBy("chrom", "start", "var_type").orderBy("luck", "spec")))
    ranked = ranked.withColumn("phase", (F.col("var_type") == "SNP").cast("int")).withColumn("after", (F.col("var_type") == "DEL").cast("int"))
    count = F.struct(*(F.sum((F.col("var_type") == t).cast("long")).over(window).alias(t) for t in TYPES))
    ranked = ranked.withColumn("quota", quotas(count, most))
    item = F.struct("phase", "turn", "after", "span_start", "span_end", "pos", "ref", "alt", "var_type", "spec")
    first = ranked.groupBy("chrom", "start", "end", "quota", "var_type", "span_start", "span_end").agg(F.min(item).alias("item"))
    grouped = first.groupBy("chrom", "start", "end", "quota").agg(F.array_sort(F.collect_list("item")).alias("items"))
    state = F.struct(F.array().cast("array<struct<s:bigint,e:bigint,i:int>>").alias("kept"), *(F.lit(0).cast("long").alias(t) for t in TYPES))

    def step(a: Column, x: Column) -> Column:
        used, room = F.lit(None).cast("long"), F.lit(None).cast("long")
        for t in TYPES:
            used, room = F.when(x["t"] == t, a[t]).otherwise(used), F.when(x["t"] == t, F.col("quota")[t]).otherwise(room)
        take = (used < room) & ~F.exists(a["kept"], lambda k: (k["s"] < x["e"]) & (x["s"] < k["e"]))
        grown = F.concat(a["kept"], F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["i"].alias("i"))))
        return once(take, lambda yes: F.struct(F.when(yes, grown).otherwise(a["kept"]).alias("kept"), *((a[t] + (yes & (x["t"] == t)).cast("long")).alias(t) for t in TYPES)))

    flat = F.transform("items", lambda x, i: F.struct(x["span_start"].cast("long").alias("s"), x["span_end"].cast("long").alias("e"), x["var_type"].alias("t"), i.alias("i")))
    kept = F.aggregate(flat, state, step)["kept"]
    return grouped.select("chrom", "start", "end", F.explode(F.transform(kept, lambda k: F.get(F.col("items"), k["i"]))).alias("v")).select("chrom", "start", "end", "v.pos", "v.ref", "v.alt", "v.var_type", "v.spec", "v.span_start", "v.span_end")


def edited_windows(placed: DataFrame, lengths: DataFrame, chunks: DataFrame, size: int, strict: bool = False) -> DataFrame:
    """Windows with all their variants applied (seq_alt); sequences come as ``chunks`` of ``size`` bases."""
    item = F.struct("idx0", "ref", "alt", "var_type")
    grouped = placed.groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_list(item)).alias("items"))
    cut = window_sequences(grouped, lengths, chunks, size)
    text = grouped.join(cut.hint("merge"), ["chrom", "start", "end"])
    return text.withColumn("seq_alt", variants.apply_many(F.col("seq"), F.col("items"), strict)).drop("items")


def with_bases(df: DataFrame, lengths: DataFrame, chunks: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Variants with ``bases``, the reference from ``before`` bases ahead of their position to ``after`` beyond their ref (N
    beyond the contig), and ``bases_start``, where these begin."""
    at = df.withColumn("bases_start", F.col("pos").cast("long") - 1 - before).withColumn("bases_end", F.col("pos").cast("long") - 1 + F.length("ref") + after)
    wanted = at.select("chrom", F.col("bases_start").alias("start"), F.col("bases_end").alias("end"))
    cut = window_sequences(wanted, lengths, chunks, size).select("chrom", F.col("start").alias("bases_start"), F.col("end").alias("bases_end"), F.col("seq").alias("bases"))
    return at.join(cut.hint("merge"), ["chrom", "bases_start", "bases_end"]).drop("bases_end")


def reference_mismatches(df: DataFrame, lengths: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """Variants of known contigs by type, and how many name a reference that isn't there (N beyond the contig).

    A variant meets the chunk that it lies in and is counted there; nothing of it is shuffled again.  One that touches several
    chunks is a row in each, and these rows are counted as one.  Only contigs of which no chunk was met are looked up."""
    start = F.col("pos").cast("long") - 1
    end = start + F.length("ref")
    lo, hi = (F.floor(x / F.lit(size)).cast("long") for x in (start, F.greatest(end - 1, start)))
    asked = df.select("chrom", "var_type", "pos", "ref", F.explode(F.sequence(lo, hi)).alias("chunk_id"))
    met = asked.join(chunks.select("chrom", "chunk_id", "chunk").hint("merge"), ["chrom", "chunk_id"], "left")
    a, b = F.greatest(start, F.col("chunk_id") * size), F.least(end, (F.col("chunk_id") + 1) * size)
    n = (b - a).cast("int")
    there = F.rpad(F.coalesce(F.col("chunk").substr((a - F.col("chunk_id") * size + 1).cast("int"), n), F.lit("")), n, "N")
    wrong = F.col("ref").substr((a - start + 1).cast("int"), n) != there
    missing, wide = F.col("chunk").isNull(), F.when(lo < hi, F.struct("chrom", "pos", "ref"))
    groups = met.groupBy("var_type", wide.alias("wide"), F.when(missing & (lo == hi), F.col("chrom")).alias("lost"))
    counts = groups.agg(F.count_if(F.col("chunk_id") == lo).alias("n"), F.count_if(wrong).alias("wrong"), F.bool_and(missing).alias("none"))
    lost = F.coalesce("lost", F.when(F.col("none"), F.col("wide.chrom")))
    bad = F.when(F.col("wide").isNull(), F.col("wrong")).when(F.col("wrong") > 0, F.col("n")).otherwise(0)
    counts = written(counts.select("var_type", lost.alias("chrom"), "n", bad.alias("n_mismatches")), "mismatch-counts")
    known = counts.where("chrom IS NULL")
    if not counts.where("chrom IS NOT NULL").isEmpty():
        known = known.unionByName(counts.where("chrom IS NOT NULL").join(lengths.select("chrom").hint("merge"), "chrom", "left_semi"))
    return known.groupBy("var_type").agg(F.sum("n").alias("n"), F.sum("n_mismatches").alias("n_mismatches"))


def window_counts(placed: DataFrame) -> DataFrame:
    """Distinct variants of each window, in all and by type (unknown types as UNK)."""
    kind = F.coalesce("var_type", F.lit("UNK"))
    distinct = placed.select("chrom", "start", "end", "pos", "ref", "alt", kind.alias("var_type")).distinct()
    out = distinct.groupBy("chrom", "start", "end").agg(*(F.count_if(F.col("var_type") == t).alias(t) for t in (*TYPES, "UNK")))
    return out.withColumn("variant_count", sum((F.col(t) for t in (*TYPES, "UNK")), F.lit(0)))


def count_spread(counts: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: windows, those with variants, and mean, extremes and percentiles of variants over windows with any."""
    total = windows.agg(F.count(F.lit(1)).alias("n_windows"))
    q = F.percentile("variant_count", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    one = counts.agg(F.count(F.lit(1)).alias("n_with"), F.min("variant_count").alias("least"), F.max("variant_count").alias("most"), F.avg("variant_count").alias("mean"), q.alias("q"))
    return total.crossJoin(one).select("n_windows", "n_with", (F.col("n_with") / F.col("n_windows")).alias("share"), "least", "most", "mean", *(F.get("q", k).alias(f"p{p}") for k, p in enumerate((5, 25, 50, 75, 95))))  # one row each


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, var_type, n, percent): counters of every stage with totals (var_type ALL)."""
    rows = None
    for name, df in stages.items():
        part = df.groupBy("var_type").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    out = rows.rollup("stage", "var_type").agg(F.sum("n").alias("n"), F.grouping_id().alias("g")).where(F.col("g") < 3)
    total = F.sum(F.when(F.col("g") == 1, F.col("n"))).over(W.partitionBy("stage"))
    return out.select("stage", F.coalesce("var_type", F.lit("ALL")).alias("var_type"), "n", (100.0 * F.col("n") / total).alias("percent"))


def top_windows(counts: DataFrame, n: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("variant_count"), "chrom", "start").limit(n)


def natural_ranks(df: DataFrame, chrom: str = "chrom", name: str = "place") -> DataFrame:
    """``df`` (a row a chromosome) with each chromosome's place in natural order, from 1, over all of them."""
    return ordered.ranked(df, natural_order(F.col(chrom)), name)


def natural_order(chrom: Column) -> list[Column]:
    """Sort keys: chr2 before chr10."""
    bare = F.regexp_replace(chrom, "^chr", "")
    return [F.length(bare), bare, chrom]


def rewindowed(base: DataFrame, window: int, stride: int) -> DataFrame:
    """Variants of abutting base windows (chrom, start, end, pos, ...) in hopping windows that begin at the first base
    window's start and while they begin before the last one's end; conflicts removed in each.  The base is written once, since
    both the ends and the placing read it."""
    base = written(base.select("chrom", "start", "end", "pos", "ref", "alt", "var_type", "spec", "span_start", "span_end"), "base-windows")
    ends = written(base.groupBy("chrom").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end")), "window-ends")
    placed = intervals.looked_up(base.drop("start", "end"), ends, ["chrom"])
    placed = placed.withColumn("start", F.explode(intervals.tiles_of(F.col("pos").cast("long") - 1, window, stride, F.col("first_start")))).where(F.col("start") < F.col("last_end")).withColumn("end", F.col("start") + window)
    kept = without_conflicts(placed.drop("first_start", "last_end"), window)
    idx = F.col("pos") - F.col("start")
    return kept.withColumn("in_window_idx", idx).withColumn("span_from", idx).withColumn("span_to", idx + F.length("ref"))


def window_summary(tiles: DataFrame, metrics: DataFrame, counts: DataFrame) -> DataFrame:
    """Tiles with junction metrics and variant counts; windows without variants count 0, other metrics stay null."""
    keys = ["chrom", "start", "end"]
    extra = [c for c in metrics.columns if c in keys or c not in tiles.columns]
    out = tiles.join(metrics.select(*extra).hint("merge"), keys, "left")
    more = [c for c in counts.columns if c in keys or c not in out.columns]
    return out.join(counts.select(*more).hint("merge"), keys, "left").withColumn("variant_count", F.coalesce("variant_count", F.lit(0)))
