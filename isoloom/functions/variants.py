"""Variants against windows: alignment, editing, rescue, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import once


def span_end(pos0: Column, ref: Column, var_type: Column) -> Column:
    """End of the bases that a variant takes: an insertion only its anchor."""
    return pos0 + F.when(var_type == "INS", 1).otherwise(F.length(ref))


def align(spec: Column, chrom: Column, start: Column, end: Column) -> Column:
    """struct<in_window,in_window_idx,span> of a parsed spec (0-based); the span is clipped, null for ref '-' or none."""
    same = spec["chrom"] == chrom
    inside = same & (spec["pos0"] >= start) & (spec["pos0"] < end)
    touches = same & (spec["ref"] != "-") & (start < spec["pos1"]) & (spec["pos0"] < end)
    span = F.array(F.greatest(F.lit(0).cast("long"), spec["pos0"] - start), F.least(end - start, spec["pos1"] - start))
    return F.struct(F.coalesce(inside, F.lit(False)).alias("in_window"), F.when(inside, spec["pos0"] - start).alias("in_window_idx"), F.when(touches, span).alias("span"))


def apply_spec(seq: Column, idx: Column, span: Column, ref: Column, alt: Column, kind: Column) -> Column:
    """One spec variant applied to a window's text; unchanged where it can't be."""
    n = F.char_length(seq)
    part = lambda a, b: seq.substr((a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    zero = F.lit(0).cast("long")
    s, e = F.coalesce(span[0], idx), F.coalesce(span[1], idx + F.length(ref))
    cut = F.concat(part(zero, s), F.when(alt == "-", "").otherwise(alt), part(e, n))
    return (
        F.when(idx.isNull() | (idx < 0) | (idx > n), seq)
        .when((kind == "SNP") & (idx < n), F.concat(part(zero, idx), alt, part(idx + 1, n)))
        .when(kind == "INS", F.concat(part(zero, idx), alt, part(idx, n)))
        .when(kind.isin("DEL", "INDEL") & (s <= e) & (e <= n), cut)
        .otherwise(seq)
    )


def spec_channels(seq_len: Column, idx: Column, span: Column, kind: Column) -> Column:
    """struct<snp,ins,del,any> of sparse positions; ``any`` is the union of the others."""
    none = F.array().cast("array<bigint>")
    here = (idx >= 0) & (idx < seq_len)
    snp = F.when((kind == "SNP") & here, F.array(idx)).otherwise(none)
    ins = F.when((kind == "INS") & here, F.array(idx)).otherwise(none)
    lo, hi = F.greatest(F.lit(0).cast("long"), span[0]), F.least(seq_len, span[1])
    dele = F.when(kind.isin("DEL", "INDEL") & span.isNotNull() & (hi > lo), F.sequence(lo, hi - 1)).otherwise(none)
    return F.struct(snp.alias("snp"), ins.alias("ins"), dele.alias("del"), F.array_union(F.array_union(snp, ins), dele).alias("any"))


def rescue(seq: Column, start: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """struct<pos,ref,alt> of an insertion whose reference disagrees with the window: shifted by one base to the left or
    right if that fits, else with the bases that are there.  ``pos`` is genomic and 1-based."""
    at = pos - 1 - start
    here = lambda a: seq.substr((a + 1).cast("int"), F.length(ref))
    fits = lambda a: (a >= 0) & (a + F.length(ref) <= F.char_length(seq)) & (here(a) == ref)
    out = lambda p, r, a: F.struct(p.cast("long").alias("pos"), r.alias("ref"), a.alias("alt"))
    actual = here(at)
    fixed = F.when((F.length(ref) == 1) & alt.startswith(ref) & (F.length(actual) > 0), F.concat(actual, alt.substr(F.lit(2), F.length(alt)))).otherwise(alt)
    return F.when((at < 0) | (at >= F.char_length(seq)) | (actual == ref), out(pos, ref, alt)).when(fits(at - 1), out(pos - 1, ref, alt)).when(fits(at + 1), out(pos + 1, ref, alt)).otherwise(out(pos, actual, fixed))


def apply_many(seq: Column, items: Column, strict: bool = False) -> Column:
    """A window's text with sorted variants (idx0, ref, alt, var_type) applied from the left.

    Overlaps, positions outside, and in strict mode any reference that disagrees, give N's of the window's length.  Else
    a disagreeing insertion keeps its inserted bases after the bases that are there."""
    n = F.char_length(seq).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"), F.lit(True).alias("ok"))

    def step(a: Column, v: Column) -> Column:
        end = F.least(v["idx0"] + F.length(v["ref"]), n)
        actual = seq.substr((v["idx0"] + 1).cast("int"), (end - v["idx0"]).cast("int"))
        same = actual == v["ref"]
        inserted = F.when(v["alt"].startswith(v["ref"]), v["alt"].substr(F.length(v["ref"]) + 1, F.length(v["alt"]))).otherwise(v["alt"])
        alt = F.when(same | (v["var_type"] != "INS"), v["alt"]).otherwise(F.concat(actual, inserted))
        fine = a["ok"] & (v["idx0"] >= a["at"]) & (v["idx0"] < n) & (same if strict else F.lit(True))
        text = F.concat(a["out"], seq.substr((a["at"] + 1).cast("int"), F.greatest(v["idx0"] - a["at"], F.lit(0)).cast("int")), alt)
        return F.struct(F.when(fine, end).otherwise(a["at"]).alias("at"), F.when(fine, text).otherwise(a["out"]).alias("out"), fine.alias("ok"))

    done = lambda end: F.when(end["ok"], F.concat(end["out"], seq.substr((end["at"] + 1).cast("int"), F.char_length(seq)))).otherwise(F.repeat(F.lit("N"), F.char_length(seq)))
    return once(F.aggregate(items, start, step), done)
