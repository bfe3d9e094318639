"""Column builders on literal rows."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isoloom.functions import arrays, ids, sequence, variants
from isoloom.operators import intervals
from isoloom.schema import keep_columns, require_columns


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


# Inputs and results that both sides must share.
@pytest.mark.parametrize("seq,rc", [("ATCG", "CGAT"), ("ACGT", "ACGT"), ("GCTA", "TAGC"), ("NNNN", "NNNN"), ("", "")])
def test_revcomp(spark, seq, rc):
    assert one(spark, x=sequence.revcomp(F.lit(seq)))["x"] == rc


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ACGTNacgtn", max_size=30), min_size=1, max_size=20))
def test_revcomp_twice(spark, seqs):
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    for s, x in df.select("s", sequence.revcomp(sequence.revcomp(F.col("s")))).collect():
        assert x == s.upper()


# Fixed values.
@pytest.mark.parametrize("seq,n,out", [("ACGT", 10, [1, 2, 3, 4, 0, 0, 0, 0, 0, 0]), ("ACGT", 2, [1, 2]), ("NNNN", 4, [5, 5, 5, 5]), ("", 4, [0, 0, 0, 0]), ("AX", 2, [1, 5])])
def test_tokens(spark, seq, n, out):
    assert one(spark, x=sequence.tokens(F.lit(seq), n))["x"] == out


def test_spliced_cdna(spark):
    seq = F.lit("ACGT" * 5)
    exons = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((10, 12), (16, 18))))
    assert one(spark, x=sequence.spliced_cdna(exons, seq, F.lit("+")), y=sequence.spliced_cdna(exons, seq, F.lit("-"))) == ("GTAC", "GTAC")


def test_padding_on_both_sides(spark):
    n = lambda v: F.lit(v).cast("long")
    r = one(spark, a=sequence.padded_window(F.lit("ACGT"), n(4), n(-2), n(3)), b=sequence.padded_window(F.lit("ACGT"), n(4), n(2), n(7)), c=sequence.padded_window(F.lit("ACGT"), n(4), n(9), n(12)))
    assert tuple(r) == ("NNACG", "GTNNN", "NNN")


def test_dense(spark):
    r = one(spark, a=arrays.dense(F.array(F.lit(0), F.lit(3)), 5), b=arrays.dense(F.array().cast("array<int>"), 3))
    assert r["a"] == [1, 0, 0, 1, 0] and r["b"] == [0, 0, 0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("chr1:10-20:+", ("chr1", 10, 20, "+")), ("chr1:10-20_-", ("chr1", 10, 20, "-")), ("chr2:5-9", ("chr2", 5, 9, "+")), ("chr1_12_34", ("chr1", 12, 34, "+")), ("chr1_12_34_-", ("chr1", 12, 34, "-")), ("nothing", None), ("", None),
    ],
)
def test_junction_ids(spark, text, want):
    got = one(spark, x=ids.parse_junction(F.lit(text)))["x"]
    assert (tuple(got) if got else None) == want


def test_attributes_last_wins(spark):
    assert one(spark, x=ids.parse_attributes(F.lit('gene_id "a"; tag "x"; tag "y"; bare; n 5;')))["x"] == {"gene_id": "a", "tag": "y", "n": "5"}


@pytest.mark.parametrize("text,want", [("chr1:5A>T", ("chr1", 4, 5, "A", "T", "SNP")), ("CHR2:7 ac > g", ("CHR2", 6, 7, "AC", "G", "INDEL")), ("chr1:3->A", ("chr1", 2, 3, "-", "A", "INS")), ("chr1:3A>-", ("chr1", 2, 3, "A", "-", "DEL")), ("x", None)])
def test_specs(spark, text, want):
    got = one(spark, x=ids.parse_spec(F.lit(text)))["x"]
    assert (tuple(got) if got else None) == want


def _apply(spark, seq, items, strict=False):
    arr = F.array(*(F.struct(F.lit(i).cast("long").alias("idx0"), F.lit(r).alias("ref"), F.lit(a).alias("alt"), F.lit(t).alias("var_type")) for i, r, a, t in items))
    return one(spark, x=variants.apply_many(F.lit(seq), arr, strict))["x"]


def test_apply_many(spark):
    assert _apply(spark, "ACGTACGT", [(1, "C", "T", "SNP"), (3, "T", "TGG", "INS"), (5, "CG", "C", "DEL")]) == "ATGTGGACT"
    assert _apply(spark, "ACGT", [(0, "ACG", "A", "DEL"), (1, "C", "T", "SNP")]) == "NNNN"
    assert _apply(spark, "ACGT", [(1, "G", "GA", "INS")]) == "ACAGT"
    assert _apply(spark, "ACGT", [(1, "G", "GA", "INS")], strict=True) == "NNNN"


def test_greedy_equals_loop(spark):
    import random

    rng = random.Random(3)
    for _ in range(5):
        spans = sorted((s := rng.randrange(50), s + rng.randrange(1, 9)) for _ in range(20))
        want, last = [], -1
        for s, e in spans:
            if s >= last:
                want.append((s, e))
                last = e
        arr = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in spans))
        assert [tuple(x) for x in one(spark, x=intervals.greedy(arr))["x"]] == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-60, 60), st.integers(1, 40)), max_size=12), st.lists(st.tuples(st.integers(-60, 60), st.integers(1, 40)), max_size=12))
def test_overlap_join_equals_theta_join(spark, a, b):
    frame = lambda xs, p: spark.createDataFrame([(i, "c", s, s + n) for i, (s, n) in enumerate(xs)], f"{p}_id long, k string, {p}_s long, {p}_e long")
    got = intervals.overlapping(frame(a, "l"), frame(b, "r"), ["k"], "l_s", "l_e", "r_s", "r_e", width=7).select("l_id", "r_id").collect()
    want = [(i, j) for i, (s, n) in enumerate(a) for j, (t, m) in enumerate(b) if s < t + m and s + n > t]
    assert sorted(map(tuple, got)) == sorted(want)


def test_tiles_refuse_bad_sizes(spark):
    df = spark.createDataFrame([("a", 100)], "chrom string, length long")
    with pytest.raises(ValueError):
        intervals.tiles(df, 50, 25, 10)
    assert [r["start"] for r in intervals.tiles(df, 40, 20).orderBy("start").collect()] == [0, 20, 40, 60]
    assert intervals.tiles(df, 200, 20).count() == 0


def test_columns(spark):
    df = spark.range(1).withColumn("x", F.lit(1))
    assert keep_columns(df, ["x", "nope"]).columns == ["x"]
    with pytest.raises(ValueError, match="Missing columns: donor"):
        require_columns(df, ["id", "donor"])
