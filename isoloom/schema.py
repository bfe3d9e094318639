"""Schemas of the data model and checks on analysed plans (no jobs run)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

GTF_FEATURE = "chrom string, source string, feature string, start long, end long, strand string, attrs map<string,string>"
JUNCTION = "sample_id string, chrom string, donor long, acceptor long, strand string, count long"
VARIANT = "chrom string, pos long, id string, ref string, alt string, qual double, filter string, info string, samples array<string>"
WINDOW = "chrom string, start long, end long, seq string, bin_size int, donor array<int>, acceptor array<int>, tss array<int>, polya array<int>"
SEQUENCE_SAMPLE = "seq string, strand string, label double"
EXONS = "array<struct<start:bigint,end:bigint,score:double>>"
ISOFORM = f"locus string, iso_id long, strand string, score double, exons {EXONS}"


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")
    return df


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select([c for c in columns if c in df.columns])
