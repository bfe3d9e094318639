"""Identifiers: attribute strings, junction ids, variant specs, keys, sample names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import once

_STRANDED = r"^(chr[^:]+|[^:]+):(\d+)-(\d+)[:_]([+-])$"
_PLAIN = r"^([^:]+):(\d+)-(\d+)$"
_UNDERSCORE = r"^(.+?)_(\d+)_(\d+)(?:_([+-]))?$"
_SPEC = r"(?i)^(chr[0-9A-Za-z_.]+|[0-9A-Za-z_.]+):(\d+)([ACGTN-]+)>([ACGTN-]+)$"


def parse_attributes(text: Column) -> Column:
    """``key "value"; key value; …`` as a map; the last of equal keys wins."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x.contains(" "))
    pairs = F.transform(parts, lambda x: F.struct(F.substring_index(x, " ", 1).alias("key"), F.trim(F.translate(x.substr(F.instr(x, " ") + 1, F.char_length(x)), '"', "")).alias("value")))
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, 1 << 30), lambda q: q["key"] == p["key"]))
    return once(pairs, lambda ps: F.map_from_entries(last(ps)))


def parse_junction(text: Column) -> Column:
    """struct<chrom,donor,acceptor,strand> of ``chr:a-b:strand``, ``chr:a-b_strand``, ``chr:a-b`` or ``chr_a_b[_strand]``;
    a missing strand is '+'; null if nothing fits, for the caller to set aside."""

    def of(pattern: str, strand: bool) -> Column:
        s = F.regexp_extract(text, pattern, 4) if strand else F.lit("")
        return F.when(
            text.rlike(pattern),
            F.struct(
                F.regexp_extract(text, pattern, 1).alias("chrom"),
                F.try_to_number(F.regexp_extract(text, pattern, 2), F.lit("9" * 18)).cast("long").alias("donor"),
                F.try_to_number(F.regexp_extract(text, pattern, 3), F.lit("9" * 18)).cast("long").alias("acceptor"),
                F.when(s == "", "+").otherwise(s).alias("strand"),
            ),
        )

    return F.coalesce(of(_STRANDED, True), of(_PLAIN, False), of(_UNDERSCORE, True))


def parse_spec(text: Column) -> Column:
    """struct<chrom,pos0,pos1,ref,alt,type> of ``chr:POSREF>ALT`` (spaces dropped, any case); null if it isn't one."""
    # no field has a space left, so line ends part them; where nothing fits there is one field
    fields = F.split(F.regexp_replace(F.regexp_replace(text, r"\s", ""), _SPEC, "$1\n$2\n$3\n$4"), "\n")

    def parsed(f: Column) -> Column:
        pos, ref, alt = F.when(F.length(f[1]) <= 18, f[1].try_cast("bigint")), F.upper(f[2]), F.upper(f[3])
        return F.when(F.size(f) == 4, F.struct(f[0].alias("chrom"), (pos - 1).alias("pos0"), pos.alias("pos1"), ref.alias("ref"), alt.alias("alt"), spec_type(ref, alt).alias("type")))

    return once(fields, parsed)


def spec_type(ref: Column, alt: Column) -> Column:
    """SNP if both are one base; '-' makes INS or DEL; anything else is INDEL."""
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1) & (ref != "-") & (alt != "-"), "SNP").when(ref == "-", "INS").when(alt == "-", "DEL").otherwise("INDEL")


def length_type(ref: Column, alt: Column) -> Column:
    """INS or DEL by length, SNP where lengths are equal."""
    return F.when(F.length(ref) < F.length(alt), "INS").when(F.length(ref) > F.length(alt), "DEL").otherwise("SNP")


def variant_spec(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat(chrom, F.lit(":"), pos.cast("string"), ref, F.lit(">"), alt)


def isoform_key(exons: Column, strand: Column) -> Column:
    """``strand:start-end,start-end`` in transcription order."""
    return F.concat(strand, F.lit(":"), F.array_join(F.transform(exons, lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"))), ","))


def strand_sites(start: Column, end: Column, strand: Column) -> tuple[Column, Column]:
    """(donor, acceptor) of an intron given as start and end."""
    return F.when(strand == "-", end - 1).otherwise(start), F.when(strand == "-", start).otherwise(end)


def sample_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")
