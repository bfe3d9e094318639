"""Nucleotide strings as Column expressions: complements, tokens, padding, crops, spliced transcripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two base vocabularies and the stop codons.
TOKENS = {"A": 1, "C": 2, "G": 3, "T": 4, "N": 5}
ENCODER_TOKENS = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4}
STOPS = ("TAA", "TAG", "TGA")


def revcomp(seq: Column, unknown_to_n: bool = False) -> Column:
    """Reverse complement, upper-cased; optionally every other letter becomes N."""
    up = F.upper(seq)
    if unknown_to_n:
        up = F.regexp_replace(up, "[^ACGTN]", "N")
    return F.reverse(F.translate(up, "ACGTN", "TGCAN"))


def tokens(seq: Column, max_len: int, pad: int = 0, vocabulary: dict[str, int] = TOKENS) -> Column:
    """Bases as integers, cut or padded to ``max_len``; a letter outside the vocabulary counts as N."""
    body = F.upper(F.substring(seq, 1, max_len))
    known = F.create_map(*(F.lit(x) for kv in vocabulary.items() for x in kv))
    letters = F.filter(F.split(body, ""), lambda b: b != "")
    return F.concat(F.transform(letters, lambda b: F.coalesce(F.try_element_at(known, b), F.lit(vocabulary["N"]))), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(max_len) - F.char_length(body))))


def padded_window(seq: Column, length: Column, start: Column, end: Column) -> Column:
    """``seq[start:end)`` of a contig of ``length`` bases, N wherever the window leaves it on either side."""
    left, right = F.greatest(F.lit(0), F.least(end, F.lit(0)) - start), F.greatest(F.lit(0), end - F.greatest(length, start))
    a, b = F.greatest(start, F.lit(0)), F.least(end, length)
    body = F.when(b > a, seq.substr((a + 1).cast("int"), (b - a).cast("int"))).otherwise("")
    return F.concat(F.repeat(F.lit("N"), left.cast("int")), body, F.repeat(F.lit("N"), right.cast("int")))


def crop(seq: Column, key: Column, max_len: int, seed: int) -> Column:
    """At most ``max_len`` bases; where more exist the offset is a hash of key and seed, so layout doesn't matter."""
    spare = F.char_length(seq) - max_len
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % F.greatest(spare + 1, F.lit(1))
    return F.when(spare > 0, seq.substr((offset + 1).cast("int"), F.lit(max_len))).otherwise(seq)


def spliced_exons(exons: Column, seq: Column, strand: Column) -> Column:
    """Exon strings in transcription order."""
    plus = F.transform(F.array_sort(exons), lambda e: seq.substr((e["start"] + 1).cast("int"), (e["end"] - e["start"]).cast("int")))
    return F.when(strand == "-", F.reverse(F.transform(plus, lambda s: revcomp(s)))).otherwise(plus)


def spliced_cdna(exons: Column, seq: Column, strand: Column) -> Column:
    """The transcript: exons joined in genomic order, reverse-complemented on the minus strand."""
    return F.array_join(spliced_exons(exons, seq, strand), "")


def stop_edits() -> list[tuple[str, int, str]]:
    """(codon, offset, base): for each codon that one edit can make a stop, the first such edit."""
    out = []
    for codon in (a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"):
        edits = ((i, base) for i in range(3) for base in "ACGT" if base != codon[i] and codon[:i] + base + codon[i + 1 :] in STOPS)
        if codon not in STOPS and (first := next(edits, None)):
            out.append((codon, *first))
    return out
