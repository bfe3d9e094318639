"""Sparse and dense arrays, numerics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit(arr: Column, length: Column | int, pad: int = 0) -> Column:
    """An array cut or padded to ``length``."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.slice(F.concat(arr, F.array_repeat(F.lit(pad), n.cast("int"))), F.lit(1), n.cast("int"))


def dense(bins: Column, length: Column | int) -> Column:
    """A 0/1 array of ``length`` from sorted distinct set bins, in time linear in the length."""
    n = F.lit(length) if isinstance(length, int) else length
    gap = lambda b, i: b - F.when(i == 0, F.lit(-1)).otherwise(F.get(bins, i - 1)) - 1
    runs = F.transform(bins, lambda b, i: F.concat(F.array_repeat(F.lit(0), gap(b, i).cast("int")), F.array(F.lit(1))))
    last = F.when(F.size(bins) > 0, F.element_at(bins, -1)).otherwise(F.lit(-1))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(0), (n - last - 1).cast("int")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    return F.log(sigmoid(x) + F.lit(1e-9))


def exon_length(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0).cast("long"), lambda a, e: a + e["end"] - e["start"])


def in_order(exons: Column, strand: Column) -> Column:
    """Whether exons are non-empty and in transcription order; exons may touch."""
    neighbours = F.zip_with(F.slice(exons, F.lit(1), F.greatest(F.size(exons) - 1, F.lit(0))), F.slice(exons, 2, 1 << 30), lambda a, b: F.when(strand == "-", b["end"] <= a["start"]).otherwise(a["end"] <= b["start"]))
    return F.forall(neighbours, lambda x: x) & F.forall(exons, lambda e: e["end"] > e["start"])


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), 0)
