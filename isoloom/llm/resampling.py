"""Target-distribution importance resampling.

Features of a text are its runs of 1 to ``run`` words, hashed into ``BUCKETS`` buckets by crc32.  A bucket's gain is the
log ratio of its smoothed frequencies in a target and in the corpus, in thousandths; gains are one array of fixed size.
A document's weight is the mean gain of its features, and its score adds Gumbel noise drawn by hash of its id, so the
highest scores are a sample without replacement in proportion to the weights' exponentials.

Which scores are among the k highest is settled by weighted median of medians: every task gives the median key of what
it has left, weighted by how many rows these are; the weighted median of those is the pivot, and one pass counts the rows
on both sides of it and takes the medians of both.  At least an eighth of the rows left goes each time, until the cutoff
key is exact.  Only the winners are sorted, by ranges.

Keys are (score, id), higher scores first, then smaller ids; null ids come last.  Rows equal in both (repeated ids) go by
weight and features, then any way; exactly k rows are drawn.  Texts that are null or have no words have weight 0.  An
empty corpus gives an empty result, an empty target gains that only depend on the corpus.  Other columns don't matter,
whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.operators.ordered import ranked

from .common import Rounds, bounded_batches, each_text, give_back, slices, written
from .wordhash import Alphabet, Words, _lower, buffers, words

BUCKETS = 10_000
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
#: Rows left that are sorted at once instead of being halved again.
FEW = 4096
#: Bytes of a word that are hashed for all words at once; longer ones are hashed one by one.
LONG = 64

#: Words are letters A-Z (folded), digits and all that is beyond ASCII.
WORDS = Alphabet(np.array([b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)]), _lower())

_LAST_ID = (1 << 63) - 1


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of data[start:end] of every range, each after the bytes whose crc32 is ``before``."""
    size = end - start
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    s, length = start[order], size[order]
    crc = (np.zeros(len(s), np.uint32) if before is None else before[order]) ^ np.uint32(0xFFFFFFFF)
    longer = np.searchsorted(-np.minimum(length, LONG + 1), -np.arange(LONG + 1), "left").tolist()  # how many have more than k bytes
    long = longer[LONG]
    for k in range(LONG):
        m = longer[k]
        if m == long:
            break
        part = crc[long:m]
        crc[long:m] = _CRC[(part ^ data[s[long:m] + k]) & np.uint32(0xFF)] ^ part >> np.uint32(8)
    for i in range(long):
        crc[i] = zlib.crc32(data[s[i] : s[i] + length[i]].tobytes(), int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty(len(s), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _features(texts: pa.Array, run: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """(words, text numbers, buckets) of all runs, one run length after the other."""
    raw, offsets = buffers(texts)
    w = words(raw, offsets, WORDS)
    data = WORDS.fold[raw]
    text = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
    crc = crc32(data, w.start, w.end)
    yield w, text, crc % np.uint32(BUCKETS)
    space = np.array([32], np.uint8)
    for k in range(1, run):
        first = np.arange(max(0, len(text) - k))
        first = first[text[first] == text[first + k]] if len(first) else first
        joined = crc32(space, np.zeros(len(first), np.int64), np.ones(len(first), np.int64), crc[first])
        joined = crc32(data, w.start[first + k], w.end[first + k], joined)
        crc = np.zeros(len(crc), np.uint32)
        crc[first] = joined
        yield w, text[first], joined % np.uint32(BUCKETS)


def bucket_counts(df: DataFrame, run: int = 1, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket; each task sends one row a bucket at most."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in it:
            for at, to in slices(b.column(0)):
                for _, _, bucket in _features(b.column(0).slice(at, to - at), run):
                    total += np.bincount(bucket, minlength=BUCKETS)
        b = None
        give_back()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = bounded_batches(df).select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(batches, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's ratio of frequencies, one added to every bucket."""
    s, t = corpus.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _noise(ids: pa.Array, seed: int) -> np.ndarray:
    draws = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:4] for i in ids.to_pylist()]
    h = np.frombuffer(b"".join(draws), ">u4").astype(float)
    return np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 2024, run: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""

    def work(ids: pa.Array, texts: pa.Array) -> Iterable[pa.RecordBatch]:
        n_words = n = total = np.zeros(len(texts), np.int64)
        for w, text, bucket in _features(texts, run):
            n_words = np.diff(w.bounds)
            n = n + np.bincount(text, minlength=len(texts))
            sums = np.concatenate([[0], np.cumsum(gain[bucket])])
            at = np.searchsorted(text, np.arange(len(texts) + 1))
            total = total + sums[at[1:]] - sums[at[:-1]]
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        columns = [ids, *map(pa.array, (n_words, n, weight, weight + _noise(ids, seed)))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    return each_text(docs, "doc_id long, n_words long, n_features long, weight long, score long", work, id_col, text_col)


def weighted_median(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> tuple[int, int]:
    """The pair (a, b) at which half of the sizes lie on either side."""
    order = np.lexsort((b, a))
    k = int(np.searchsorted(np.cumsum(size[order]), size.sum() / 2, "left"))
    return int(a[order][k]), int(b[order][k])


def _median_pass(keys: DataFrame, pivot: tuple[int, int] | None) -> dict[str, np.ndarray]:
    """A row a task: how many keys lie below the pivot and at it, and the median of those below and of those above (of
    all, without a pivot) with their numbers.  A task's median is the weighted median of its batches'."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        equal = 0
        for batch in it:
            a, b = (c.to_numpy() for c in batch.columns)
            if pivot is None:
                below = np.zeros(len(a), bool)
                above = ~below
            else:
                same = (a == pivot[0]) & (b == pivot[1])
                below = ((a < pivot[0]) | (a == pivot[0]) & (b < pivot[1])) & ~same
                above = ~below & ~same
                equal += int(same.sum())
            for side, rows in zip(sides, (below, above), strict=True):
                if rows.any():
                    x, y = a[rows], b[rows]
                    side.append((*weighted_median(x, y, np.ones(len(x), np.int64)), len(x)))
        out: list[int] = []
        for side in sides:
            each = np.array(side, np.int64).reshape(-1, 3)
            out += [*(weighted_median(*each.T) if len(each) else (0, 0)), int(each[:, 2].sum())]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*out, equal)], _PASS)

    found = keys.mapInArrow(batches, ", ".join(f"{c} long" for c in _PASS)).toArrow()  # a row a task
    return {c: found.column(c).to_numpy() for c in _PASS}


_PASS = ["below_a", "below_b", "below_n", "above_a", "above_b", "above_n", "equal"]


def cutoff(keys: DataFrame, k: int) -> tuple[int, int]:
    """The k-th smallest of the pairs (a, b), 1 <= k <= rows; ``keys`` is a written table of two columns without nulls."""
    rounds = Rounds(keys.sparkSession, "resample-left")
    seen = _median_pass(keys, None)
    left = wrote = int(seen["above_n"].sum())
    side = "above"
    while left > FEW:
        some = seen[f"{side}_n"] > 0
        pivot = weighted_median(*(seen[f"{side}_{c}"][some] for c in "abn"))
        seen = _median_pass(keys, pivot)
        below, equal = int(seen["below_n"].sum()), int(seen["equal"].sum())
        if below < k <= below + equal:
            return pivot
        beyond = (F.col("a") < pivot[0]) | (F.col("a") == pivot[0]) & (F.col("b") < pivot[1])
        if k <= below:
            side, left = "below", below
        else:
            side, left, k = "above", left - below - equal, k - below - equal
            beyond = (F.col("a") > pivot[0]) | (F.col("a") == pivot[0]) & (F.col("b") > pivot[1])
        keys = keys.where(beyond)
        if 4 * left < wrote:  # what is left is written anew when it has shrunk so far, so all rounds together read a few times the rows
            keys, wrote = rounds.written(keys), left
    few = keys.toArrow()  # FEW rows at most
    a, b = few.column("a").to_numpy(), few.column("b").to_numpy()
    at = np.lexsort((b, a))[k - 1]
    return int(a[at]), int(b[at])


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, run: int = 1, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row: of those of ``least_words`` words or more, ``percent`` per
    cent with the highest scores are drawn and ranked from 1; the others have no rank."""
    gain = gains(bucket_counts(docs, run, text_col), bucket_counts(target, run, target_text_col))
    rows = written(scored(docs, gain, seed, run, id_col, text_col).withColumn("a", -F.col("score")).withColumn("b", F.coalesce("doc_id", F.lit(_LAST_ID))), "resample-scores")
    able = F.col("n_words") >= least_words
    k = percent * rows.where(able).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    a, b = cutoff(rows.where(able).select("a", "b"), k)
    won = able & ((F.col("a") < a) | (F.col("a") == a) & (F.col("b") <= b))
    winners = ranked(rows.where(won), [F.col("a"), F.col("b"), F.desc("weight"), F.desc("n_features")])
    winners = winners.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).cast("long").alias("rank"))
    return winners.unionByName(rows.where(~won).select(*columns, F.lit(None).cast("long").alias("rank")))
