"""Toxicity by compression distance.

There are two zstandard dictionaries: one trained on windows of ordinary text, and one that holds, as raw content, every
window that occurs in toxic documents far more often than in ordinary ones.  A window (one word with the spaces around it) is compressed twice, against
'ordinary + more ordinary' and against 'ordinary + toxic' text of equal sizes; the bytes that the toxic half saves are
its distance.  Bytes are too coarse for short windows, so each byte is first spelt as a fixed three-byte code, which
triples what a match can save.  A logistic curve over a document's distances, fitted on labelled documents that the
dictionaries have not seen, turns them into a score.

Only a bounded sample of labelled rows is learned from (``SAMPLE`` rows of either label, by hash order); every whole
text is scored.  Null or empty texts have no windows and get the curve's value for none.  Rows without a toxic label
don't teach; without both labels in the sample every score is 0.  Null ids and repeated rows are kept.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_slice, each_text, held_out, sampled_texts
from .wordhash import LETTERS, buffers, mix, words

#: Labelled rows of either label that are learned from.
SAMPLE = 3_000
#: Bytes of the ordinary dictionary, and the compression level.  The toxic one holds every toxic window.
ORDINARY_BYTES, LEVEL = 112_000, 13
#: A toxic window's count lies this many standard deviations above what its ordinary rate gives, or so many times the
#: root of the toxic documents if that is more; and it occurs in so many of them, near copies of one counted once.
CONTRAST, CONTRAST_ROOT, LEAST = 4.0, 0.5, 3
#: A document is called toxic from this score on.
THRESHOLD = 0.3
#: Distances of this many bytes and more count as hits.
HIT = 9
#: Window distances that a worker remembers.
REMEMBERED = 150_000

_CODES = np.random.default_rng(7).integers(0, 256, (256, 3), dtype=np.uint8)


def _spell(window: bytes) -> bytes:
    return _CODES[np.frombuffer(window, np.uint8)].tobytes()


@dataclass
class Model:
    """Contents of both dictionaries and the weights of the curve (bias, largest distance, hits, log of words)."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def compressors(self):
        import zstandard as z

        out = []
        for content in (self.ordinary, self.toxic):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out


class Distances:
    """Distances of windows by word hash, remembered up to ``REMEMBERED``."""

    def __init__(self, model: Model):
        self._ordinary, self._toxic = model.compressors()
        self._known: dict[int, int] = {}

    def of(self, window: bytes) -> int:
        x = _spell(window)
        return len(self._ordinary.compress(x)) - len(self._toxic.compress(x))

    def features(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text: largest distance, share of hits on a log scale, words on a log scale."""
        w = words(raw, offsets, LETTERS)
        n = len(offsets) - 1
        out = np.zeros((n, 3))
        if not len(w.hashes):
            return out
        distinct, first, where = np.unique(w.hashes, return_index=True, return_inverse=True)
        known, folded = self._known, LETTERS.fold[raw].tobytes()
        if len(known) > REMEMBERED:
            known.clear()
        found = np.empty(len(distinct))
        starts, ends = w.start[first].tolist(), w.end[first].tolist()
        for i, h in enumerate(distinct.tolist()):
            d = known.get(h)
            if d is None:
                known[h] = d = self.of(b" " + folded[starts[i] : ends[i]] + b" ")
            found[i] = d
        each = found[where]
        full = np.flatnonzero(np.diff(w.bounds))
        out[full, 0] = np.clip(np.maximum.reduceat(each, w.bounds[full]), 0, 16)
        out[full, 1] = np.log1p(np.add.reduceat((each >= HIT).astype(float), w.bounds[full]))
        out[:, 2] = np.log1p(np.diff(w.bounds))
        return out


def _windows(text: str) -> set[bytes]:
    raw = np.frombuffer(text.encode(), np.uint8)
    w = words(raw, np.array([0, len(raw)]), LETTERS)
    folded = LETTERS.fold[raw].tobytes()
    return {folded[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)}


def _samples(counts: dict[bytes, int], n: int, seed: int) -> list[bytes]:
    """Lines of four windows, drawn as often as they occur."""
    names = sorted(counts)
    p = np.array([counts[x] for x in names], float)
    drawn = np.random.default_rng(seed).choice(len(names), (n, 4), p=p / p.sum())
    return [b" " + b" ".join(names[k] for k in row) + b" " for row in drawn.tolist()]


def _dictionary(samples: list[bytes], size: int, **how) -> bytes:
    """The content of a trained dictionary; the samples themselves where they are too few to train on."""
    import zstandard as z

    try:
        content = z.train_dictionary(size, samples, level=LEVEL, **how).as_bytes()
        return content[-max(1, size - 150) :]  # without the tables ahead of it
    except z.ZstdError:
        return b"".join(samples)[:size]


class _Copies:
    """Which of the documents met so far are near copies (four fifths of all windows in common) of an earlier one."""

    def __init__(self):
        self._by_key: dict[tuple, list[np.ndarray]] = {}

    def met(self, windows: set[bytes]) -> bool:
        h = np.unique(np.array([zlib.crc32(x) for x in windows], np.uint64))
        keys = [(k, *np.sort(mix(h + np.uint64(k << 32)))[:4].tolist()) for k in range(4)]
        for key in keys:
            for other in self._by_key.get(key, ()):
                common = len(np.intersect1d(h, other, assume_unique=True))
                if 5 * common >= 4 * (len(h) + len(other) - common):
                    return True
        for key in keys:
            self._by_key.setdefault(key, []).append(h)
        return False


def train(rows: list[tuple[int, str, int]]) -> Model | None:
    """Fit on (id, text, label) rows: dictionaries on even checksums of the id, the curve on odd ones."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    docs: Counter = Counter()
    rest: list[tuple[str, int]] = []
    copies = _Copies()
    for i, text, label in rows:
        if zlib.crc32(f"half {i}".encode()) % 2:
            rest.append((text or "", label))
        else:
            windows = _windows(text or "")
            if not label or not copies.met(windows):
                seen[label].update(windows)
                docs[label] += 1
    if not docs[0] or not docs[1] or not any(label for _, label in rest):
        return None
    toxic = {}
    contrast = max(CONTRAST, CONTRAST_ROOT * math.sqrt(docs[1]))
    for w, c in seen[1].items():
        expected = (seen[0][w] + 0.5) * docs[1] / docs[0]
        if c >= LEAST and (c - expected) / math.sqrt(expected + 0.1) > contrast:
            toxic[w] = c
    if not toxic or not seen[0]:
        return None
    ordinary = _dictionary(_samples(seen[0], 60_000, 1), ORDINARY_BYTES, k=32, d=6)
    hostile = b" " + b" ".join(sorted(toxic, key=lambda w: (toxic[w], w))) + b" "
    more = b"".join(_samples(seen[0], max(3_000, len(hostile) // 4), 2))[: len(hostile)]
    model = Model(_spell(more + ordinary), _spell(hostile + ordinary), np.zeros(4))
    del seen, toxic
    distances = Distances(model)
    parts = [distances.features(*buffers(pa.array([t for t, _ in rest[k : k + 200]], pa.large_string()))) for k in range(0, len(rest), 200)]
    model.weights = _logistic(np.concatenate(parts), np.array([float(label) for _, label in rest]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a light ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, size: int = SAMPLE) -> list[tuple[int, str, int]]:
    """At most ``size`` (id, text, label) training rows of label 0 and of label 1, by hash order of the id, of at most
    ``common.SAMPLE_BYTES`` in all."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label")).distinct()
    chosen = [known.where(F.col("__label") == v).orderBy(F.xxhash64("__id"), "__id").limit(size) for v in (0, 1)]
    return sampled_texts(docs, chosen[0].unionByName(chosen[1]), [F.col("doc_id") == F.col("__id")], size)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    held: list[Distances] = []

    def work(ids: pa.Array, texts: pa.Array) -> Iterable[pa.RecordBatch]:
        if model is None:
            values = np.zeros(len(ids))
        else:
            if not held:
                held.append(Distances(model))
            x = np.column_stack([np.ones(len(ids)), held[0].features(*buffers(texts))])
            values = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(values), pa.array((values >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return each_text(docs, "doc_id long, score double, predicted int", work, id_col, text_col)


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, all columns unchanged; one pass, no join."""
    if model is None:
        return docs
    held: list[Distances] = []

    def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        if not held:
            held.append(Distances(model))
        x = np.column_stack([np.ones(len(texts)), held[0].features(*buffers(texts))])
        return rows.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))) < threshold))

    return each_slice(docs, text_col, work)
