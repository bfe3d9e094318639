"""Fill-in-middle transformation on a learned rank index.

A text is cut between its units (code points), drawn by hash of the id; the middle piece goes to the end behind marks.
Cuts are numbers of units while texts are UTF-8 bytes, so the byte offset of a unit is looked up in a learned index:
line segments fitted to all boundary offsets with an error of ``ERROR`` bytes at most (a cone that narrows with each
boundary, a new segment where it closes), and for every boundary the residual, one byte, between the line and the truth.
A cut is predicted by its segment and corrected by its residual, so it is exact.  An index covers all texts of a slice
and is fitted some ``CHUNK`` bytes at a time; nothing but the residuals grows with a text.

Null texts are empty; an empty text, and one that holds a mark already, stays as it is (form ``plain``).  A null id draws
as ''.  Rows that repeat give equal rows.  Empty tables give empty results; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_text
from .wordhash import buffers

#: Bytes that a segment's line may be off; residuals are single bytes.
ERROR = 100
#: Bytes of text whose boundaries are fitted at once, and boundaries that a segment is tried on first.
CHUNK, STEP = 1 << 20, 4096
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def _segments(y: np.ndarray) -> tuple[list[int], list[float]]:
    """(first boundary, slope) of each segment: the line from its first boundary is ``ERROR`` off at most at each other."""
    starts, slopes = [], []
    s, n = 0, len(y)
    while s < n:
        lo, hi, at, step = -np.inf, np.inf, s + 1, STEP
        while at < n:
            to = min(n, at + step)
            x, dy = np.arange(at - s, to - s), (y[at:to] - y[s]).astype(float)
            low = np.maximum(np.maximum.accumulate((dy - ERROR) / x), lo)
            high = np.minimum(np.minimum.accumulate((dy + ERROR) / x), hi)
            closed = low > high
            k = int(closed.argmax()) if closed[-1] else len(x)
            if k:
                lo, hi = float(low[k - 1]), float(high[k - 1])
            at += k
            if k < len(x):
                break
            step *= 2
        starts.append(s)
        slopes.append((lo + hi) / 2 if at > s + 1 else 0.0)
        s = at
    return starts, slopes


@dataclass
class RankIndex:
    """Byte offset of every unit boundary of some texts that follow each other, by segments and residuals."""

    starts: np.ndarray
    offsets: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, bounds: np.ndarray) -> tuple[RankIndex, np.ndarray]:
        """The index of the texts between ``bounds``, and the number of the boundary at each of these."""
        starts, offsets, slopes, residuals, ranks = [], [], [], [], np.zeros(len(bounds), np.int64)
        before = 0
        for at in range(0, len(raw) + 1, CHUNK):
            part = raw[at : at + CHUNK]
            y = np.flatnonzero((part & 0xC0) != 0x80) + at
            if at + CHUNK > len(raw):
                y = np.append(y, len(raw))
            here = slice(np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at + CHUNK, "left"))
            ranks[here] = before + np.searchsorted(y, bounds[here])
            first, slope = _segments(y)
            first, slope = np.array(first, np.int64), np.array(slope)
            which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(y))))
            line = y[first][which] + np.floor(slope[which] * (np.arange(len(y)) - first[which])).astype(np.int64)
            residuals.append((y - line).astype(np.int8))
            starts.append(first + before)
            offsets.append(y[first])
            slopes.append(slope)
            before += len(y)
        return cls(*(np.concatenate(x) for x in (starts, offsets, slopes, residuals))), ranks

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """Byte offsets of boundaries given by number."""
        k = np.searchsorted(self.starts, ranks, "right") - 1
        return self.offsets[k] + np.floor(self.slopes[k] * (ranks - self.starts[k])).astype(np.int64) + self.residuals[ranks]


def _draws(ids: pa.Array, seed: int) -> np.ndarray:
    """Four unsigned 32-bit draws for each id."""
    digests = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids.to_pylist()]
    return np.frombuffer(b"".join(digests), ">u4").astype(np.int64).reshape(-1, 4)


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, suffix_first: int = 20, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    ``rate`` per cent of the texts are cut, of these ``suffix_first`` per cent become suffix, prefix, middle (``spm``), the
    others prefix, suffix, middle (``psm``).  Lengths are in code points and null where the text stays ``plain``."""
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in marks)

    def work(ids: pa.Array, texts: pa.Array) -> Iterable[pa.RecordBatch]:
        raw, bounds = buffers(texts)
        index, ranks = RankIndex.of(raw, bounds)
        n = np.diff(ranks)
        h = _draws(ids, seed)
        one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        prefix, middle = np.minimum(one, two), np.abs(one - two)
        first, second = index.locate(ranks[:-1] + prefix), index.locate(ranks[:-1] + prefix + middle)
        data = raw.tobytes()
        form, out = [], []
        for a, b, p, q, cut, spm in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first.tolist(), second.tolist(), (h[:, 2] % 100 < rate).tolist(), (h[:, 3] % 100 < suffix_first).tolist(), strict=True):
            if not cut or a == b or any(data.find(m, a, b) >= 0 for m in (prefix_mark, suffix_mark, middle_mark)):
                form.append("plain")
                out.append(data[a:b])
            elif spm:
                form.append("spm")
                out.append(b"".join((suffix_mark, data[q:b], prefix_mark, data[a:p], middle_mark, data[p:q])))
            else:
                form.append("psm")
                out.append(b"".join((prefix_mark, data[a:p], suffix_mark, data[q:b], middle_mark, data[p:q])))
        plain = np.array([f == "plain" for f in form], bool)
        columns = [ids, pa.array(n), pa.array(form, pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return each_text(docs, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", work, id_col, text_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made of.  Pieces hold no mark, so the first ones of each kind are the cuts."""
    prefix, suffix, middle = (re.escape(m) for m in marks)
    psm = F.split(output.substr(F.lit(len(marks[0]) + 1), F.length(output)), f"{suffix}|{middle}")
    spm = F.split(output.substr(F.lit(len(marks[1]) + 1), F.length(output)), f"{prefix}|{middle}")
    return F.when(form == "psm", F.concat(F.get(psm, 0), F.get(psm, 2), F.get(psm, 1))).when(form == "spm", F.concat(F.get(spm, 1), F.get(spm, 2), F.get(spm, 0))).otherwise(output)
