"""Variants of abutting base windows, arriving as shards, re-windowed as a stream.

Genomic position is event time and the chromosome the key.  Two stateful steps follow each other:

1. :class:`Progress`, keyed by chromosome, sees only marks (a base window was seen) and ends.  It keeps how far the
   chromosome is complete: the highest start of a base window, since windows below it can't receive more.  When that
   moves, it sends a closing to the blocks in between, and to no others.  A chromosome that stays silent for ``idle``
   milliseconds ends by a timer.
2. :class:`Rewindow`, keyed by (chrom, block), a block being a run of ``block`` window starts, holds variants by window in
   a map state: a batch adds one part to each window that it brings variants for, and only the windows that a closing
   completes are read, once, and removed.  So a batch costs what it brings and what it completes, whatever is held.
   A variant goes to every block that has a window holding it: a hot chromosome is many keys and no key's state grows
   with its length.

A chromosome's end closes all its blocks.  Rows for windows already emitted come out flagged as late, without a window.
A finished block keeps one number, from which late rows are known; a job that never ends can let it expire after
``remember`` milliseconds of processing time.

:func:`without_duplicates` keeps what it has seen in blocks as well, and drops a block when the chromosome has passed it.

The batch twin is :func:`isoloom.operators.variants.rewindowed`; with first starts at 0 both give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from isoloom.operators import intervals

#: Rows of the input stream; kind is variant, mark (a base window was seen) or end (the chromosome is complete).
INPUT = "chrom string, start long, end long, pos long, ref string, alt string, kind string"
OUTPUT = "chrom string, start long, end long, pos long, ref string, alt string, in_window_idx long, late boolean"
_COLUMNS = ["pos", "ref", "alt", "span_start", "span_end"]
_CLOSING = "chrom string, block long, closed long, ended boolean"


class Progress(StatefulProcessor):
    """How far each chromosome is complete; closings for the blocks that this move completes windows of."""

    def __init__(self, window: int, stride: int, block: int, idle: int | None = None):
        self.window, self.span, self.idle = window, stride * block, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reach = handle.getValueState("reach", "closed long, highest long")

    def _closings(self, key, before: int, closed: int, highest: int, ended: bool) -> pd.DataFrame:
        # windows that end in (before, closed] are complete now, and at the end all that can exist
        first, last = max(0, before - self.window) // self.span, (highest if ended else max(0, closed - self.window)) // self.span
        blocks = range(first, last + 1)
        return pd.DataFrame({"chrom": [key[0]] * len(blocks), "block": list(blocks), "closed": closed, "ended": ended})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        closed, highest = map(int, self.reach.get()) if self.reach.exists() else (0, 0)
        before, ended = closed, False
        for part in rows:
            closed, highest = max(closed, int(part["start"].max())), max(highest, int(part["end"].max()))
            ended |= bool((part["kind"] == "end").any())
        self.reach.update((closed, highest))
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if not ended:
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle)
        yield self._closings(key, before, closed, highest, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The chromosome was silent for so long that no more is expected."""
        closed, highest = map(int, self.reach.get())
        yield self._closings(key, closed, closed, highest, True)

    def close(self) -> None:
        pass


class Rewindow(StatefulProcessor):
    """Holds a block's variants by window until the window is complete."""

    def __init__(self, window: int, stride: int, block: int, remember: int | None = None):
        self.window, self.stride, self.block, self.remember = window, stride, block, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "start long, part int", "rows string")
        self.next = handle.getValueState("next", "start long")
        self.done = handle.getValueState("done", "start long", self.remember)

    def _add(self, fresh: pd.DataFrame, first: int, beyond: int) -> None:
        """One more part for each window from ``first`` on that has some of these variants, copies told once."""
        fresh = fresh.drop_duplicates(_COLUMNS)
        at = fresh["span_start"].to_numpy(np.int64)
        high = np.minimum(at // self.stride * self.stride, beyond - self.stride)
        for k in range(-(-self.window // self.stride)):
            start = high - k * self.stride
            inside = (start >= first) & (at < start + self.window)
            for s in np.unique(start[inside]).tolist():
                part = 0
                while self.held.containsKey((s, part)):
                    part += 1
                rows = fresh.loc[inside & (start == s), _COLUMNS]
                self.held.updateValue((s, part), (json.dumps(rows.astype({"pos": int, "span_start": int, "span_end": int}).values.tolist()),))

    def _take(self, start: int) -> list[list]:
        """The variants of a window, in order, each once; they are held no longer."""
        rows: set[tuple] = set()
        part = 0
        while self.held.containsKey((start, part)):
            rows.update(map(tuple, json.loads(self.held.getValue((start, part))[0])))
            self.held.removeKey((start, part))
            part += 1
        return sorted(rows, key=lambda v: (v[3], v[4], v[0], v[1], v[2]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        chrom, block = key[0], int(key[1])
        new = pd.concat(list(rows), ignore_index=True)
        first = block * self.block * self.stride
        beyond = first + self.block * self.stride
        start = int(self.done.get()[0]) if self.done.exists() else int(self.next.get()[0]) if self.next.exists() else first
        fresh, closings = new[new["pos"].notna()], new[new["pos"].isna()]
        gone = (fresh["span_start"] < start) | (start >= beyond)
        out = [(chrom, None, None, int(p), r, a, None, True) for p, r, a in fresh.loc[gone, _COLUMNS[:3]].itertuples(index=False, name=None)]
        self._add(fresh[~gone], start, beyond)
        ended = bool(len(closings)) and bool(closings["ended"].any())
        closed = beyond + self.window if ended else int(closings["closed"].max()) if len(closings) else -1
        while start < beyond and start + self.window <= closed:
            taken = -1
            for pos, ref, alt, s, e in self._take(start):
                if s >= taken:
                    out.append((chrom, start, start + self.window, pos, ref, alt, pos - start, False))
                    taken = e
            start += self.stride
        if start >= beyond:
            self.next.clear()
            self.done.update((start,))
        else:
            self.next.update((start,))
        if out:
            names = ["chrom", "start", "end", "pos", "ref", "alt", "in_window_idx", "late"]
            yield pd.DataFrame(out, columns=names).astype({"start": "Int64", "end": "Int64", "in_window_idx": "Int64"})

    def close(self) -> None:
        pass


class Once(StatefulProcessor):
    """Lets each variant of a block of positions through once; forgets the block when its chromosome has passed it.

    What was seen is held by stretches of ``stretch`` positions, a row of state each, so a batch reads and writes a row for
    each stretch that it touches, however many variants it brings there."""

    def __init__(self, span: int, stretch: int, remember: int | None = None):
        self.span, self.stretch, self.remember = span, stretch, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "stretch long", "variants string")
        self.done = handle.getValueState("done", "at long", self.remember)

    def _first(self, variants: list[tuple], keep: bool) -> list[tuple]:
        """Those of these distinct variants that weren't seen; to ``keep`` the block is to count them as seen."""
        out, by = [], {}
        for v in variants:
            by.setdefault(v[0] // self.stretch, []).append(v)
        for k, some in by.items():
            held = set(map(tuple, json.loads(self.seen.getValue((k,))[0]))) if self.seen.containsKey((k,)) else set()
            new = [v for v in some if v not in held]
            if new and keep:
                self.seen.updateValue((k,), (json.dumps([*held, *new]),))
            out += new
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        chrom, beyond = key[0], (int(key[1]) + 1) * self.span
        new = pd.concat(list(rows), ignore_index=True)
        fresh, closings = new[new["pos"].notna()], new[new["pos"].isna()]
        variants = [(int(p), r, a) for p, r, a in fresh[_COLUMNS[:3]].drop_duplicates().itertuples(index=False, name=None)]
        passed = bool(len(closings)) and (bool(closings["ended"].any()) or int(closings["closed"].max()) >= beyond)
        late, first = (variants, []) if self.done.exists() else ([], self._first(variants, not passed))
        if passed:
            self.seen.clear()
            self.done.update((beyond,))
        if variants:
            yield pd.DataFrame([(chrom, *v, False) for v in first] + [(chrom, *v, True) for v in late], columns=["chrom", "pos", "ref", "alt", "late"])

    def close(self) -> None:
        pass


def _closings(stream: DataFrame, window: int, stride: int, block: int, mode: str, idle: int | None) -> DataFrame:
    marks = stream.where("kind <> 'variant'").select("chrom", "start", "end", "kind")
    return marks.groupBy("chrom").transformWithStateInPandas(Progress(window, stride, block, idle), _CLOSING, outputMode="Append", timeMode=mode)


def _mode(*times: int | None) -> str:
    return "None" if all(t is None for t in times) else "ProcessingTime"


def rewindowed(stream: DataFrame, window: int, stride: int, block: int = 64, remember: int | None = None, idle: int | None = None) -> DataFrame:
    """The stream of re-windowed variants; late ones come flagged.  Needs the RocksDB state store.

    With ``remember`` or ``idle`` the job needs a trigger that goes on: both run on processing time, so it is never done."""
    mode = _mode(remember, idle)
    at = F.col("pos") - 1
    span = F.when(F.length("ref") < F.length("alt"), F.lit(1)).otherwise(F.length("ref"))
    blocks = F.array_distinct(F.transform(intervals.tiles_of(at, window, stride), lambda s: F.floor(s / F.lit(stride * block)).cast("long")))
    variants = stream.where("kind = 'variant'").select("chrom", F.explode(blocks).alias("block"), "pos", "ref", "alt", at.alias("span_start"), (at + span).alias("span_end"))
    keyed = variants.unionByName(_closings(stream, window, stride, block, mode, idle), allowMissingColumns=True)
    return keyed.groupBy("chrom", "block").transformWithStateInPandas(Rewindow(window, stride, block, remember), OUTPUT, outputMode="Append", timeMode=mode)


def without_duplicates(stream: DataFrame, span: int = 1 << 16, remember: int | None = None, idle: int | None = None, stretch: int | None = None) -> DataFrame:
    """(chrom, pos, ref, alt, late): exact variants once, whichever shards bring them.

    What was seen is kept by blocks of ``span`` bases until their chromosome is complete beyond them or ends, so state
    follows the open blocks; a row of state holds ``stretch`` bases, a 64th of a block if not given.  Variants of a block that is gone come flagged as late, since nothing tells whether they are
    new.  Needs the RocksDB state store."""
    mode = _mode(remember, idle)
    block = F.floor((F.col("pos") - 1) / F.lit(span)).cast("long").alias("block")
    variants = stream.where("kind = 'variant'").select("chrom", block, "pos", "ref", "alt")
    keyed = variants.unionByName(_closings(stream, 0, span, 1, mode, idle), allowMissingColumns=True)
    return keyed.groupBy("chrom", "block").transformWithStateInPandas(Once(span, stretch or max(1, span // 64), remember), "chrom string, pos long, ref string, alt string, late boolean", outputMode="Append", timeMode=mode)


def type_counts(stream: DataFrame) -> DataFrame:
    """Running counts by variant type, for update or complete mode."""
    kind = F.when(F.length("ref") < F.length("alt"), "INS").when(F.length("ref") > F.length("alt"), "DEL").otherwise("SNP")
    return stream.where("kind = 'variant'").groupBy(kind.alias("var_type")).agg(F.count(F.lit(1)).alias("n"))
