"""Benchmark decontamination: counted words and word pairs as seeds, then Smith-Waterman alignment.

A passage leaks if its alignment with a test item (match 2, mismatch -1, gap -1 on words) reaches ``LEAK`` of a full
copy's score.  An alignment of m words in k unbroken runs has m of the item's words and m - k of its pairs of
neighbours, and scores m + (m - k) + 1 at most.  So a leak lacks at most a known number of the item's words and pairs,
and any larger choice of them holds some that it has.  One pass over the corpus counts in how many documents each
occurs; the choice is the rarest ones, with so many more that ``EXTRA`` of the needed ones must be found close together.
A second pass aligns each item with the passages around such places, wide enough for every gap that a leak can have: no
leak is lost, wherever and however it is edited.

Test items are the stated query set: they travel to the tasks in blocks of at most ``BLOCK_BYTES`` of text, each block
two passes over all documents.  Documents never leave their task and nothing of the corpus is shuffled but the counts.

Words are runs of letters, marks and digits, ASCII case folded; ideographs and kana are words by themselves.  Items and
texts that are null or have no words match nothing; an item shorter than ``SHORT`` words leaks only whole.  Repeated
documents, and items that share an id, give a row each.  Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_slice, each_text, written
from .wordhash import ALNUM, buffers, mix, words

#: Items of fewer words must occur whole; the share of a full copy's score that is a leak.
SHORT, LEAK = 3, 0.5
#: Share of the words and pairs that a leak needs which must be found among the seeds; any value loses no leak.
EXTRA = 0.25
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of test items in the tasks at once.
BLOCK_BYTES = 4 << 20
#: Words of passages compared with their items at once, and words of a strip of a passage that is aligned.
COMPARED, STRIP = 1 << 20, 1 << 15
#: Places of seeds in texts that are worked through at once.
SPREAD = 1 << 20

#: Words of what is counted and looked for.
SIZES = (1, 2)

_U = np.uint64
_FILTER = 1 << 22


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    run = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        run = mix(run * _U(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - size + 1 + k])
    return run


@dataclass
class Items:
    """Test items as word hashes, and their words and pairs: sorted distinct hashes with the (item, place) entries of each."""

    ids: list
    hashes: list[np.ndarray]
    grams: np.ndarray
    entry_bounds: np.ndarray
    entry_item: np.ndarray
    entry_place: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        raw, offsets = buffers(pa.array([t or "" for _, t in rows], pa.large_string()))
        w = words(raw, offsets, ALNUM)
        hashes = [w.hashes[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
        gram, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, h in enumerate(hashes):
            for size in SIZES:
                g = _grams(h, size)
                gram.append(g)
                item.append(np.full(len(g), i))
                place.append(np.arange(len(g)))
        gram = np.concatenate(gram)
        order = np.argsort(gram, kind="stable")
        distinct, first = np.unique(gram[order], return_index=True)
        return cls([i for i, _ in rows], hashes, distinct, np.append(first, len(gram)), np.concatenate(item)[order], np.concatenate(place)[order])

    def seeds(self, documents: np.ndarray, leak: float) -> Seeds:
        """The seeds among the (item, place) entries, given in how many documents each word and pair occurs."""
        gram_of = np.repeat(np.arange(len(self.grams)), np.diff(self.entry_bounds))
        order = np.lexsort((self.entry_place, self.grams[gram_of], documents[gram_of], self.entry_item))  # rarest first
        entries = np.bincount(self.entry_item, minlength=len(self.hashes))
        need = np.array([needed(len(h), leak) for h in self.hashes], np.int64)
        least = np.maximum(1, (EXTRA * need).astype(np.int64))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(entries) - entries, entries)
        chosen = np.zeros(len(gram_of), bool)
        chosen[order[rank < (entries - need + least)[self.entry_item[order]]]] = True  # a leak lacks entries - need at most
        one = np.array([len(h) == 1 for h in self.hashes], bool)[self.entry_item]
        return Seeds(self._table(gram_of, chosen & ~one), self._table(gram_of, chosen & one), least)

    def _table(self, gram_of: np.ndarray, chosen: np.ndarray) -> Table:
        gram, bounds = np.unique(gram_of[chosen], return_index=True)
        return Table(self.grams[gram], np.append(bounds, int(chosen.sum())), self.entry_item[chosen], self.entry_place[chosen])

    def table(self) -> Table:
        """All words and pairs with all their entries."""
        return Table(self.grams, self.entry_bounds, self.entry_item, self.entry_place)


@dataclass
class Table:
    """Some words and pairs, sorted, and the (item, place) entries of each, sorted by item."""

    grams: np.ndarray
    bounds: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def lookup(self) -> np.ndarray:
        """A bit for each value of the low hash bits that some word or pair has."""
        table = np.zeros(_FILTER, bool)
        table[(self.grams & _U(_FILTER - 1)).astype(np.int64)] = True
        return table

    def hits(self, w, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, numbers), by position: where the texts have one of the words or pairs."""
        at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in SIZES if len(self.grams) else ():
            run = _grams(w.hashes, size)
            place = np.flatnonzero(lookup[(run & _U(_FILTER - 1)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.grams, run[place]), len(self.grams) - 1)
            ok = self.grams[k] == run[place]
            ok &= np.searchsorted(w.bounds, place, "right") == np.searchsorted(w.bounds, place + size - 1, "right")
            at.append(place[ok])
            which.append(k[ok])
        at, which = np.concatenate(at), np.concatenate(which)
        order = np.argsort(at, kind="stable")
        return at[order], which[order]

    def spread(self, w, at: np.ndarray, which: np.ndarray, items: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, entries) of the hits, some ``SPREAD`` at a time: whole texts together, and where one text alone has
        more, its items in ranges.  What a text has of an item is never divided."""
        count = self.bounds[which + 1] - self.bounds[which]
        total = np.cumsum(count)
        ends = np.searchsorted(at, w.bounds[1:])  # hits up to the end of each text
        text = k = 0
        while k < len(at):
            have = total[k - 1] if k else 0
            text = int(np.searchsorted(ends, k, "right"))
            many = np.searchsorted(total[np.maximum(ends[text:], 1) - 1], have + SPREAD, "right")
            to = int(ends[text + max(0, int(many) - 1)])
            parts = -(-int(total[to - 1] - have) // SPREAD)
            cuts = np.linspace(0, items, parts + 1).astype(np.int64) if parts > 1 else (0, items)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield self._entries(at[k:to], which[k:to], int(a), int(b), items)
            k = to

    def _entries(self, at: np.ndarray, which: np.ndarray, a: int, b: int, items: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) == (0, items):
            first, last = self.bounds[which], self.bounds[which + 1]
        else:
            of = np.repeat(np.arange(len(self.grams)), np.diff(self.bounds)) * items + self.item
            first, last = np.searchsorted(of, which * items + a), np.searchsorted(of, which * items + b)
        owner, entry = _ranges(first, last)
        return at[owner], entry


@dataclass
class Seeds:
    """The entries that are seeds, those of one-word items apart, and how many of an item's must be found close together."""

    table: Table
    single: Table
    least: np.ndarray

    def lookups(self) -> tuple[np.ndarray, np.ndarray]:
        return self.table.lookup(), self.single.lookup()


def needed(size: int, leak: float) -> int:
    """How many of the words and pairs of an item of ``size`` words a leak has at least."""
    return 2 * size - 1 if size < SHORT else min(2 * size - 1, max(1, math.ceil(leak * MATCH * size - 1e-9) - 1))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, end in the passage) by Smith-Waterman, a row of the item at a time."""
    j = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        step = np.where(passage == word, MATCH, MISMATCH)
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        row = np.maximum.accumulate(new - GAP * j) + GAP * j  # gaps along the passage
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield sorted((r[0], r[1]) for r in part.collect())


def _counts(docs: DataFrame, items: Items, text_col: str) -> np.ndarray:
    """In how many documents each word and pair occurs."""
    held: list[np.ndarray] = []
    table = items.table()

    def work(ids: pa.Array, texts: pa.Array) -> Iterable[pa.RecordBatch]:
        if not held:
            held.append(table.lookup())
        raw, offsets = buffers(texts)
        w = words(raw, offsets, ALNUM)
        if len(w.hashes):
            at, which = table.hits(w, held[0])
            pairs = np.unique(np.searchsorted(w.bounds, at, "right") * len(items.grams) + which)
            gram, n = np.unique(pairs % len(items.grams), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

    out = np.zeros(len(items.grams), np.int64)
    found = each_text(docs, "gram long, n long", work, None, text_col).groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # a row for each word and pair of the block at most
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out


_SCHEMA = "doc_id long, item_id long, score double, start_word long, end_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", leak: float = LEAK) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): for each document and item that leaks, its best passage.

    ``score`` is the alignment's share of a full copy's score; the words bound the passage searched."""
    out = docs.sparkSession.createDataFrame([], _SCHEMA)
    for rows in _blocks(benchmark, item_col, item_text_col):
        items = Items.of(rows)
        if not len(items.grams):
            continue
        found = _aligned(docs, items, items.seeds(_counts(docs, items, text_col), leak), leak, id_col, text_col)
        out = out.unionByName(found)
    return out


def search(items: Items, seed: Seeds, lookups: tuple[np.ndarray, np.ndarray], texts: pa.Array, leak: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text number, item number, score, first word, last word) of each leak in the texts, each text and item once."""
    raw, offsets = buffers(texts)
    w = words(raw, offsets, ALNUM)
    if not len(w.hashes):
        return
    # an item of one word leaks wherever the word is: its first place in each text
    at, which = seed.single.hits(w, lookups[1])
    text = np.searchsorted(w.bounds, at, "right") - 1
    _, first = np.unique(text * max(1, len(seed.single.grams)) + which, return_index=True)
    for place, entry in seed.single.spread(w, at[np.sort(first)], which[np.sort(first)], len(items.hashes)):
        text = np.searchsorted(w.bounds, place, "right") - 1
        for t, i, p in zip(text.tolist(), seed.single.item[entry].tolist(), (place - w.bounds[text]).tolist(), strict=True):
            yield t, i, 1.0, p, p + 1
    at, which = seed.table.hits(w, lookups[0])
    for place, entry in seed.table.spread(w, at, which, len(items.hashes)):
        yield from _searched(items, seed, w, place, entry, leak)


def _searched(items: Items, seed: Seeds, w, place: np.ndarray, entry: np.ndarray, leak: float) -> Iterator[tuple[int, int, float, int, int]]:
    """The leaks among the places that seeds were found at."""
    text, item = np.searchsorted(w.bounds, place, "right") - 1, seed.table.item[entry]
    order = np.lexsort((place, item, text))
    place, entry, text, item = place[order], entry[order], text[order], item[order]
    size = np.array([len(h) for h in items.hashes])
    gaps = (MATCH * size * (1 - leak) + 1e-9).astype(np.int64)  # more inserted words cost more than a leak can lose
    last = np.arange(len(place)) + seed.least[item] - 1
    near = np.flatnonzero(last < len(place))
    last = last[near]
    near = near[(text[last] == text[near]) & (item[last] == item[near]) & (place[last] - place[near] < (size + gaps)[item[near]])]
    text, item, first = text[near], item[near], place[near] - seed.table.place[entry[near]]
    start = np.maximum(w.bounds[text], first - gaps[item])
    stop = np.minimum(w.bounds[text + 1], first + (size + gaps)[item])
    order = np.lexsort((start, item, text))
    text, item, start, stop = text[order], item[order], start[order], stop[order]
    if not len(text):
        return
    # places that overlap by half an item are one passage
    new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] > stop[:-1] - size[item[1:]] // 2)]
    head, tail = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(new)] - 1
    text, item, start, stop = text[head], item[head], start[head], stop[tail]
    keep = _common(items, w.hashes, item, start, stop) >= np.array([needed(n, leak) for n in size.tolist()])[item]
    best: tuple[int, int, float, int, int] | None = None
    for t, i, a, b in zip(text[keep].tolist(), item[keep].tolist(), start[keep].tolist(), stop[keep].tolist(), strict=True):
        score = _score(items.hashes[i], w.hashes[a:b], int(size[i] + gaps[i]))
        if best is not None and (best[0], best[1]) != (t, i):
            yield best
            best = None
        if score >= leak and (best is None or score > best[2]):
            best = (t, i, score, a - int(w.bounds[t]), b - int(w.bounds[t]))
    if best is not None:
        yield best


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of every position of the ranges."""
    n = np.maximum(stop - start, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[owner]


def _common(items: Items, hashes: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many of its item's words and pairs each passage has; all passages of a part of them at once."""
    out = np.zeros(len(item), np.int64)
    length = np.array([len(h) for h in items.hashes])
    own = [[_grams(h, k) for h in items.hashes] if len(item) > len(items.hashes) else None for k in SIZES]
    work = np.cumsum(stop - start + length[item])
    at = 0
    while at < len(item):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + COMPARED, "right")))
        for k, known in zip(SIZES, own, strict=True):
            grams = [known[i] if known else _grams(items.hashes[i], k) for i in item[at:to].tolist()]
            count = np.array([len(g) for g in grams])
            owner = np.repeat(np.arange(to - at), count)
            whose, place = _ranges(start[at:to], stop[at:to] - k + 1)
            run = _grams(hashes, k)[place] if to - at > 64 else np.concatenate([_grams(hashes[a:b], k) for a, b in zip(start[at:to].tolist(), stop[at:to].tolist(), strict=True)])
            tag = mix(np.arange(1, to - at + 1).astype(np.uint64))
            out[at:to] += np.bincount(owner[np.isin(np.concatenate(grams) ^ tag[owner], run ^ tag[whose])], minlength=to - at)
        at = to
    return out


def _score(item: np.ndarray, passage: np.ndarray, span: int) -> float:
    """The alignment's share of a full copy's score.  A leak takes ``span`` words of a passage at most, so a longer one is
    aligned strip by strip, each with as many words of the next."""
    strips = range(0, max(1, len(passage) - span + 1), STRIP) if len(passage) > STRIP + span else (0,)
    ends = STRIP + span if len(strips) > 1 else len(passage)
    return max(align(item, passage[a : a + ends])[0] for a in strips) / (MATCH * len(item))


def _aligned(docs: DataFrame, items: Items, seed: Seeds, leak: float, id_col: str, text_col: str) -> DataFrame:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def work(ids: pa.Array, texts: pa.Array) -> Iterable[pa.RecordBatch]:
        if not held:
            held.append(seed.lookups())
        rows = [(ids[t].as_py(), items.ids[i], score, a, b) for t, i, score, a, b in search(items, seed, held[0], texts, leak)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "start_word", "end_word"])

    return each_text(docs, _SCHEMA, work, id_col, text_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", leak: float = LEAK) -> DataFrame:
    """The rows of ``docs`` in which no item leaks, all columns unchanged; no join, so repeated ids don't matter.

    Each block of items costs a pass that counts and a pass that searches; between blocks the rest is written out."""
    out = None
    for rows in _blocks(benchmark, "item_id", "text"):
        items = Items.of(rows)
        if len(items.grams):
            seed = items.seeds(_counts(docs, items, text_col), leak)
            out = _without(docs if out is None else written(out, "clean"), items, seed, text_col, leak)
    return docs if out is None else out


def _without(docs: DataFrame, items: Items, seed: Seeds, text_col: str, leak: float) -> DataFrame:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        if not held:
            held.append(seed.lookups())
        clean = np.ones(len(texts), bool)
        clean[[t for t, *_ in search(items, seed, held[0], texts, leak)]] = False
        return rows.filter(pa.array(clean))

    return each_slice(docs, text_col, work)
