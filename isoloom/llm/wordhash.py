"""Words of UTF-8 texts as 64-bit hashes, computed with numpy over whole Arrow buffers.

A word is a maximal run of characters that an alphabet takes as word characters.  Its hash is the polynomial sum(T[b_i] * P^i) mod 2^64 over
its folded bytes, T a fixed table of random numbers, then mixed.  One cumulative sum serves all words of a chunk.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; bounds the temporary arrays at about 50 times as much.
CHUNK = 1 << 19

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[:1] = 1
    return np.cumprod(out)


@dataclass(frozen=True)
class Alphabet:
    """Which ASCII bytes separate words, what each byte is folded to before hashing, and the Unicode categories (first
    letters) of the characters beyond ASCII that belong to words (none given: all do).  With ``single`` every ideograph and
    kana is a word of its own, since such text has no spaces."""

    separator: np.ndarray
    fold: np.ndarray
    categories: str = ""
    single: bool = False


def _lower() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


@lru_cache(maxsize=4)
def _members(categories: str) -> np.ndarray:
    """For every code point, whether its category is one of these."""
    return np.fromiter((unicodedata.category(chr(c))[0] in categories for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


#: Code points of kana and ideographs: ranges from even places up to odd ones.
_SINGLE = np.array([0x3041, 0x3100, 0x31F0, 0x3200, 0x3400, 0x4DC0, 0x4E00, 0xA000, 0xF900, 0xFB00, 0x20000, 0x323B0])

#: Separators: the space and \x09-\x0D.  A-Z are folded to a-z.
SPACED = Alphabet(np.isin(np.arange(256), [32, 9, 10, 11, 12, 13]), _lower())
#: Words of letters (with the marks on them).
LETTERS = Alphabet(np.array([b < 128 and not chr(b).isalpha() for b in range(256)]), _lower(), "LM")
#: Words of letters, marks and digits; ideographs and kana one by one.
ALNUM = Alphabet(np.array([b < 128 and not chr(b).isalnum() for b in range(256)]), _lower(), "LMN", single=True)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array without nulls."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Hashes of all words in order; bounds[i]:bounds[i+1] are those of text i; start and end are byte positions."""

    hashes: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _kept(b: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and before which ones (or at the end) a word must be cut."""
    kept = ~alphabet.separator[b]
    cut = np.zeros(len(b) + 1, bool)
    lead = np.flatnonzero(b >= 0xC0) if alphabet.categories else ()
    if len(lead):
        one = b[lead].astype(np.int32)
        size = 2 + (one >= 0xE0) + (one >= 0xF0)
        code = one & (0x7F >> size)
        for k in range(1, 4):
            code = np.where(size > k, code << 6 | b[np.minimum(lead + k, len(b) - 1)] & 0x3F, code)
        out = ~_members(alphabet.categories)[np.minimum(code, sys.maxunicode)]
        for k in range(4):
            kept[np.minimum(lead + k, len(b) - 1)[out & (size > k)]] = False
        if alphabet.single:
            own = np.searchsorted(_SINGLE, code, "right") % 2 == 1
            cut[lead[own]] = cut[np.minimum(lead + size, len(b))[own]] = True
    return kept, cut


def words(raw: np.ndarray, offsets: np.ndarray, alphabet: Alphabet = SPACED) -> Words:
    """All words.  A chunk never holds more than ``CHUNK`` bytes: a word that goes on in the next chunk is put together
    from its parts, whose polynomials add up."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, total = 0, int(offsets[-1])
    up, down = _powers(_P, min(CHUNK + 4, total + 1)), _powers(_P_INV, min(CHUNK + 4, total + 1))
    open_word = False
    while at < total:
        to = total if total - at <= CHUNK else _cut(raw, offsets, at)
        b = raw[at:to]
        kept, cut = _kept(b, alphabet)
        edges = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, to, "right")] - at
        cut[edges] = True
        first = kept.copy()
        first[1:] &= ~kept[:-1] | cut[1:-1]
        last = kept.copy()
        last[:-1] &= ~kept[1:] | cut[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum(_TABLE[alphabet.fold[b]] * up[: to - at], out=sums[1:])
        value, s, e = (sums[e] - sums[s]) * down[s], s + at, e + at
        if open_word and kept[0] and not cut[0]:
            h, hs, he = parts[-1]
            h[-1:] += value[:1] * _U(pow(_P, int(he[-1] - hs[-1]), 1 << 64))
            he[-1] = e[0]
            value, s, e = value[1:], s[1:], e[1:]
        open_word = bool(kept[-1] and not cut[-1])
        if len(s):
            parts.append((value, s, e))
        at = to
    value, s, e = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Words(mix(value + (e - s).astype(np.uint64)), np.searchsorted(s, offsets), s, e)


def _cut(raw: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """Where to end a chunk that begins at ``at``: the end of a text, or else between two characters."""
    k = np.searchsorted(offsets, at + CHUNK, "right") - 1
    if offsets[k] > at:
        return int(offsets[k])
    to = at + CHUNK
    while to > at and raw[to] & 0xC0 == 0x80:
        to -= 1
    if to == at:
        to = at + CHUNK
        while to < len(raw) and raw[to] & 0xC0 == 0x80:
            to += 1
    return to


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's distinct shingles of ``size`` words, sorted; a text of fewer words has its whole
    sequence as the one, and a text without words has none."""
    n = len(w.hashes)
    run = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        run = mix(run * _U(_P) + w.hashes[k : k + len(run)])
    out, bounds = [], np.zeros(len(w.bounds), np.int64)
    for i, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for h in w.hashes[a:b]:
                short = mix(short * _U(_P) + h)
            out.append(short)
        bounds[i + 1] = bounds[i] + (len(out[-1]) if b > a else 0)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), bounds
