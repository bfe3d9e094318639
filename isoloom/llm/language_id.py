"""Language identification of words in code-switched text by a linear-chain conditional random field.

States are languages, observations are words.  A word's features are its affixes (byte n-grams that touch an end), its
inner n-grams, and which language's lexicon holds it; lexicons, feature weights and transitions are learned from
documents of known language.  Since no word labels exist, training sequences are spliced from stretches of documents in
different languages, whose words carry their document's language.  Forward-backward gives each word's posterior over
languages in its whole document; a document's language is the one with most expected words, its score that share.

Learned from at most ``SAMPLE`` documents a language; every whole text is labelled.  A text without a letter, or null,
is ``und`` with score 0; so is every text if nothing could be learned.  Null ids and repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import each_text, held_out, sampled_texts
from .wordhash import LETTERS, buffers, mix, words

#: Documents of a language that are learned from.
SAMPLE = 400
#: Documents that are learned from in all.
MOST_ROWS = 40_000
#: Hashed n-gram features, and the n-gram sizes in bytes.
FEATURES, SIZES = 1 << 15, (2, 3, 4)
#: Words of a lexicon: seen this often, with this share in one language.
LEXICON_COUNT, LEXICON_SHARE = 4, 0.8
#: Training: steps, sequences a step, words a sequence, words of a stretch.
STEPS, BATCH, LENGTH, STRETCH = 150, 96, 48, (4, 24)
#: Words of a block of forward-backward; words handled at once; word scores that a worker remembers.
BLOCK, AT_ONCE, REMEMBERED = 64, 1 << 20, 1_000_000

_U = np.uint64


def ngrams(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, bounds) of words given as byte ranges: hashed n-grams of each word with a mark at both ends."""
    size = end - start + 2
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    at = np.repeat(start - 1 - bounds[:-1], size) + np.arange(bounds[-1])
    inside = np.ones(bounds[-1], bool)
    inside[bounds[:-1]] = inside[bounds[1:] - 1] = False
    marked = np.where(inside, LETTERS.fold[raw[np.clip(at, 0, max(0, len(raw) - 1))]], 32).astype(np.uint64)
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    left = np.repeat(size, size) - place
    codes, kept = [], []
    for n in SIZES:
        h = np.zeros(len(marked), np.uint64)
        for k in range(n):
            h[: len(h) - k] = h[: len(h) - k] * _U(257) + marked[k:] + _U(1)
        affix = (place == 0) | (left == n)
        codes.append((mix(h * _U(8) + _U(n) + affix.astype(np.uint64) * _U(1 << 40)) % _U(FEATURES)).astype(np.int64))
        kept.append(left >= n)
    keep = np.stack(kept, 1)
    counts = np.add.reduceat(keep.sum(1), bounds[:-1]) if len(start) else np.zeros(0, np.int64)
    out = np.zeros(len(start) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return np.stack(codes, 1)[keep], out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row sums of values between bounds; no empty ranges."""
    return np.add.reduceat(values, bounds[:-1], axis=0)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # FEATURES x L
    lexicon: np.ndarray  # sorted word hashes
    lexicon_lang: np.ndarray  # their languages
    lexicon_weights: np.ndarray  # (L + 1) x L, the last row for words in no lexicon
    transitions: np.ndarray  # L x L, in logs

    def membership(self, hashes: np.ndarray) -> np.ndarray:
        """The lexicon that holds each word, L for none."""
        if not len(self.lexicon):
            return np.full(len(hashes), len(self.langs))
        k = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[k] == hashes, self.lexicon_lang[k], len(self.langs))

    def unary(self, features: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> np.ndarray:
        return _sums(self.weights[features], bounds) + self.lexicon_weights[member]


def posterior_sums(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, each: bool = False) -> np.ndarray:
    """Forward-backward over all texts at once: each text's sum of word posteriors (``each``: every word's posterior).

    Texts are cut into blocks.  Products of a block's factors, taken step by step over all blocks together, carry the
    messages from block to block; a second sweep inside the blocks yields the posteriors.  This is exact."""
    lengths = np.diff(bounds)
    n_lang = scores.shape[1]
    out = np.zeros((len(lengths), n_lang))
    word_out = np.zeros_like(scores) if each else None
    full = np.flatnonzero(lengths)
    if not len(full):
        return word_out if each else out
    move = np.exp(transitions - transitions.max())
    full = full[np.argsort(-lengths[full], kind="stable")]
    blocks = -(-lengths[full] // BLOCK)
    # blocks in order of their place in the text: those at place r are one slice, in the order of ``full``
    at_place = [int((blocks > r).sum()) for r in range(int(blocks[0]))]
    first = np.concatenate([[0], np.cumsum(at_place)])
    text = np.concatenate([full[:k] for k in at_place])
    place = np.repeat(np.arange(len(at_place)), at_place)
    start = bounds[:-1][text] + place * BLOCK
    size = np.minimum(BLOCK, bounds[1:][text] - start)
    steps = int(size.max())
    potential = np.exp(scores - scores.max(1, keepdims=True))

    def at(s: int) -> tuple[np.ndarray | slice, np.ndarray]:
        live = np.flatnonzero(size > s)
        return (slice(None) if len(live) == len(size) else live), potential[start[live] + s]

    product = np.tile(np.eye(n_lang), (len(start), 1, 1))
    for s in range(steps):
        live, e = at(s)
        m = (product[live].reshape(-1, n_lang) @ move).reshape(-1, n_lang, n_lang) * e[:, None, :]
        product[live] = m / m.sum((1, 2), keepdims=True)
    come = np.full((len(start), n_lang), 1 / n_lang)
    go = np.full((len(start), n_lang), 1 / n_lang)
    for r in range(1, len(at_place)):
        k = at_place[r]
        a = np.einsum("bi,bij->bj", come[first[r - 1] : first[r - 1] + k], product[first[r - 1] : first[r - 1] + k])
        come[first[r] : first[r] + k] = a / a.sum(1, keepdims=True)
    for r in range(len(at_place) - 1, 0, -1):
        k = at_place[r]
        b = np.einsum("bij,bj->bi", product[first[r] : first[r] + k], go[first[r] : first[r] + k])
        go[first[r - 1] : first[r - 1] + k] = b / b.sum(1, keepdims=True)
    forward = np.zeros((steps, len(start), n_lang))
    for s in range(steps):
        live, e = at(s)
        a = (come[live] @ move) * e
        come[live] = forward[s][live] = a / a.sum(1, keepdims=True)
    total = np.zeros((len(start), n_lang))
    for s in range(steps - 1, -1, -1):
        live, e = at(s)
        g = forward[s][live] * go[live]
        g /= g.sum(1, keepdims=True)
        total[live] += g
        if each:
            word_out[start[live] + s] = g
        b = (go[live] * e) @ move.T
        go[live] = b / b.sum(1, keepdims=True)
    np.add.at(out, text, total)
    return word_out if each else out


def _pairs(scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (B, T, L) and expected transitions (L, L) of sequences of equal length, for training."""
    n, t, n_lang = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    a, b = np.zeros_like(e), np.ones_like(e) / n_lang
    now = np.full((n, n_lang), 1 / n_lang)
    before = []
    for s in range(t):
        before.append(now)
        now = (now @ move) * e[:, s]
        now /= now.sum(1, keepdims=True)
        a[:, s] = now
    for s in range(t - 2, -1, -1):
        x = (b[:, s + 1] * e[:, s + 1]) @ move.T
        b[:, s] = x / x.sum(1, keepdims=True)
    g = a * b
    g /= g.sum(2, keepdims=True)
    expected = np.zeros((n_lang, n_lang))
    for s in range(t):
        x = before[s][:, :, None] * move[None] * (e[:, s] * b[:, s])[:, None, :]
        expected += (x / x.sum((1, 2), keepdims=True)).sum(0)
    return g, expected


def train(rows: list[tuple[int, str, str]], seed: int = 11) -> Model | None:
    """Fit on (id, text, lang) rows by stochastic gradient steps (Adam) on the conditional likelihood."""
    langs = sorted({lang for _, _, lang in rows})
    raw, offsets = buffers(pa.array([t or "" for _, t, _ in rows], pa.large_string()))
    w = words(raw, offsets, LETTERS)
    if not langs or not len(w.hashes):
        return None
    n_lang = len(langs)
    doc_lang = np.array([langs.index(lang) for _, _, lang in rows])
    word_lang = np.repeat(doc_lang, np.diff(w.bounds))
    distinct, first, where = np.unique(w.hashes, return_index=True, return_inverse=True)
    counts = np.zeros((len(distinct), n_lang))
    np.add.at(counts, (where, word_lang), 1)
    rate = counts / np.maximum(1, np.bincount(word_lang, minlength=n_lang))
    best = rate.argmax(1)
    known = (counts.sum(1) >= LEXICON_COUNT) & (rate.max(1) >= LEXICON_SHARE * rate.sum(1))
    model = Model(langs, np.zeros((FEATURES, n_lang)), distinct[known], best[known], np.zeros((n_lang + 1, n_lang)), np.zeros((n_lang, n_lang)))
    features, bounds = ngrams(raw, w.start[first], w.end[first])
    member = model.membership(distinct)
    rng = np.random.default_rng(seed)
    of_lang = [np.flatnonzero((doc_lang == k) & (np.diff(w.bounds) > 0)) for k in range(n_lang)]
    spoken = [k for k in range(n_lang) if len(of_lang[k])]
    params = [model.weights, model.lexicon_weights, model.transitions]
    first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        sequence, label = np.zeros((BATCH, LENGTH), np.int64), np.zeros((BATCH, LENGTH), np.int64)
        for i in range(BATCH):
            at = 0
            while at < LENGTH:
                lang = spoken[rng.integers(len(spoken))]
                doc = of_lang[lang][rng.integers(len(of_lang[lang]))]
                a, b = w.bounds[doc], w.bounds[doc + 1]
                n = min(int(rng.integers(*STRETCH)), LENGTH - at, int(b - a))
                from_ = a + rng.integers(b - a - n + 1)
                sequence[i, at : at + n], label[i, at : at + n] = where[from_ : from_ + n], lang
                at += n
        used, back = np.unique(sequence, return_inverse=True)
        back = back.reshape(sequence.shape)
        spread = np.concatenate([np.arange(bounds[u], bounds[u + 1]) for u in used])
        own = np.zeros(len(used) + 1, np.int64)
        np.cumsum(bounds[used + 1] - bounds[used], out=own[1:])
        unary = model.unary(features[spread], own, member[used])
        g, expected = _pairs(unary[back], np.exp(model.transitions))
        truth = np.eye(n_lang)[label]
        slope = np.zeros((len(used), n_lang))
        np.add.at(slope, back.ravel(), (truth - g).reshape(-1, n_lang))
        seen = np.zeros((n_lang, n_lang))
        np.add.at(seen, (label[:, :-1].ravel(), label[:, 1:].ravel()), 1)
        seen += np.bincount(label[:, 0], minlength=n_lang)[None] / n_lang
        grads = [np.zeros_like(p) for p in params]
        np.add.at(grads[0], features[spread], np.repeat(slope, np.diff(own), axis=0))
        np.add.at(grads[1], member[used], slope)
        grads[2] = seen - expected
        for p, d, m, v in zip(params, grads, first_moment, second_moment, strict=True):
            d = d / (BATCH * LENGTH) - 1e-5 * p
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


@dataclass
class Labeller:
    """A model with the word scores it has worked out so far."""

    model: Model
    known: dict[int, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def scores(self, raw: np.ndarray, w) -> np.ndarray:
        distinct, first, where = np.unique(w.hashes, return_index=True, return_inverse=True)
        if self.table is None or len(self.known) > REMEMBERED:
            self.known, self.table = {}, np.zeros((0, len(self.model.langs)))
        rows = np.fromiter((self.known.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(rows < 0)
        if len(new):
            features, bounds = ngrams(raw, w.start[first[new]], w.end[first[new]])
            fresh = self.model.unary(features, bounds, self.model.membership(distinct[new]))
            rows[new] = np.arange(len(self.table), len(self.table) + len(new))
            self.known.update(zip(distinct[new].tolist(), rows[new].tolist(), strict=True))
            self.table = np.concatenate([self.table, fresh])
        return self.table[rows[where]]

    def documents(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        sums = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < 6 * AT_ONCE):  # about six bytes a word
                size += len(texts[to].as_buffer()) if texts[to].is_valid else 0
                to += 1
            raw, offsets = buffers(texts.slice(at, to - at))
            w = words(raw, offsets, LETTERS)
            sums.append(posterior_sums(self.scores(raw, w), w.bounds, self.model.transitions) if len(w.hashes) else np.zeros((to - at, len(self.model.langs))))
            at = to
        total = np.concatenate(sums)
        n = total.sum(1)
        best = total.argmax(1)
        score = np.where(n > 0, total[np.arange(len(total)), best] / np.maximum(n, 1e-300), 0.0)
        langs = [self.model.langs[k] if c > 0 else "und" for k, c in zip(best.tolist(), n.tolist(), strict=True)]
        plain = pc.match_substring_regex(texts, "[A-Za-z]").fill_null(False).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero((n > 0) & ~plain).tolist():  # bytes beyond ASCII need not be letters
            if not any(c.isalpha() for c in texts[i].as_py()):
                langs[i], score[i] = "und", 0.0
        return langs, np.clip(score, 0.0, 1.0)


def sample_known(docs: DataFrame, size: int = SAMPLE) -> list[tuple[int, str, str]]:
    """At most ``size`` training rows of each language, by hash order of the id, and ``MOST_ROWS`` and
    ``common.SAMPLE_BYTES`` in all, however many rows share an id."""
    ids = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"))
    order = [F.xxhash64("__id"), F.col("__id")]
    few = ids.withColumn("__salt", F.pmod("__id", F.lit(64))).withColumn("__n", F.row_number().over(W.partitionBy("__lang", "__salt").orderBy(*order)))
    few = few.where(F.col("__n") <= size).withColumn("__n", F.row_number().over(W.partitionBy("__lang").orderBy(*order)))
    chosen = few.where(F.col("__n") <= size).orderBy("__n", "__lang", "__id").limit(MOST_ROWS).select("__id", F.col("__lang").alias("__label")).distinct()
    return sampled_texts(docs.select("doc_id", "text", "lang"), chosen, [F.col("doc_id") == F.col("__id"), F.col("lang") == F.col("__label")], size)


def label(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    held: list[Labeller] = []

    def work(ids: pa.Array, texts: pa.Array) -> Iterable[pa.RecordBatch]:
        if model is None:
            langs, score = ["und"] * len(ids), np.zeros(len(ids))
        else:
            if not held:
                held.append(Labeller(model))
            langs, score = held[0].documents(texts)
        yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return each_text(docs, "doc_id long, lang_pred string, score double", work, id_col, text_col)


def label_words(text: str, model: Model) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of each word of one text."""
    raw, offsets = buffers(pa.array([text], pa.large_string()))
    w = words(raw, offsets, LETTERS)
    if not len(w.hashes):
        return []
    p = posterior_sums(Labeller(model).scores(raw, w), w.bounds, model.transitions, each=True)
    data = raw.tobytes()
    return [(data[a:b].decode("utf-8", "replace"), model.langs[k], float(q)) for a, b, k, q in zip(w.start, w.end, p.argmax(1), p.max(1), strict=True)]
